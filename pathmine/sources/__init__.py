"""Sources and sinks: record text, graph dumps, source trees, repository lists."""
