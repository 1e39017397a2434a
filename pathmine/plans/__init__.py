"""Graph views over the input tables and the registered query plans."""
