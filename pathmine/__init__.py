"""pathmine: path-context mining over graph tables, expressed as Spark DataFrame plans."""

from pathmine.options import ExtractOptions, FormatOptions

__all__ = ["ExtractOptions", "FormatOptions"]
