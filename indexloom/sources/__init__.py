"""Sources and sinks of arrays."""

from .arrays import alloc, domain, from_local, from_rows, from_table, generate, to_parquet, unit, use

__all__ = ["alloc", "domain", "from_local", "from_rows", "from_table", "generate", "to_parquet", "unit", "use"]
