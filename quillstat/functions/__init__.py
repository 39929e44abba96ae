"""Column-level functions (all built-in Spark SQL expressions)."""
