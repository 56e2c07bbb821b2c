"""Column functions: each takes and returns Spark columns."""
