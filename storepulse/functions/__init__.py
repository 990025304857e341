"""Column functions (built-in Spark SQL expressions only; no Python UDFs)."""
