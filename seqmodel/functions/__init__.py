"""Column functions; every one is a plain Spark SQL expression."""
