"""Column-level helpers; every one is a plain Spark expression."""
