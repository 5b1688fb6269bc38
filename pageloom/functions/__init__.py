"""Column functions: every one is built from Spark expressions only."""
