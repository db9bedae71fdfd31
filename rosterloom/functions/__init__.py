"""Column builders: pure Spark expressions, every column name a parameter."""
