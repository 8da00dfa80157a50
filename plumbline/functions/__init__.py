"""Column functions: every one returns a built-in Column expression (no Python UDF)."""
