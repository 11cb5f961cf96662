"""Column expressions and aggregates."""
