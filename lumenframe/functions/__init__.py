"""Column expressions and per-record functions."""
