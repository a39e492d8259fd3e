"""Column expressions and fixed business values."""
