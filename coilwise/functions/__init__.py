"""Column expressions: no shuffles, no Python on the row path."""
