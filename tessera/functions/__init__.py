"""Column expressions: physics of a single row."""
