"""Column expressions: text, scalars and statistics."""
