"""Column expressions: text, signatures, distances."""
