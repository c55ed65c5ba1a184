"""Column expressions: bytes, instants, labels and flags."""
