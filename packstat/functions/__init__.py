"""Column expressions: periodic arithmetic, shapes, ordered numbering, hashing."""
