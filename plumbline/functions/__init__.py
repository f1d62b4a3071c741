"""Column expressions: cleaning, portable hashing, geometry, skill arithmetic."""
