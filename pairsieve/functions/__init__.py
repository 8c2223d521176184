"""Column expressions: vectors, tokens and conversations, scores, seeded hashing."""
