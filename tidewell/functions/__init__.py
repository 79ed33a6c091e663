"""Column functions: text, vectors, scores, JSON."""
