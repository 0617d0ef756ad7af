"""Column functions: tokens, scores, distances, snippets."""
