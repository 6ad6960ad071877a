"""Column functions: tokens, titles, names and paths."""
