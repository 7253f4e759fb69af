"""Column functions for text whose meaning must be exact."""
