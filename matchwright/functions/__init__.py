"""Column functions and plain numeric helpers."""
