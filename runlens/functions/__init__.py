"""Column functions and small helpers."""
