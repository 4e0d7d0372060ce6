"""Column functions on paths, text and code."""
