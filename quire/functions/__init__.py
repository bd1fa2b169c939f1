"""Column functions and parsers of single values."""
