"""Column functions: levels, windows, text and dictionaries."""
