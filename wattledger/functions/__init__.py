"""Column functions: numbers, text and time."""
