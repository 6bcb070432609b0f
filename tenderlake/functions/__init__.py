"""Column functions: text, numbers, model answers."""
