"""Column functions: periods, values, text."""
