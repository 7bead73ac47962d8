"""Column functions: text, numbers and arrays."""
