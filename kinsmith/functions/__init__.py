"""Column functions: text, arrays, string similarity, numbers."""
