"""Column functions: text, numbers, units, language."""
