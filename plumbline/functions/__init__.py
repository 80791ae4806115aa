"""Column expressions: numbers, dates, keys and text rules."""
