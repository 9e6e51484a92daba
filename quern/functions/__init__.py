"""Column expressions: names, text, dates and types."""
