"""Column expressions: text, dates, places and colour."""
