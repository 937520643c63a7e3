"""Column expressions: dates, text, and running totals over a split order."""
