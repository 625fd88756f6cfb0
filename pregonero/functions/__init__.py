"""Column expressions: text, dates, amounts, JSON, classes, keys, links and places."""
