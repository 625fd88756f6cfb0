"""Relational operators: filters, paging, windows, look-ups, writes, back-fill and text extraction."""
