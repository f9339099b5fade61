"""Operators on training text: scans, filters, tokens, near copies, search and packing."""
