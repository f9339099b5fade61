"""Column expressions and small reusable plan fragments."""
