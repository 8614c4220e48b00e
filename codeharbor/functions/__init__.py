"""Column expressions: fixed rule values, text, path and arithmetic helpers."""
