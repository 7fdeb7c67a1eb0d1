"""Column expressions: time, geography and scalar helpers."""
