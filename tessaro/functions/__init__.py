"""Column expressions: text, numeric, geodesy."""
