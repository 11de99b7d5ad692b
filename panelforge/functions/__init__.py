"""Column expressions: no data is read here."""
