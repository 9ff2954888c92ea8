"""Column expressions shared by the operators (Column -> Column)."""
