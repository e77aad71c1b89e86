"""Column expressions and argument rules shared by the operators."""
