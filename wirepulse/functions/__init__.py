"""Column expressions and lookup tables shared by the operators."""
