"""Column expressions and distributed primitives shared by the operators."""
