"""Column expressions and small vectorised helpers used by the operators."""
