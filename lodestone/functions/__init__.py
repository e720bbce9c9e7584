"""Column functions: text, vectors, budgets."""
