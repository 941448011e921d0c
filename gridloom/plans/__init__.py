"""Column expressions that a plan is built from."""
