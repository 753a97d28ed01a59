"""Column functions: every function here takes and returns ``Column`` expressions."""
