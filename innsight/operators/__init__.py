"""Operators: every function here takes and returns ``DataFrame`` objects."""
