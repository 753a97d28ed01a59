"""Readers, writers and the run tables."""
