"""Readers, writers and the panel views derived from the given tables."""
