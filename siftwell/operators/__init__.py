"""Relational operators built from the column functions."""
