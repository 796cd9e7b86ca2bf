"""Whole queries, their SQL twins and the catalogue of both."""
