"""Whole queries and workflows built from the operators."""
