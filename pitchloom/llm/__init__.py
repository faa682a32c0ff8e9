"""Operators for large training-data corpora (optional subpackage)."""
