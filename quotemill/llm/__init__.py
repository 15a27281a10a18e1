"""Operators for large text, page and media tables used to prepare training data."""
