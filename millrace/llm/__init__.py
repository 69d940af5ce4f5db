"""Operators for text and model training data. Nothing outside this package imports it."""
