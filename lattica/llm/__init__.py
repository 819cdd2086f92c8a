"""Operators for large training-corpus preparation."""
