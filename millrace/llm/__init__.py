"""Operators for large training-text corpora, and the queries registered for them."""
