"""Millrace: operators."""
