"""Millrace: streaming."""
