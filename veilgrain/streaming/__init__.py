"""Structured Streaming forms of the ordered and expiring operators."""
