"""Structured Streaming over generations of rows."""
