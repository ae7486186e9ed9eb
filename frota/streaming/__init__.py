"""Structured Streaming forms of the continuous loops."""
