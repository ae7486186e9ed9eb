"""Operators for preparing training text, as Spark jobs; nothing else in the library imports them."""
