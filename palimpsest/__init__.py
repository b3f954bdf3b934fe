"""Associative-memory analytics on PySpark."""
