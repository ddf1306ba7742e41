"""Relational operators that Spark SQL has no single call for."""
