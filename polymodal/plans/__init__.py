"""From the PostgreSQL dialect to Spark SQL."""

from .dialect import rewrite, rewrite_expression

__all__ = ["rewrite", "rewrite_expression"]
