"""Property graphs over ordinary tables: labels, patterns, paths and algorithms."""

from .catalog import Graph

__all__ = ["Graph"]
