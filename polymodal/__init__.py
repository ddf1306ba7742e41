"""Relational, property-graph, vector and full-text queries over ordinary Spark DataFrames."""

__all__ = ["Engine"]


def __getattr__(name: str):
    if name == "Engine":
        from .engine import Engine

        return Engine
    raise AttributeError(name)
