from __future__ import annotations

import re

from ..engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def engine(spark, sf_dir: str, text: str = "", *tables: str) -> Engine:
    names = tables or [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return Engine(spark).load(sf_dir, *names)


def case(cases: dict, name: str, text: str, oracle: str | None = None) -> None:
    """A statement of the dialect; the oracle runs the same text unless another one is given ("" for none)."""
    cases[name] = (lambda spark, sf_dir: engine(spark, sf_dir, text).sql(text), text if oracle is None else oracle)
