"""Row functions as Arrow-batched pandas UDFs; null in, null out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf


def elementwise(f, returns: str, strict: bool = True):
    """f over the rows of its columns; if strict, a null argument gives null."""

    def one(args):
        if strict and any(a is None or (isinstance(a, float) and a != a) for a in args):
            return None
        return f(*args)

    def run(*cols):
        return pd.Series([one(r) for r in zip(*(c.tolist() for c in cols))], dtype=object)

    n = f.__code__.co_argcount
    if n == 1:

        def g1(a: pd.Series) -> pd.Series:
            return run(a)

        return pandas_udf(g1, returns)
    if n == 2:

        def g2(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)

        return pandas_udf(g2, returns)
    if n == 3:

        def g3(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return run(a, b, c)

        return pandas_udf(g3, returns)

    def g4(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return run(a, b, c, d)

    return pandas_udf(g4, returns)
