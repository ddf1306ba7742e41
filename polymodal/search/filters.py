"""Filter options as one Column, so that Catalyst pushes them into the scan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def compile_filter(spec: dict | None, id_col: str = "id") -> Column:
    """must (all), should (at least one), must_not (none) and min_should (at least min_count), nested at will."""
    if not spec:
        return F.lit(True)
    parts: list[Column] = []
    if "must" in spec:
        parts.append(reduce(lambda a, b: a & b, [_condition(c, id_col) for c in _list(spec["must"])], F.lit(True)))
    if "should" in spec:
        options = [_condition(c, id_col) for c in _list(spec["should"])]
        parts.append(reduce(lambda a, b: a | b, options) if options else F.lit(True))
    if "must_not" in spec:
        parts += [~F.coalesce(_condition(c, id_col), F.lit(False)) for c in _list(spec["must_not"])]
    if "min_should" in spec:
        m = spec["min_should"]
        met = [F.coalesce(_condition(c, id_col), F.lit(False)).cast("int") for c in m["conditions"]]
        parts.append(reduce(lambda a, b: a + b, met, F.lit(0)) >= int(m["min_count"]))
    if not parts:
        parts.append(_condition(spec, id_col))
    return reduce(lambda a, b: a & b, parts)


def _list(x) -> list:
    return x if isinstance(x, list) else [x]


def path(key: str) -> Column:
    """Dotted and bracketed paths: a.b[0].c (0-based), a[].b reads each element."""
    out = None
    for name, index in re.findall(r"([^.\[\]]+)|\[(\d*)\]", key):
        if name:
            out = F.col(f"`{name}`") if out is None else out[name]
        elif index:
            out = F.get(out, F.lit(int(index)))
    if out is None:
        raise ValueError(f"no path: {key}")
    return out


def _condition(c: dict, id_col: str) -> Column:
    if any(k in c for k in ("must", "should", "must_not", "min_should")):
        return compile_filter(c, id_col)
    if "has_id" in c:
        return F.col(id_col).isin(*c["has_id"])
    if "is_null" in c:
        return path(c["is_null"]["key"]).isNull()
    if "is_empty" in c:
        x = path(c["is_empty"]["key"])
        return F.coalesce(F.length(x.cast("string")) == 0, F.lit(True)) | (x.cast("string") == "[]")
    key = path(c["key"])
    if "match" in c:
        m = c["match"]
        if "value" in m:
            return key == F.lit(m["value"])
        if "any" in m:
            return key.isin(*m["any"])
        if "except" in m:
            return ~key.isin(*m["except"])
        if "text" in m:  # all words occur
            return reduce(lambda a, b: a & b, [F.lower(key).contains(w) for w in m["text"].lower().split()], F.lit(True))
    if "range" in c:
        ops = {"gt": lambda v: key > v, "gte": lambda v: key >= v, "lt": lambda v: key < v, "lte": lambda v: key <= v}
        return reduce(lambda a, b: a & b, [ops[k](F.lit(v)) for k, v in c["range"].items() if v is not None], F.lit(True))
    if "values_count" in c:
        n = F.when(key.isNull(), 0).otherwise(F.size(key))
        ops = {"gt": lambda v: n > v, "gte": lambda v: n >= v, "lt": lambda v: n < v, "lte": lambda v: n <= v}
        return reduce(lambda a, b: a & b, [ops[k](v) for k, v in c["values_count"].items()], F.lit(True))
    raise ValueError(f"unknown condition: {sorted(c)}")
