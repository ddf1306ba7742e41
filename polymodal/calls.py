"""Functions that need the session: searches as tables, sequences, settings and enumerations.

Searches take their arguments in the dialect's order: (table, column, query, k, ...); hits are columns id, score, rank and, if the options ask for them, payload
and vector. Lists to be fused are calls themselves.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from . import search
from .plans import dialect
from .plans.dialect import Group, Tok

HITS = frozenset("vector_top_k_ids vector_top_k_hits vector_prefetch_top_k_hits vector_recommend_top_k_hits full_text_top_k_hits hybrid_search_top_k_hits hybrid_fuse_rrf_hits hybrid_fuse_dbsf_hits hybrid_group_hits_by graph_neighbors".split())
SESSION = frozenset("nextval currval setval lastval current_setting set_config enum_first enum_last enum_range current_query inet_client_addr inet_server_addr".split())


def value(items: list):
    """A literal argument: NULL, number, text, vector or JSON text, ARRAY[...]; or None if there is none."""
    items = [x for k, x in enumerate(items) if not (isinstance(x, Tok) and x.text == "::" or k and isinstance(items[k - 1], Tok) and items[k - 1].text == "::")]
    if not items or dialect._is(items[0], "NULL"):
        return None
    if dialect._is(items[0], "ARRAY") and isinstance(items[1], Group):
        return [value(x) for x in dialect.split(items[1].items)]
    if dialect._is(items[0], "-"):
        return -value(items[1:])
    x = items[0]
    if x.kind == "num":
        return float(x.text) if re.search(r"[.eE]", x.text) else int(x.text)
    if x.kind == "str":
        text = dialect._unquote(x.text)
        if text[:1] in "[{" and text[:1]:
            return json.loads(text)
        return text
    if dialect._is(x, "TRUE", "FALSE"):
        return x.up() == "TRUE"
    raise ValueError(f"arguments of searches are literals, not {x.text}")


def _call(engine, items: list) -> DataFrame:
    if len(items) == 2 and isinstance(items[1], Group) and items[0].text.lower() in HITS:
        return hits(engine, items[0].text.lower(), items[1].items)
    return engine.table(items[0].text)


def hits(engine, name: str, items: list) -> DataFrame:
    parts = dialect.split(items)
    if name in ("hybrid_fuse_rrf_hits", "hybrid_fuse_dbsf_hits"):
        fuse = search.fuse_rrf if "rrf" in name else search.fuse_dbsf
        return fuse(_call(engine, parts[0]), _call(engine, parts[1]), value(parts[2]))
    if name == "hybrid_group_hits_by":
        return search.group_hits(_call(engine, parts[0]), value(parts[1]), value(parts[2]), value(parts[3]) if len(parts) > 3 else 1)
    args = [value(p) for p in parts]
    opt = lambda k, default=None: args[k] if len(args) > k and args[k] is not None else default
    if name == "graph_neighbors":
        return engine.graph.neighbors(args[0], args[1], opt(2, "out"), opt(3))
    df = engine.table(args[0])
    options = next((a for a in args[4:] if isinstance(a, dict)), None)
    id_col = (options or {}).pop("id", None) or ("id" if "id" in df.columns else df.columns[0])
    if name in ("vector_top_k_ids", "vector_top_k_hits"):
        call = search.top_k_ids if name.endswith("ids") else search.top_k_hits
        return call(df, args[1], args[2], args[3], opt(4, "l2"), id_col, distance_threshold=opt(6), score_threshold=opt(8), options=options)
    if name == "vector_prefetch_top_k_hits":
        return search.prefetch_hits(df, args[1], args[2], args[3], args[4], opt(5), opt(6, "l2"), id_col)
    if name == "vector_recommend_top_k_hits":
        return search.recommend_hits(df, args[1], args[2] or [], args[3] or [], args[4], opt(5, "cosine"), id_col, options)
    if name == "full_text_top_k_hits":
        return search.full_text_hits(df, args[1], args[2], args[3], opt(4, "plain"), opt(5, "english"), opt(6) if not isinstance(opt(6), dict) else None, id_col, options)
    return search.hybrid_hits(df, args[1], args[2], args[3], args[4], args[5], (options or {}).pop("fusion", "rrf"), id_col=id_col, options=options)


def session(engine, name: str, items: list) -> list:
    """Tokens of the value."""
    parts = dialect.split(items)
    if name in ("enum_first", "enum_last", "enum_range"):
        kind = next(t.text.lower() for p in parts for t in p if isinstance(t, Tok) and t.text.lower() in engine.enums)
        labels = engine.enums[kind]
        quoted = [Tok("str", dialect._quote(x)) for x in labels]
        if name == "enum_range":
            ends = [value(p) for p in parts] if len(parts) > 1 else [None, None]
            lo, hi = labels.index(ends[0]) if ends[0] else 0, labels.index(ends[1]) if ends[1] else len(labels) - 1
            inner: list = []
            for q in quoted[lo : hi + 1]:
                inner += ([Tok("op", ",")] if inner else []) + [q]
            return [Tok("id", "ARRAY"), Group("[", inner)]
        return [quoted[0] if name == "enum_first" else quoted[-1]]
    if name in ("nextval", "currval", "setval", "lastval"):
        if name == "lastval":
            got = engine._last.currval()
        else:
            s = engine.sequences[value(parts[0])]
            got = s.nextval() if name == "nextval" else s.currval() if name == "currval" else s.setval(value(parts[1]), value(parts[2]) if len(parts) > 2 else True)
            engine._last = s if name == "nextval" else engine._last
        return [Tok("num", f"{got}L")]
    if name == "current_setting":
        got = engine.spark.conf.get(value(parts[0]), None)
        return [Tok("str", dialect._quote(got)) if got is not None else Tok("id", "NULL")]
    if name == "set_config":
        engine.spark.conf.set(value(parts[0]), value(parts[1]))
        return [Tok("str", dialect._quote(str(value(parts[1]))))]
    return [Tok("id", "NULL")]
