"""CREATE, MERGE, SET, REMOVE, DELETE: labels get new tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dml
from ..plans import dialect
from ..plans.dialect import split


def _literal_rows(query, pairs: list, var: str | None):
    from .cypher import expr

    return {p[0].text.strip("`"): expr(p[2:], query.bound) for p in pairs}


def apply(query, word: str, items: list) -> None:
    {"CREATE": create, "MERGE": merge, "SET": set_, "REMOVE": remove, "DELETE": delete, "DETACH": lambda q, i: delete(q, i, True)}[word](query, items)


def _put(graph, label: str, df) -> None:
    old, key = graph.nodes[label]
    graph.nodes[label] = (df, key)
    for name, t in list(graph.engine.tables.items()):
        if t is old:
            graph.engine.register(name, df)


def create(query, items: list) -> None:
    """Nodes with literal or bound properties; edges between bound nodes or nodes made in the same pattern."""
    graph = query.graph
    for part in split(items):
        nodes, rels = query.chain(part)
        for n in nodes:
            if n.var in query.bound:
                continue
            label = graph._name(graph.nodes, n.labels[0])
            props = _literal_rows(query, split(n.props), n.var)
            base = query.df if query.df is not None else graph.engine.spark.range(1)
            if label in graph.nodes:
                table, key = graph.nodes[label]
                row = base.select(*(F.expr(props[c]).cast(table.schema[c].dataType).alias(c) if c in props else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns))
                extra = [c for c in props if c not in table.columns]
                if extra:  # a property that the table lacks becomes a column
                    row = base.select(*(F.expr(e).alias(c) for c, e in props.items()))
                    _put(graph, label, table.unionByName(row, allowMissingColumns=True))
                else:
                    _put(graph, label, dml.insert(table, row))
            else:
                key = "id"
                row = base.select(*(F.expr(e).alias(c) for c, e in props.items()))
                graph.nodes[label] = (row, key)
            key = graph.nodes[label][1]
            made = row.select(F.struct(F.col(key).cast("long").alias("__id"), F.lit(label).alias("__label"), "*").alias(n.var))
            query.df = made if query.df is None else query.df.join(made, F.expr(props[key]) == F.col(f"`{n.var}`.__id"))
            query.bound[n.var] = "node"
        for a, r, b in zip(nodes, rels, nodes[1:]):
            label = graph._name(graph.edges, r.types[0])
            s, t = (a, b) if r.direction != "in" else (b, a)
            props = _literal_rows(query, split(r.props), None)
            if label in graph.edges:
                e = graph.edges[label]
                row = query.df.select(F.col(f"`{s.var}`.__id").cast(e.table.schema[e.src].dataType).alias(e.src), F.col(f"`{t.var}`.__id").cast(e.table.schema[e.dst].dataType).alias(e.dst), *(F.expr(x).alias(c) for c, x in props.items()))
                e.table = e.table.unionByName(row, allowMissingColumns=True)
            else:
                row = query.df.select(F.col(f"`{s.var}`.__id").alias("source_id"), F.col(f"`{t.var}`.__id").alias("target_id"), *(F.expr(x).alias(c) for c, x in props.items()))
                graph.edge_label(label, row, s.labels[0] if s.labels else None, t.labels[0] if t.labels else None)


def merge(query, items: list) -> None:
    """One node: made if no node has these properties."""
    on = dialect.find(items, "ON")
    pattern = items[:on] if on >= 0 else items
    nodes, _ = query.chain(pattern)
    n = nodes[0]
    probe = type(query)(query.graph)
    if len(nodes) == 1 and query.graph._name(query.graph.nodes, n.labels[0]) in query.graph.nodes:
        probe.match(pattern)
        if not probe.df.isEmpty():
            query.df, query.bound = probe.df, query.bound | probe.bound
            return
    create(query, pattern)


def set_(query, items: list) -> None:
    """var.prop = expression, for the bound nodes."""
    from .cypher import expr

    graph = query.graph
    for part in split(items):
        var, prop, value = part[0].text, part[2].text, expr(part[4:], query.bound)
        rows = query.df.select(F.col(f"`{var}`.__id").alias("__k"), F.col(f"`{var}`.__label").alias("__l"), F.expr(value).alias("__v")).distinct()
        for label in list(graph.nodes):
            table, key = graph.nodes[label]
            hit = rows.where(F.col("__l") == label).groupBy("__k").agg(F.first("__v").alias("__v"), F.lit(True).alias("__h"))
            j = table.join(hit, table[key] == hit["__k"], "left")
            new = F.when(F.col("__h"), F.col("__v")).otherwise(F.col(prop) if prop in table.columns else F.lit(None))
            if prop in table.columns:
                new = new.cast(table.schema[prop].dataType)
            cols = [new.alias(prop) if c == prop else F.col(c) for c in table.columns] + ([] if prop in table.columns else [new.alias(prop)])
            _put(graph, label, j.select(*cols))


def remove(query, items: list) -> None:
    for part in split(items):
        set_(query, [*part, dialect.Tok("op", "="), dialect.Tok("id", "NULL")])


def delete(query, items: list, detach: bool = False) -> None:
    graph = query.graph
    for part in split(items):
        var = part[0].text
        if query.bound.get(var) == "rel":
            for label, e in graph.edges.items():
                gone = query.df.select(F.col(f"`{var}`.__id").alias("__k")).distinct()
                own = e.table.withColumn("__eid", F.xxhash64(F.lit(label), *e.table.columns))
                e.table = own.join(gone, F.col("__eid") == F.col("__k"), "left_anti").drop("__eid")
            continue
        gone = query.df.select(F.col(f"`{var}`.__id").alias("__k"), F.col(f"`{var}`.__label").alias("__l")).distinct()
        for label in list(graph.nodes):
            table, key = graph.nodes[label]
            ids = gone.where(F.col("__l") == label).select("__k")
            touching = [e for e in graph.edges.values() if e.source in (label, None) or e.target in (label, None)]
            for e in touching:
                for end, side in ((e.src, e.source), (e.dst, e.target)):
                    if side in (label, None):
                        left = e.table.join(ids, e.table[end] == ids["__k"], "left_anti")
                        if not detach and left.count() < e.table.count():
                            raise ValueError("a node with relationships needs DETACH DELETE")
                        e.table = left
            _put(graph, label, table.join(ids, table[key] == ids["__k"], "left_anti"))
