"""Node and edge labels over tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class EdgeLabel:
    table: DataFrame
    source: str | None
    target: str | None
    src: str
    dst: str


class Graph:
    """Labels map tables into a graph. A node is a struct of __id, __label and its columns; an edge one of __id, __type, __src, __dst and its columns."""

    def __init__(self, engine):
        self.engine = engine
        self.nodes: dict[str, tuple[DataFrame, str]] = {}
        self.edges: dict[str, EdgeLabel] = {}

    def node_label(self, label: str, table: DataFrame | str, id_col: str = "id") -> Graph:
        self.nodes[label] = (self.engine.table(table) if isinstance(table, str) else table, id_col)
        return self

    def edge_label(self, label: str, table: DataFrame | str, source: str | None = None, target: str | None = None, src: str = "source_id", dst: str = "target_id") -> Graph:
        self.edges[label] = EdgeLabel(self.engine.table(table) if isinstance(table, str) else table, source, target, src, dst)
        return self

    def drop_node_label(self, label: str) -> None:
        del self.nodes[label]

    def drop_edge_label(self, label: str) -> None:
        del self.edges[label]

    # ------------------------------------------------------------ as tables

    def _name(self, names: dict, label: str) -> str:
        return next((k for k in names if k.lower() == label.lower()), label)

    def same_nodes(self, label: str) -> list[str]:
        """Labels, lower-cased, whose nodes have this label too: those over the same table and key."""
        name = self._name(self.nodes, label)
        if name not in self.nodes:
            return [label.lower()]
        table, key = self.nodes[name]
        return [k.lower() for k, (df, own) in self.nodes.items() if df is table and own == key]

    def key_type(self) -> str:
        """Ids are long; text if any label's key is text."""
        kinds = [df.schema[key].dataType.simpleString() for df, key in self.nodes.values()] + [e.table.schema[c].dataType.simpleString() for e in self.edges.values() for c in (e.src, e.dst)]
        return "string" if "string" in kinds else "long"

    def node_table(self, labels: list[str] | None, where: Column | None = None) -> DataFrame:
        """Columns __id, __label and the labels' own (united, if there are several)."""
        out = None
        for label in [self._name(self.nodes, x) for x in labels] if labels else list(self.nodes):
            if label not in self.nodes:
                continue
            df, key = self.nodes[label]
            one = df.select(F.col(key).cast(self.key_type()).alias("__id"), F.lit(label).alias("__label"), "*")
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            out = self.engine.spark.createDataFrame([], f"__id {self.key_type()}, __label string")
        return out if where is None else out.where(where)

    def edge_table(self, types: list[str] | None) -> DataFrame:
        """Columns __id, __type, __src, __dst, __sl, __tl and the edges' own. Equal rows are one edge where a pattern may not repeat an edge."""
        out = None
        for label in [self._name(self.edges, x) for x in types] if types else list(self.edges):
            if label not in self.edges:
                continue
            e = self.edges[label]
            own = [c for c in e.table.columns if c not in (e.src, e.dst)]
            one = e.table.select(
                F.xxhash64(F.lit(label), *e.table.columns).alias("__id"), F.lit(label).alias("__type"), F.col(e.src).cast(self.key_type()).alias("__src"), F.col(e.dst).cast(self.key_type()).alias("__dst"),
                F.lit(e.source).cast("string").alias("__sl"), F.lit(e.target).cast("string").alias("__tl"), *own,
            ).where("__src IS NOT NULL AND __dst IS NOT NULL")
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            out = self.engine.spark.createDataFrame([], f"__id long, __type string, __src {self.key_type()}, __dst {self.key_type()}, __sl string, __tl string")
        return out

    def projection(self, types: list[str] | None = None, weight: str | None = None, undirected: bool = False) -> DataFrame:
        """(src, dst, weight) for algorithms; parallel edges are one edge whose weight is their sum."""
        e = self.edge_table(types)
        if self.key_type() != "long":
            raise ValueError("algorithms run over nodes whose keys are numbers")
        e = e.select(F.col("__src").alias("src"), F.col("__dst").alias("dst"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
        if undirected:
            e = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))

    def neighbors(self, label: str, node_id: int, direction: str = "out", limit: int | None = None) -> DataFrame:
        """graph_neighbors: ids one edge away."""
        e = self.edge_table([label])
        out = e.where(F.col("__src") == node_id).select(F.col("__dst").alias("id"))
        back = e.where(F.col("__dst") == node_id).select(F.col("__src").alias("id"))
        out = out if direction == "out" else back if direction == "in" else out.unionAll(back)
        out = out.distinct().orderBy("id")
        return out.limit(limit) if limit is not None else out

    def query(self, text: str) -> DataFrame:
        from .cypher import run

        return run(self, text)
