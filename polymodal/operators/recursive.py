"""Fixpoints: WITH RECURSIVE ... UNION, whose steps see only rows that are new."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_written: dict[str, SparkSession] = {}


def _folder(spark: SparkSession) -> str:
    """The folder that all executors share (a temporary one only where none is set, with a local master)."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='polymodal-')}"
        sc.setCheckpointDir(top)
    return top.rstrip("/")


def _storable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return not isinstance(kind, (T.NullType, T.CalendarIntervalType, T.VariantType))


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: df is written once to the folder all executors share and read back, so its size is known to the planner. What Parquet can't hold is checkpointed there."""
    spark = df.sparkSession
    top = _folder(spark)
    if not _storable(df.schema) or len({c.lower() for c in df.columns}) < len(df.columns):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(top)
        return df.checkpoint()
    path = f"{top}/polymodal-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the JVM has gone; the folder is temporary anyway
            return


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, most: int = 10_000) -> DataFrame:
    """base UNION step(new rows) until nothing is new. most: rounds after which an endless recursion raises."""
    cols = base.columns
    new = cut(base.distinct() if distinct else base)
    every = new
    for _ in range(most):
        found = step(new).toDF(*cols)
        if distinct:
            match = None
            seen = every.toDF(*(f"__s{i}" for i in range(len(cols))))
            for i, c in enumerate(cols):
                one = found[c].eqNullSafe(seen[f"__s{i}"])
                match = one if match is None else match & one
            found = found.distinct().join(seen, match, "left_anti")
        new = cut(found)
        if new.isEmpty():
            return every
        every = cut(every.unionAll(new))
    raise RuntimeError(f"no fixpoint after {most} rounds")


def transitive_closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All (src, dst) with a path of one edge or more."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    hop = e.select(F.col("src").alias("__m"), F.col("dst").alias("__d"))
    return fixpoint(e, lambda new: new.join(hop, new["dst"] == hop["__m"]).select("src", F.col("__d").alias("dst")))
