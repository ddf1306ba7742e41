"""Sequences: numbers handed out in blocks from the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Sequence:
    def __init__(self, start: int = 1, step: int = 1):
        self.step, self.next, self.last = step, start, None

    def nextval(self) -> int:
        self.last, self.next = self.next, self.next + self.step
        return self.last

    def currval(self) -> int:
        if self.last is None:
            raise ValueError("currval before nextval")
        return self.last

    def setval(self, value: int, called: bool = True) -> int:
        self.last, self.next = (value, value + self.step) if called else (self.last, value)
        return value

    def number(self, df: DataFrame, column: str, *order: str) -> DataFrame:
        """df with numbers in the given order. Rows are counted by range partition and numbered within, so no task holds them all."""
        ranged = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
        from .recursive import cut

        ranged = cut(ranged)
        sizes = {r["__p"]: r["n"] for r in ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
        base, total = [], 0
        for p in sorted(sizes):
            base.append((p, total))
            total += sizes[p]
        if not base:
            return ranged.drop("__p").withColumn(column, F.lit(None).cast("long"))
        start = F.create_map(*(F.lit(x) for pair in base for x in pair))[F.col("__p")]
        place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1 + start
        first, self.last, self.next = self.next, self.next + self.step * (total - 1), self.next + self.step * total
        return ranged.withColumn(column, (F.lit(first) + place * self.step).cast("long")).drop("__p")
