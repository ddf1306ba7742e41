"""IVF-flat: vectors in lists by nearest centroid; a query reads its nprobe nearest lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantize import kmeans
from .topk import top_k_hits

#: Rows that centroids are fitted on at most; every row is indexed.
SAMPLE = 50_000


class IvfIndex:
    def __init__(self, lists: DataFrame, centroids: np.ndarray, column: str, id_col: str):
        self.lists, self.centroids, self.column, self.id_col = lists, centroids, column, id_col

    @classmethod
    def build(cls, df: DataFrame, column: str, id_col: str = "id", nlist: int = 64, seed: int = 0) -> IvfIndex:
        """Adds __list, by which a stored index is partitioned, so that a probe reads its lists' files alone."""
        sample = df.where(F.col(column).isNotNull()).orderBy(F.xxhash64(id_col, F.lit(seed))).limit(SAMPLE).select(column).toPandas()
        c = kmeans(np.array(sample[column].tolist(), np.float64), min(nlist, len(sample)), seed=seed)

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), np.float64)
            return pd.Series(((c * c).sum(1) - 2 * x @ c.T).argmin(1)) if len(v) else pd.Series([], dtype="int")

        return cls(df.where(F.col(column).isNotNull()).withColumn("__list", nearest(F.col(column).cast("array<float>"))), c, column, id_col)

    def save(self, path: str) -> IvfIndex:
        self.lists.write.mode("overwrite").partitionBy("__list").parquet(path)
        self.lists = self.lists.sparkSession.read.parquet(path)
        return self

    def search(self, query: list[float], k: int, nprobe: int = 8, metric: str = "l2") -> DataFrame:
        q = np.array(query, np.float64)
        near = ((self.centroids - q) ** 2).sum(1).argsort(kind="stable")[:nprobe].tolist()
        return top_k_hits(self.lists.where(F.col("__list").isin(*near)).drop("__list"), self.column, query, k, metric, self.id_col)
