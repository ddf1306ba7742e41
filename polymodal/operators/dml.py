"""INSERT, UPDATE, DELETE, MERGE and ON CONFLICT as transformations from one DataFrame to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, str] | None = None, where: str | None = None) -> DataFrame:
    """ON CONFLICT (keys) DO UPDATE SET (DO NOTHING if update is None). Expressions name the old row as ``t`` and the new one as ``excluded``.

    Of rows with equal keys among the new ones the first by all columns counts. A null key conflicts with nothing.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*rows.columns))
    new = rows.withColumn("__n", first).where(F.coalesce(F.col("__n") == 1, F.lit(True))).drop("__n").alias("excluded")
    old = table.alias("t")
    on = _on(keys, "t", "excluded")
    if update is None:
        return insert(table, new.join(table.alias("t"), on, "left_anti"))
    hit = F.expr(" AND ".join(f"excluded.`{k}` IS NOT NULL" for k in keys))
    apply = hit & F.expr(where) if where else hit
    joined = old.join(new, on, "left")
    kept = joined.select(*(F.when(apply, F.expr(update[c])).otherwise(F.col(f"t.{c}")).alias(c) if c in update else F.col(f"t.{c}").alias(c) for c in table.columns))
    return insert(kept, new.join(old, on, "left_anti"))


def _on(keys: list[str], a: str, b: str) -> Column:
    return F.expr(" AND ".join(f"{a}.`{k}` = {b}.`{k}`" for k in keys))


def update(table: DataFrame, set_: dict[str, str], where: str = "true") -> DataFrame:
    hit = F.coalesce(F.expr(where), F.lit(False))
    return table.select(*(F.when(hit, F.expr(set_[c])).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in set_ else F.col(c) for c in table.columns))


def update_from(table: DataFrame, source: DataFrame, on: str, set_: dict[str, str], keys: list[str]) -> DataFrame:
    """UPDATE t SET ... FROM s WHERE on; of several matches the first by all of the source's columns wins, keys naming a row of the table."""
    j = table.alias("t").join(source.alias("s"), F.expr(on), "left")
    j = j.withColumn("__n", F.row_number().over(Window.partitionBy(*(F.col(f"t.{k}") for k in keys)).orderBy(*(F.col(f"s.{c}").asc_nulls_last() for c in source.columns)))).where("__n = 1")
    hit = F.coalesce(F.expr(on), F.lit(False))
    return j.select(*(F.when(hit, F.expr(set_[c])).otherwise(F.col(f"t.{c}")).alias(c) if c in set_ else F.col(f"t.{c}").alias(c) for c in table.columns))


def delete(table: DataFrame, where: str = "true") -> DataFrame:
    return table.where(~F.coalesce(F.expr(where), F.lit(False)))


def delete_using(table: DataFrame, source: DataFrame, on: str) -> DataFrame:
    return table.alias("t").join(source.alias("s"), F.expr(on), "left_anti")


def merge(table: DataFrame, source: DataFrame, on: str, matched: list[tuple[str, str | dict[str, str]]] = (), not_matched: list[tuple[str, dict[str, str] | None]] = (), not_matched_by_source: list[tuple[str, str | dict[str, str]]] = ()) -> DataFrame:
    """MERGE INTO table t USING source s ON on.

    Clauses are (condition, action), the first whose condition holds acts: a dict of column expressions updates (or inserts), "delete" deletes, "nothing" (None for inserts) leaves the row. One
    full outer join, so the cost is one shuffle of both sides.
    """
    t = table.withColumn("__t", F.lit(True)).alias("t")
    s = source.withColumn("__s", F.lit(True)).alias("s")
    j = t.join(s, F.expr(on), "full_outer")
    in_t, in_s = F.expr("t.__t IS NOT NULL"), F.expr("s.__s IS NOT NULL")
    action = F.lit(-1)
    plans: list[tuple] = []
    for side, clauses in ((in_t & in_s, matched), (~in_t & in_s, not_matched), (in_t & ~in_s, not_matched_by_source)):
        for cond, what in clauses:
            plans.append((side & F.expr(cond or "true"), what))
    chosen = None
    for k, (cond, _) in enumerate(plans):
        chosen = F.when(cond, k) if chosen is None else chosen.when(cond, k)
    j = j.withColumn("__a", chosen.otherwise(action) if chosen is not None else action)
    gone = [k for k, (_, w) in enumerate(plans) if w == "delete" or w is None]
    keep = ~F.col("__a").isin(*gone) if gone else F.lit(True)
    inserts = [k for k, (_, w) in enumerate(plans) if isinstance(w, dict)]
    j = j.where(keep & (in_t | F.col("__a").isin(*inserts)) if inserts else keep & in_t)
    cols = []
    for c in table.columns:
        value = None
        for k, (_, w) in enumerate(plans):
            if isinstance(w, dict) and c in w:
                value = F.when(F.col("__a") == k, F.expr(w[c])) if value is None else value.when(F.col("__a") == k, F.expr(w[c]))
        cols.append((value.otherwise(F.col(f"t.{c}")) if value is not None else F.col(f"t.{c}")).alias(c))
    return j.select(*cols)


def returning(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of after that before lacks, with their multiplicity."""
    return after.exceptAll(before)
