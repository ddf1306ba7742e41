"""Constraints as queries for the rows that break them; an empty result means that the constraint holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (without nulls) that occur more than once."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def primary_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    null = df.where(" OR ".join(f"`{k}` IS NULL" for k in keys)).select(*keys, F.lit(1).cast("long").alias("n"))
    return unique_violations(df, keys).unionByName(null)


def not_null_violations(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def check_violations(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is false; unknown passes."""
    return df.where(~F.expr(condition))


def foreign_key_violations(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    p = parent.select(F.col(parent_key).alias("__p")).distinct()
    return df.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("__p"), "left_anti")


@dataclass
class Constraint:
    """kind: primary, unique, not null, check or foreign; what: its columns, or the condition; parent: the table and columns that a foreign key names."""

    kind: str
    what: list[str] | str
    name: str
    parent: tuple[str, list[str]] | None = None

    def violations(self, df: DataFrame, table) -> DataFrame:
        """Rows of df that break it; table gives the DataFrame of a name."""
        if self.kind == "primary":
            return primary_key_violations(df, self.what)
        if self.kind == "unique":
            return unique_violations(df, self.what)
        if self.kind == "not null":
            return not_null_violations(df, self.what[0])
        if self.kind == "check":
            return check_violations(df, self.what)
        other, keys = self.parent
        mine = df.dropna(subset=self.what)
        there = table(other).select(*(F.col(k).alias(f"__k{n}") for n, k in enumerate(keys))).distinct()
        on = [mine[c] == there[f"__k{n}"] for n, c in enumerate(self.what)]
        return mine.join(there, on, "left_anti")


def enforce(name: str, df: DataFrame, constraints: list[Constraint], table) -> None:
    """Raises for the first constraint that a row of df breaks; one job a constraint."""
    for c in constraints:
        if not c.violations(df, table).isEmpty():
            raise ValueError(f"table {name} would break its {c.kind} constraint {c.name}")
