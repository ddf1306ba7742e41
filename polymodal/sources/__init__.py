"""Readers and writers: COPY text and CSV, Parquet, ORC and JSON tables, VALUES, and the catalog's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    r = spark.read.format(fmt).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    w = df.write.format(fmt).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def copy_from(spark: SparkSession, path: str, schema: str, fmt: str = "text", header: bool = False, delimiter: str | None = None, null: str | None = None) -> DataFrame:
    """COPY FROM: tab-separated text with \\N for null and backslash escapes, or CSV with empty unquoted fields for null. Both split over tasks."""
    if fmt == "text":
        return spark.read.csv(path, schema=schema, sep=delimiter or "\t", nullValue=null if null is not None else "\\N", quote="", escape="\\", header=header, mode="FAILFAST", emptyValue="")
    return spark.read.csv(path, schema=schema, sep=delimiter or ",", nullValue=null if null is not None else "", quote='"', escape='"', header=header, mode="FAILFAST")


def copy_to(df: DataFrame, path: str, fmt: str = "text", header: bool = False, delimiter: str | None = None, null: str | None = None, mode: str = "error") -> None:
    """COPY TO, a file a task."""
    if fmt == "text":
        df.write.mode(mode).csv(path, sep=delimiter or "\t", nullValue=null if null is not None else "\\N", quote="", escape="\\", header=header, emptyValue="")
    else:
        df.write.mode(mode).csv(path, sep=delimiter or ",", nullValue=null if null is not None else "", quote='"', escape='"', header=header, emptyValue='""')


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def information_schema_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame([("public", n, "BASE TABLE") for n in sorted(tables)], "table_schema string, table_name string, table_type string")


def information_schema_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [("public", n, f.name, k, f.dataType.simpleString(), "YES" if f.nullable else "NO") for n in sorted(tables) for k, f in enumerate(tables[n].schema.fields, 1)]
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")
