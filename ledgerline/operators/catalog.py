"""Catalogs of tables: columns as rows, shared columns, slices by name, inferred keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import text

BACKUP = r"(?i)bak|_back$|_backup$|_\d{6,8}$"  #: fixed value: names of backup and temporary tables
MOST_SHARED = 8


def scan(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, type): a row per column; only schemas are read."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string")


def shared_columns(columns: DataFrame, root) -> DataFrame:
    """(table_name, column_name, others): other tables that have a column of the same root, without backups."""
    a = columns.select("table_name", "column_name", root(F.col("column_name")).alias("root"))
    b = columns.where(~F.rlike("table_name", F.lit(BACKUP))).select(F.col("table_name").alias("other"), root(F.col("column_name")).alias("root")).distinct()
    return a.join(b, "root").where("table_name <> other").groupBy("table_name", "column_name").agg(text.listing(F.collect_set("other"), MOST_SHARED).alias("others"))


def named_like(columns: DataFrame, glob: str) -> DataFrame:
    """Columns of tables whose name matches a glob, whatever its case."""
    return columns.where(F.rlike("table_name", F.lit(text.glob_pattern(glob))))


def foreign_keys(columns: DataFrame, root) -> DataFrame:
    """(child, child_column, parent, key_column): columns that bear the root of another table's first column, the first such table."""
    keys = columns.where("position = 1").select(F.col("table_name").alias("parent"), F.col("column_name").alias("key_column"), root(F.col("column_name")).alias("root"))
    met = columns.where("position > 1").select(F.col("table_name").alias("child"), F.col("column_name").alias("child_column"), root(F.col("column_name")).alias("root")).join(keys, "root").where("child <> parent")
    return met.groupBy("child", "child_column").agg(F.min(F.struct("parent", "key_column")).alias("p")).select("child", "child_column", "p.parent", "p.key_column")
