"""Column profiles and value distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_VALUES = 30


def column_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct non-null values, nulls, rows."""
    c = F.col(column)
    return df.agg(F.count_distinct(c).alias("n_distinct"), F.sum(F.when(c.isNull(), 1).otherwise(0)).cast("long").alias("n_null"), F.count("*").alias("n_rows"))


def value_distribution(df: DataFrame, column: str, most: int = MOST_VALUES) -> DataFrame:
    """Rows per value, most frequent first, nulls last; empty if there are more than ``most`` distinct values."""
    n = df.agg(F.count_distinct(column).alias("d"))
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(n)).where(F.col("d") <= most).drop("d").orderBy(F.desc("n"), F.col("value").asc_nulls_last()).limit(most)


def ranked_references(edges: DataFrame, key: str) -> DataFrame:
    """References per key, most referenced first."""
    return edges.groupBy(key).agg(F.count("*").alias("n_refs")).orderBy(F.desc("n_refs"), F.asc(key))
