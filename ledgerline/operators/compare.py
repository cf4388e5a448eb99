"""Two-sided comparison: rows, counts, values, schemas, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has and the other lacks, multiplicities counted; ``side`` names the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def verdict(expected: Column, actual: Column) -> Column:
    """ok if equal, fail if not, skip if both are zero: nothing was compared."""
    return F.when((expected == 0) & (actual == 0), "skip").when(expected == actual, "ok").otherwise("fail")


def full_compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Status of each key: added, removed, changed or same, by a full outer join."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("in_left"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("in_right"))
    status = F.when(F.col("in_left").isNull(), "added").when(F.col("in_right").isNull(), "removed").when(F.col("left_value").eqNullSafe(F.col("right_value")), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, "left_value", "right_value", status.alias("status"))


def side_of(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values and whether both sides or one has them."""
    a = left.select(column).distinct().withColumn("l", F.lit(1))
    b = right.select(column).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "both").when(F.col("l").isNotNull(), "left").otherwise("right")
    return a.join(b, column, "full_outer").select(column, side.alias("side"))


def upsert_plan(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """What an incremental load does with each key, by content hash: new, changed, unchanged or deleted."""
    h = lambda d, n: d.select(key, F.sha2(F.col(content), 256).alias(n))
    met = h(old, "old_hash").join(h(new, "new_hash"), key, "full_outer")
    action = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return met.select(key, action.alias("action"))
