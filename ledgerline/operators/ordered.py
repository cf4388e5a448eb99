"""Running values over long sequences without gathering one in a task: rows lie in ranges of their order, ends are carried.

A group's rows may fill many ranges.  Values run inside each range, and what a group brings along from the ranges before is one
row a range at most, since only the group at a range's start can have begun before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators.lineage import kept


def in_ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` written in ranges of (by, order), with ``_part`` and ``_pos`` that ascend in this order; nulls come first.

    Rows alike in all of these columns lie in one range, in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    return kept(rows.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()))


def running(ranged: DataFrame, by: list[str], name: str, value: Column, how: str = "sum") -> DataFrame:
    """``ranged`` with column ``name``: the sum of ``value`` up to each row of its group, or the last one that is not null."""
    rows = ranged.withColumn("_value", value)
    add = how == "sum"
    pick = F.sum if add else lambda c: F.last(c, ignorenulls=True)
    end = F.sum("_value") if add else F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_pos")))
    ends = rows.groupBy("_part", *by).agg(end.alias("_end"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_carry", pick("_end").over(before)).where("_carry IS NOT NULL").select(F.col("_part").alias("_at"), *[F.col(b).alias(f"_by_{b}") for b in by], "_carry")
    same = F.col("_part") == F.col("_at")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    inside = Window.partitionBy("_part", *by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_inner", pick("_value").over(inside)).join(F.broadcast(carry), same, "left")  # a row a range at most
    out = F.coalesce("_inner", F.lit(0)) + F.coalesce("_carry", F.lit(0)) if add else F.coalesce("_inner", "_carry")
    return met.select(*ranged.columns, out.alias(name))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's number in its group, from 1."""
    rows = running(in_ranges(df, by, order), by, name, F.lit(1))
    return rows.select(*df.columns, name)


def nearest_mark(lines: DataFrame, file: str, number: str, line: str, mark: str, barrier: str, most: int = 17) -> DataFrame:
    """(file, number, mark): for each line the first group of the pattern ``mark`` on it or on the nearest line above.

    The search ends at a line that matches ``barrier`` and no mark, or after ``most`` lines; then the mark is null.  Line numbers
    are unique in a file; a null line is empty.
    """
    text = F.coalesce(F.col(line), F.lit(""))
    found = F.when(F.rlike(text, F.lit(mark)), F.regexp_extract(text, mark, 1))
    event = F.when(found.isNotNull() | F.rlike(text, F.lit(barrier)), F.struct(F.col(number).alias("at"), found.alias("mark")))
    # a line's own text is read for marks, not for barriers: those hold for the lines below
    ranged = in_ranges(lines.select(file, number, event.alias("_event"), found.alias("_own")), [file], [number])
    below = ranged.select(file, F.lit(1).alias("_kind"), F.col(number).alias("_line"), "_event", F.lit(None).cast("string").alias("_own"))
    asked = ranged.select(file, F.lit(0).alias("_kind"), F.col(number).alias("_line"), F.lit(None).cast(ranged.schema["_event"].dataType).alias("_event"), "_own")
    both = running(in_ranges(below.unionByName(asked), [file], ["_line", "_kind"]), [file], "_last", F.col("_event"), "last")
    above = F.when(F.col("_line") - F.col("_last.at") < most, F.col("_last.mark"))
    return both.where("_kind = 0").select(file, F.col("_line").alias(number), F.coalesce("_own", above).alias("mark"))
