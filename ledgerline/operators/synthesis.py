"""Test rows under keys: parents first, foreign keys drawn from rows that exist, unique values by bijections on row numbers.

Every value follows from the seed, the table, the column and the row's number, so rows are made where they are written, and a
task that is run again makes the same ones.  No key is checked for collisions: unique columns are one-to-one in the row number.
A foreign key to made rows is computed, with no join; one to rows that exist already meets them by their number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import ordered

LEAST_KEY = 900_000  #: fixed value: made keys lie above it and above those in use
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Made:
    """A made column.  kind: key, unique_text, parent, existing, code, day, number, text, flag or fixed; the rest is what the kind needs."""

    name: str
    kind: str
    table: str = ""  #: parent: the made table
    rows: DataFrame | None = field(default=None, compare=False)  #: existing: the table that holds the keys; key: keys in use
    column: str = ""  #: parent, existing, key: the key column
    values: tuple = ()  #: code: values; fixed: the value; flag: the two values
    least: float = 0  #: number: lower end; day: first day's offset
    most: float = 1  #: number: upper end, not reached; day: days
    digits: int = 0  #: number: decimal places
    length: int = 12  #: unique_text, text: most characters
    prefix: str = ""  #: unique_text, text
    nulls: int = 0  #: percent of rows without a value; never in keys


def _step(n: int, seed: int) -> int:
    """A multiplier without a common factor with ``n``, so that i * step mod n is one-to-one."""
    step = (seed * 2 + 1) % max(n, 1) or 1
    while math.gcd(step, n) != 1:
        step += 1
    return step


def _draw(seed: int, table: str, name: str, n: int, row: Column) -> Column:
    """A number below ``n`` from the row's number."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(table), F.lit(name), row), F.lit(n))


def _permuted(n: int, seed: int, row: Column) -> Column:
    """The row's number, moved one-to-one; exact for n below 3 * 10**9."""
    return F.pmod(row * _step(n, seed) + seed % max(n, 1), F.lit(max(n, 1)))


class Maker:
    """Makes tables in the order of their keys: a parent before what refers to it."""

    def __init__(self, spark: SparkSession, seed: int = 1):
        self.spark, self.seed = spark, seed
        self.keys: dict[tuple[str, str], tuple[int, int]] = {}  # (table, key): first key less one, rows

    def table(self, name: str, n: int, columns: list[Made]) -> DataFrame:
        """``n`` rows; an unknown parent, one without rows or a text too short for ``n`` values is an error."""
        if n >= 3_000_000_000:
            raise ValueError("at most 3 * 10**9 rows a table")
        out = self.spark.range(n).withColumnRenamed("id", "_row")
        for c in columns:
            out = self._with(out, name, n, c)
        return out.select(*[c.name for c in columns])

    def _with(self, df: DataFrame, table: str, n: int, c: Made) -> DataFrame:
        row, draw = F.col("_row"), lambda m: _draw(self.seed, table, c.name, m, F.col("_row"))
        if c.kind == "key":
            used = c.rows.agg(F.max(c.column or c.name)).first()[0] if c.rows is not None else None
            base = max(int(used or 0), LEAST_KEY)
            self.keys[table, c.name] = (base, n)
            return df.withColumn(c.name, F.lit(base) + 1 + _permuted(n, self.seed, row))
        if c.kind == "unique_text":
            width = c.length - len(c.prefix)
            if width < 1 or len(DIGITS) ** width < n:
                raise ValueError(f"{c.name}: {c.length} characters don't hold {n} values")
            number = F.lower(F.conv(_permuted(n, self.seed, row).cast("string"), 10, len(DIGITS)))
            need = max(1, math.ceil(math.log(max(n, 2), len(DIGITS)) + 1e-9))
            return df.withColumn(c.name, F.concat(F.lit(c.prefix), F.lpad(number, min(width, need), "0")))
        if c.kind == "existing":
            parents = ordered.ranked(c.rows.where(F.col(c.column).isNotNull()).select(c.column).distinct(), [], [c.column], "_number")
            m = parents.count()
            if not m:
                raise ValueError(f"{c.name}: no row to refer to")
            met = df.withColumn("_number", draw(m) + 1).join(parents.withColumnRenamed(c.column, f"_parent_{c.name}"), "_number").drop("_number")
            return met.withColumn(c.name, self._null(table, c, F.col(f"_parent_{c.name}")))
        if c.kind == "parent":
            if not self.keys.get((c.table, c.column), (0, 0))[1]:
                raise ValueError(f"{c.name}: {c.table}.{c.column} has not been made")
            base, m = self.keys[c.table, c.column]
            value = F.lit(base) + 1 + draw(m)
        elif c.kind == "code":
            value = F.element_at(F.array(*[F.lit(v) for v in c.values]), (draw(len(c.values)) + 1).cast("int"))
        elif c.kind == "day":
            value = F.date_add(F.lit(c.values[0]).cast("date"), (F.lit(int(c.least)) + draw(int(c.most))).cast("int"))
        elif c.kind == "number":
            cells = int(round((c.most - c.least) * 10**c.digits))
            value = F.round(F.lit(c.least) + draw(cells) / 10**c.digits, c.digits) if c.digits else (F.lit(int(c.least)) + draw(cells))
        elif c.kind == "text":
            value = F.substring(F.concat(F.lit(c.prefix), F.lower(F.hex(draw(1 << 60)))), 1, c.length)
        elif c.kind == "flag":
            value = F.when(draw(2) == 0, F.lit(c.values[0])).otherwise(F.lit(c.values[1]))
        elif c.kind == "fixed":
            value = F.lit(c.values[0])
        else:
            raise ValueError(f"{c.name}: unknown kind {c.kind}")
        return df.withColumn(c.name, self._null(table, c, value))

    def _null(self, table: str, c: Made, value: Column) -> Column:
        return F.when(_draw(self.seed, table, f"{c.name} null", 100, F.col("_row")) >= c.nulls, value) if c.nulls else value


def key_faults(df: DataFrame, key: list[str], parents: dict[str, DataFrame]) -> DataFrame:
    """(n_rows, n_repeated, n_orphans): rows, rows beyond the first of their key, foreign keys without their row (column: its keys)."""
    sums = df.groupBy(*key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_repeated"))
    lost = df.sparkSession.range(0).select(F.lit(0).alias("x"))
    for column, keys in parents.items():
        asked = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_k"))
        lost = lost.union(asked.join(keys.select(F.col(keys.columns[0]).alias("_k")).distinct(), "_k", "left_anti").select(F.lit(1)))
    return sums.crossJoin(F.broadcast(lost.agg(F.count("*").alias("n_orphans"))))  # one row each
