"""Referential integrity: orphans and inferred keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose key is set and has no parent."""
    return child.where(F.col(foreign_key).isNotNull()).join(parent.select(F.col(key).alias("_key")), F.col(foreign_key) == F.col("_key"), "left_anti")


def orphan_summary(probes: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(relation, n_orphans) for (name, child, foreign key, parent, key) probes; each a distributed count."""
    parts = [orphans(c, fk, p, k).agg(F.count("*").alias("n_orphans")).select(F.lit(name).alias("relation"), "n_orphans") for name, c, fk, p, k in probes]
    return reduce(DataFrame.unionByName, parts)


def infer_foreign_keys(columns: DataFrame, keys: DataFrame, least_root: int = 4) -> DataFrame:
    """Child columns that name a parent's key, exactly or after the table prefix ``x_`` is stripped (roots of some length).

    columns: (table_name, column_name); keys: (parent, key_column).
    """
    root = lambda c: F.regexp_replace(F.lower(c), "^[a-z]+_", "")
    a = columns.withColumn("root", root(F.col("column_name")))
    b = keys.withColumn("root", root(F.col("key_column"))).withColumnRenamed("root", "key_root")
    met = a.join(F.broadcast(b), (F.col("root") == F.col("key_root")) & (F.col("table_name") != F.col("parent")) & (F.length("root") >= least_root))
    return met.select("table_name", "column_name", "parent", "key_column")
