"""A versioned catalog of sources: a refresh reads only those that have changed, and drops those that are gone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.lineage import kept

MARKS = ("size", "changed_at", "hash")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, changed_at, hash) of the files below ``path`` whose names match; no content is read, the hash is null; Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed_at"), F.lit(None).cast("string").alias("hash"))


def contents(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(path, text) of listed files; their names, not their content, pass through the driver, as in any listing."""
    paths = [r["path"] for r in sources.select("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "path string, text string")
    return spark.read.format("binaryFile").load(paths).select("path", F.col("content").cast("string").alias("text"))


def current(spark: SparkSession, folder: str) -> tuple[int, DataFrame | None]:
    """The last version's number, 0 if there is none, and its rows."""
    try:
        rows = spark.read.parquet(folder)
    except AnalysisException:
        return 0, None
    last = rows.agg(F.max("version")).first()[0]
    if last is None:
        return 0, None
    return int(last), spark.read.parquet(f"{folder}/version={last}")


def refresh(sources: DataFrame, read: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """The catalog of ``sources`` (path, size, changed_at, hash), as a new version below ``folder`` if anything differs.

    ``read`` gets the sources that are new or whose size, time or hash differs, and returns a row each, with ``path`` and columns
    of its own, the same each time.  Rows of unchanged sources are taken from the last version.  A version is written once and not
    changed after; a refresh that fails leaves the last one.  Each path is listed once; null marks are equal to each other.
    """
    spark = sources.sparkSession
    number, old = current(spark, folder)
    listed = kept(sources.select("path", *MARKS))
    same = F.col("l.path") == F.col("o.path")
    for m in MARKS:
        same = same & F.col(f"l.{m}").eqNullSafe(F.col(f"o.{m}"))
    if old is None:
        stale, stay = listed, None
    else:
        stale = kept(listed.alias("l").join(old.select("path", *MARKS).alias("o"), same, "left_anti"))
        stay = old.alias("o").join(listed.alias("l"), same, "left_semi")
        if stale.isEmpty() and stay.count() == old.count():
            return old
    found = stale.join(read(stale), "path").withColumn("read_in", F.lit(number + 1))
    whole = found if stay is None else stay.select(found.columns).unionByName(found)
    path = f"{folder}/version={number + 1}"
    whole.write.mode("overwrite").parquet(path)
    return spark.read.schema(whole.schema).parquet(path)
