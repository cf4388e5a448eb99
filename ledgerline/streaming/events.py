"""Structured Streaming over event records and log lines: first records, windows, sessions, calls, folded records, and upserts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ledgerline.operators import logs

DELAY = "1 hour"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the records of Parquet files, with the time as a timestamp."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path.replace(".parquet", "*.parquet"))
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def first_records(stream: DataFrame, key: list[str], delay: str = DELAY) -> DataFrame:
    """Each record once, late copies within the watermark dropped."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(key)


def windows(stream: DataFrame, length: str, slide: str | None = None, delay: str = DELAY) -> DataFrame:
    """Count and sum of values per window and type."""
    w = F.window("at", length, slide) if slide else F.window("at", length)
    return stream.withWatermark("at", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(stream: DataFrame, gap: str, delay: str = DELAY) -> DataFrame:
    """Records of a user with less than ``gap`` between them."""
    return stream.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def calls(stream: DataFrame) -> DataFrame:
    """(user_id, call, n): a click opens a call of its user, the next one ends it; open calls are state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        call, n = state.get if state.exists else (0, 0)
        rows = []
        for kind in pd.concat(list(batches)).sort_values("event_id")["event_type"]:
            if kind == "click":
                if call:
                    rows.append((key[0], call, n))
                call, n = call + 1, 0
            n += call > 0
        state.update((call, n))
        yield pd.DataFrame(rows, columns=["user_id", "call", "n"])

    return stream.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(step, "user_id long, call long, n long", "call long, n long", "append", GroupStateTimeout.NoTimeout)


def records(stream: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """(file, record, first, rest): log records folded from a stream of numbered lines, the open one of each file as state.

    A line without a header continues the record before it, in this batch or an earlier one; a record comes out when the
    next header of its file has been read.  A file's lines arrive in order of their numbers; state is one record a file.
    ``logs.parsed`` makes columns of them.
    """
    head = F.rlike(F.col(line), F.lit(logs.HEADER)).alias("head")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, rest = state.get if state.exists else (0, None, [])
        rows, rest = [], list(rest)
        lines = pd.concat(list(batches)).sort_values("number")
        for is_head, text in zip(lines["head"], lines["line"], strict=True):
            if is_head:
                if n:
                    rows.append((key[0], n, first, rest))
                n, first, rest = n + 1, text, []
            elif n:
                rest.append(text)
        state.update((n, first, rest))
        yield pd.DataFrame(rows, columns=["file", "record", "first", "rest"])

    rows = stream.select(F.col(file).alias("file"), F.col(number).cast("long").alias("number"), F.coalesce(F.col(line), F.lit("")).alias("line"), head)
    return rows.groupBy("file").applyInPandasWithState(step, "file string, record long, first string, rest array<string>", "n long, first string, rest array<string>", "append", GroupStateTimeout.NoTimeout)


def _folder(folder: str, name: str | None) -> str:
    return f"{folder}/streams/{name or uuid.uuid4().hex}"


def collected(stream: DataFrame, mode: str, folder: str, name: str | None = None) -> DataFrame:
    """What a stream has given for all that its source holds now; in complete mode each batch replaces the ones before.

    folder: a place that driver and executors share, for the checkpoint and the result.  A stream with a ``name`` resumes
    where its last run ended; without one, each call begins anew.  Every batch writes its own folder, named by its number, so a
    batch that is tried again replaces what it had written.
    """
    path, spark = _folder(folder, name), stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _batches(spark, f"{path}/out", stream.schema, mode == "complete")


def _batches(spark: SparkSession, path: str, schema: StructType, last: bool) -> DataFrame:
    """The rows of all batches, or of the last one; nothing if there has been none."""
    try:
        rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if last:  # read from the names of folders
        rows = rows.where(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0))
    return rows.drop("batch")


BUCKETS = 64


def upsert(stream: DataFrame, key: str, order: str, folder: str, name: str | None = None) -> DataFrame:
    """The newest record of each key, for all that the source holds now; a stream with a ``name`` resumes.

    State lies in ``BUCKETS`` by hash of the key, each bucket under the number of the batch that last changed it.  A batch reads
    and writes only the buckets of its own keys, and only reads what earlier batches wrote: tried again, it gives the same.
    """
    path, spark = _folder(folder, name), stream.sparkSession
    schema = StructType([*stream.schema.fields, StructField("batch", LongType()), StructField("bucket", LongType())])

    def current(before: int | None) -> DataFrame | None:
        try:
            rows = spark.read.schema(schema).parquet(f"{path}/state")
        except AnalysisException:
            return None
        rows = rows if before is None else rows.where(F.col("batch") < before)
        newest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))  # a row a bucket
        return rows.join(F.broadcast(newest), ["bucket", "batch"])

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
        old = current(number)
        if old is not None:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS numbers
            new = new.unionByName(old.where(F.col("bucket").isin(touched)).drop("batch"))
        best = new.groupBy(key).agg(F.max(order).alias(order))
        kept = new.join(best, [key, order], "left_semi").dropDuplicates([key])
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state/batch={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = current(None)
    return spark.createDataFrame([], stream.schema) if found is None else found.select(*stream.columns)
