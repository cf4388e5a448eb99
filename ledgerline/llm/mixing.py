"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets: sources share the total size in proportion to their weights; a source whose share exceeds ``epochs`` times its
size is clamped there and the excess is shared by weight among the others, until none exceeds its cap.  A source then
takes ``floor(target / size)`` whole repetitions of every document, and for the fraction left the documents that come
first in a seeded hash order; the one at the edge is taken in part, so that each source meets its target to the word.

The hash order is summed in buckets (about the square root of the rows in number), and only the bucket at the edge of a
source is summed row by row; no source, however large, meets in one task.

Cases: size is the number of runs outside ``\\x20 \\x09-\\x0D``, 0 for a null or blank text; a null source is a source of
its own, last in order; rows alike in every column are taken as separate documents; a source of size 0 gets target 0; an
empty table gives an empty result; extra columns are passed over or kept (``mixed``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import bounded_broadcast, cut

EPOCHS = 3
SEED = 20240229
WORD = r"[^\x20\x09-\x0D]+"
MOST_SOURCES = 10_000  #: sources that are broadcast; more are joined by a shuffle


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _rank(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last, by range partitions and their counts."""
    ranged = cut(sources.repartitionByRange(16, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))).select("part", "base")
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return ranged.join(F.broadcast(parts), "part").withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).drop("part", "base")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filling; only sums over sources reach the driver."""
    ranked = _rank(sizes)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = cut(ranked.select("source", "source_size", w.alias("weight")))
    cap = F.col("source_size") * F.lit(float(epochs))
    all_of = ranked.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    level = (all_of["t"] or 0) / (all_of["w"] or 1.0)
    while True:
        full = F.lit(level) * F.col("weight") >= cap
        s = ranked.agg(F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        new = ((all_of["t"] or 0) - (s["held"] or 0.0)) / s["free"] if s["free"] else level
        if not s["free"] or new <= level:
            break
        level = new  # grows: each turn clamps further sources or ends
    return ranked.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def takes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, taken) for each row of ``docs``; key: the text's hash."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("key"))
    rows = cut(rows.withColumn("at", F.xxhash64(F.lit(seed), "doc_id", "key")))
    buckets = max(1, int(rows.count() ** 0.5))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("at", 24), F.lit(buckets)))
    sums = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("s")))
    goal = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = cut(goal.withColumn("whole", whole).withColumn("rest", (F.round("target") - F.col("whole") * F.col("source_size")).cast("long")))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    # the bucket where a source's running sum first exceeds what is left of its target
    up_to = Window.partitionBy("source").orderBy("bucket")
    run = sums.withColumn("upto", F.sum("s").over(up_to)).alias("r")
    edge = run.join(bounded_broadcast(goal, MOST_SOURCES).alias("g"), same("r", "g")).where("r.upto > g.rest")
    edge = edge.groupBy("g.source").agg(F.min(F.struct("r.bucket", (F.col("g.rest") - F.col("r.upto") + F.col("r.s")).alias("left"))).alias("e"))
    e = edge.select(F.col("source"), F.col("e.bucket").alias("edge"), F.col("e.left").alias("left")).alias("e")
    plan = cut(goal.alias("g").join(e, same("g", "e"), "left").select("g.source", "source_size", "target", "whole", "rest", "edge", "left"))
    plan = bounded_broadcast(plan, MOST_SOURCES).alias("p")
    met = rows.alias("d").join(plan, same("d", "p"), "left").select("d.*", "source_size", "target", "whole", "edge", "left")
    out = ["doc_id", "key", "source", "size", "source_size", "target"]
    # without an edge the whole source fits in what is left
    before = F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))
    far = met.where("edge is null or bucket <> edge").select(*out, (F.col("whole") * F.col("size") + F.when(before, F.col("size")).otherwise(F.lit(0))).alias("taken"))
    inside = Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    near = met.where("bucket = edge").withColumn("prior", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("prior")))
    near = near.select(*out, (F.col("whole") * F.col("size") + part).alias("taken"))
    return far.union(near)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each whole repetition is a row, and of a part of a document its first words.

    Rows that share doc_id, text and source share evenly what is taken of them all, each rounded up, so that such a group
    may give up to one word a row more than its part.
    """
    mine = takes(docs, weights, epochs, seed).where("taken > 0").groupBy("doc_id", "key", "source").agg(F.ceil(F.sum("taken") / F.count("*")).cast("long").alias("taken"), F.max("size").alias("size"))
    name = f"_mix_{uuid.uuid4().hex}"
    mine = cut(mine).select(F.struct("doc_id", "key", "source", "taken", "size").alias(name))
    mix = lambda field: F.col(f"{name}.{field}")
    d, text = docs.alias("d"), F.col("d.text").cast("string")
    met = d.join(mine, F.col("d.doc_id").cast("long").eqNullSafe(mix("doc_id")) & (F.xxhash64(text) == mix("key")) & F.col("d.source").cast("string").eqNullSafe(mix("source")))
    times = F.ceil(mix("taken") / mix("size")).cast("int")
    copies = met.select("d.*", name, F.explode(F.sequence(F.lit(1), times)).alias(f"{name}_copy"))
    left = mix("taken") - (F.col(f"{name}_copy") - 1) * mix("size")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), left.cast("int")), "")
    return copies.withColumn("text", F.when(left >= mix("size"), F.col("text")).otherwise(first)).drop(name, f"{name}_copy")
