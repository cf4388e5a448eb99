"""Exact deduplication by two passes of a Bloom filter.

Pass 1 counts, for every bit position of a shared filter, whether one or more rows hash to it.  Pass 2 asks for every
row whether all its positions were hit more than once; a row for which one wasn't is certainly unique and passes
straight through.  Only the remaining rows (repeated ones and a few false alarms) are shuffled by digest.

Cases: a null text counts as empty; equal means equal bytes after lower-casing A-Z; a null doc_id sorts below every
other; of repeated rows with the same doc_id and text exactly one is kept; an empty table gives an empty result; extra
columns of the input, whatever their names, are passed over (``digests``) or kept (``drop_copies``).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, hot_join, KeyFilter, lean, U

HASHES = 2  #: bit positions of a row
BITS_PER_ROW = 16
MOST_BITS = 1 << 28  #: of the filter that is broadcast (32 MB); beyond it false alarms grow, results don't change
SEGMENT = 1 << 16


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, sha): the SHA-256 of each normalised text, and a number for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            sha = [hashlib.sha256(normalise(t)).digest() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.arange(row, row + len(sha))), pa.array(sha, pa.binary())], ["doc_id", "row", "sha"])
            row += len(sha)

    return lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, row long, sha binary")


def _positions(sha: pa.Array, bits: int) -> np.ndarray:
    """HASHES positions for each digest, shape (rows, HASHES)."""
    words = np.frombuffer(b"".join(x[: 8 * HASHES] for x in sha.to_pylist()), dtype="<u8").reshape(-1, HASHES)
    return words & U(bits - 1)


def repeated_positions(marks: DataFrame, bits: int) -> dict[int, bytes]:
    """Pass 1: the filter's segments (bitmaps of SEGMENT positions) that have positions hit by more than one row."""
    per = min(SEGMENT, bits)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            p, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            seg = (p // U(per)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(seg)) + 1
            off, many = (p % U(per)).astype(np.uint16), n > 1
            parts = list(zip(np.split(off, cuts), np.split(many, cuts), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(seg[np.concatenate([[0], cuts])]), pa.array([o[~m].tobytes() for o, m in parts], pa.binary()), pa.array([o[m].tobytes() for o, m in parts], pa.binary())], ["segment", "once", "more"])

        n = 0
        for b in batches:
            if b.num_rows:
                held.append(_positions(b.column("sha"), bits).ravel())
                n += b.num_rows
            if n > 1 << 20:
                yield flush()
                n = 0
        if held:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(per, dtype=np.uint8)
        for once, more in zip(pdf["once"], pdf["more"], strict=True):
            at = np.frombuffer(once, np.uint16)
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(more, np.uint16)] = 2
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "bits": [np.packbits(count == 2).tobytes()]})

    found = marks.mapInArrow(local, "segment long, once binary, more binary").groupBy("segment").applyInPandas(merge, "segment long, bits binary")
    return {r["segment"]: bytes(r["bits"]) for r in found.toLocalIterator()}  # at most bits / 8 bytes in all


def _bitmap(bits: int, per: int, segments: dict[int, bytes]) -> np.ndarray:
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for seg, b in segments.items():
        bitmap[seg * per // 8 : (seg * per + per) // 8] = np.frombuffer(b, np.uint8)
    return bitmap


def _hit(bitmap: np.ndarray, sha: pa.Array, bits: int) -> np.ndarray:
    p = _positions(sha, bits).astype(np.int64)
    return ((bitmap[p >> 3] >> (7 - (p & 7))) & 1).all(axis=1).astype(bool)


def suspects(marks: DataFrame, bits: int, filter_: dict[int, bytes]) -> DataFrame:
    """Pass 2: ``marks`` with ``suspect``, false where a row is certainly the only one of its digest."""
    per = min(SEGMENT, bits)
    shared = marks.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = _bitmap(bits, per, shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_hit(bitmap, b.column("sha"), bits))], [*b.schema.names, "suspect"])

    return marks.mapInArrow(run, "doc_id long, row long, sha binary, suspect boolean")


def _bits(rows: int) -> int:
    return min(MOST_BITS, max(1 << 10, 1 << (max(rows, 1) * BITS_PER_ROW - 1).bit_length()))


def _best(some: DataFrame) -> DataFrame:
    """Of each digest the row that stays: largest doc_id (null lowest), then largest row number."""
    return some.groupBy("sha").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("is"), "doc_id", "row")).alias("best"), F.count("*").alias("group_size"))


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, row, sha, keep_id, group_size, kept) for each row of ``docs``."""
    marks = cut(digests(docs))
    bits = _bits(marks.count())
    asked = cut(suspects(marks, bits, repeated_positions(marks, bits)))
    some, single = asked.where("suspect"), asked.where("not suspect")
    best = cut(_best(some).select("sha", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"))
    some = hot_join(some, best, "sha").select("doc_id", "row", "sha", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    return some.union(single.select("doc_id", "row", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row repeats; the row with the largest doc_id stays, once.

    Of a group of copies only the row that stays is shuffled, whatever the group's size: the others miss a filter of the
    digests and ids of rows that stay.
    """
    marks = cut(digests(docs))
    bits = _bits(marks.count())
    filter_ = repeated_positions(marks, bits)
    name = f"_look_{uuid.uuid4().hex}"
    best = _best(suspects(marks, bits, filter_).where("suspect"))
    best = cut(best.select(F.col("sha").alias(f"{name}_sha"), F.col("best.doc_id").alias(f"{name}_keep")))
    key = F.conv(F.substring(F.hex(f"{name}_sha"), 1, 15), 16, 10).cast("long").bitwiseXOR(F.coalesce(f"{name}_keep", F.lit(-1)))
    stays = KeyFilter(best.select(key))
    shared = docs.sparkSession.sparkContext.broadcast(filter_)
    per = min(SEGMENT, bits)

    @F.pandas_udf("suspect boolean, stays boolean, sha binary")
    def look(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        bitmap = _bitmap(bits, per, shared.value)
        for t, i in parts:
            sha = [hashlib.sha256(normalise(x)).digest() for x in t]
            first = np.frombuffer(b"".join(x[:8] for x in sha), dtype=">u8") >> U(4)  # 60 bits, as in ``key``
            yield pd.DataFrame({"suspect": _hit(bitmap, pa.array(sha, pa.binary()), bits), "stays": stays.has(first.astype(np.int64) ^ i.to_numpy(np.int64)), "sha": sha})

    # each Python evaluation of a task keeps a worker of its own: one pass, which the optimizer must not repeat for the filters
    doc_id = F.col("doc_id").cast("long")
    seen = lean(docs).withColumn(name, look.asNondeterministic()(F.col("text").cast("string"), F.coalesce(doc_id, F.lit(-1))))
    sha = F.col(f"{name}.sha")
    some = seen.where(F.col(f"{name}.suspect") & F.col(f"{name}.stays"))
    stay = some.join(best, (sha == F.col(f"{name}_sha")) & doc_id.eqNullSafe(F.col(f"{name}_keep")), "left_semi")
    stay = stay.withColumn(name, sha).dropDuplicates([name, "doc_id"])
    return seen.where(~F.col(f"{name}.suspect")).drop(name).unionByName(stay.drop(name))
