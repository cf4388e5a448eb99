"""Shared helpers: tables cut from their lineage, batch tokenising and hashing, components of a graph.

Texts are handled as whole Arrow batches of UTF-8 bytes: lower-casing touches A-Z only, tokens are maximal runs of
bytes outside ``\\x20 \\x09-\\x0D`` and never cross a text's end, and every token gets a 64-bit hash.  A hash stands for
its token everywhere; among 10**9 distinct tokens a collision is expected about 0.03 times.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.shared import shared_dir

U = np.uint64
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
CHUNK_BYTES = 1 << 18  #: bytes of text that are hashed at once; a longer text is a chunk of its own

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_powers: list[np.ndarray] = []


def lean(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session held to ``BATCH_ROWS`` rows and ``BATCH_BYTES``: texts may be long.

    The settings stay for the session, since plans run after they are made; smaller batches change no result.
    """
    conf = df.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: short lineage, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``rows`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if is_small(df, rows) else df


def hot_join(rows: DataFrame, table: DataFrame, key: str, parts: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key``, where one key may hold a third of ``rows``.

    Keys with more than 1/``parts`` of the rows, fewer than ``parts`` of them, meet their row by broadcast; only the rest
    shuffles.  A null key meets nothing.
    """
    count = rows.groupBy(key).agg(F.count("*").alias("c")).where(F.col(key).isNotNull())
    hot = count.where(F.col("c") * parts > rows.count()).select(key)
    hot = F.broadcast(cut(table.join(F.broadcast(hot), key)))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(table, key))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[U(1)], np.cumprod(np.full(size - 1, base, dtype=U))]) for base in (U(_R), U(_RINV))]
    return _powers


def mix64(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(32))
        h = h * U(0xD6E8FEB86659FD93)
        h ^= h >> U(29)
        h = h * U(0xA0761D6478BD642F)
        return h ^ (h >> U(32))


class Tokens:
    """Tokens of consecutive texts: ``hash`` per token; texts ``first .. first+len(bounds)-2`` own tokens ``bounds[i]:bounds[i+1]``."""

    __slots__ = ("bounds", "buf", "ends", "first", "hash", "raw", "starts", "total")

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray):
        self.first = first
        n = len(buf)
        low = _LOWER[buf]
        word = _WORD[low]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        at = offsets[:-1][offsets[:-1] < n]
        begin[at] = word[at]
        self.starts = np.flatnonzero(begin)
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        stop[last] = word[last]
        self.ends = np.flatnonzero(stop) + 1
        self.buf, self.raw = low, buf
        self.bounds = np.searchsorted(self.starts, offsets)
        up, down = _power_tables(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=U)
            np.cumsum((low.astype(U) + U(1)) * up[:n], out=total[1:])
            self.total = total
            h = (total[self.ends] - total[self.starts]) * down[self.starts]
            self.hash = mix64(h + (self.ends - self.starts).astype(U) * U(0xC2B2AE3D27D4EB4F))

    def powers(self) -> list[np.ndarray]:
        return _power_tables(len(self.buf) + 1)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    buf, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def tokens(column: pa.Array) -> Iterator[Tokens]:
    for first, _, buf, offsets in chunks(column):
        yield Tokens(first, buf, offsets)


def crc_mod(column: str, n: int):
    """crc32 of the id written as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b: longs); label is the smallest node of its component.

    Alternates large-star and small-star rounds until nothing changes (Kiveris et al., 2014).  Every step is a
    pre-aggregated minimum and an equi-join, so a node with very many edges is split by adaptive execution.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


class KeyFilter:
    """A Bloom filter of at most ``most_bits`` bits over the longs of a column; built on executors, merged by segment.

    ``has`` never misses a key; beyond the bound it says yes more often, which costs time and changes no result.
    """

    HASHES = 3

    def __init__(self, keys: DataFrame, bits_per_key: int = 16, most_bits: int = 1 << 27):
        """keys: one column of longs, a null counts as 0."""
        name = keys.columns[0]
        keys = keys.select(F.coalesce(F.col(name), F.lit(0)).cast("long").alias("key"))
        bits = min(most_bits, max(1 << 16, 1 << (max(keys.count(), 1) * bits_per_key - 1).bit_length()))
        self.bits = bits

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine: dict[int, np.ndarray] = {}
            for b in batches:
                at = KeyFilter._places(b.column("key").to_numpy(), bits).ravel()
                seg = at >> 16
                for s in np.unique(seg):
                    mine.setdefault(int(s), np.zeros(1 << 16, dtype=bool))[at[seg == s] & 65535] = True
            if mine:
                yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.int64()), pa.array([np.packbits(x).tobytes() for x in mine.values()], pa.binary())], ["segment", "bits"])

        def merge(pdf):
            return pdf.iloc[:1].assign(bits=[np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]]).tobytes()])

        found = lean(keys).mapInArrow(local, "segment long, bits binary").groupBy("segment").applyInPandas(merge, "segment long, bits binary")
        whole = np.zeros(bits // 8, dtype=np.uint8)
        for r in found.toLocalIterator():
            whole[r["segment"] << 13 : (r["segment"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(whole)

    @staticmethod
    def _places(keys: np.ndarray, bits: int) -> np.ndarray:
        h = mix64(keys.astype(np.int64).view(U))
        with np.errstate(over="ignore"):
            step = mix64(h ^ U(0xA24BAED4963EE407)) | U(1)
            return np.stack([((h + U(i) * step) & U(bits - 1)).astype(np.int64) for i in range(KeyFilter.HASHES)])

    def __getstate__(self):
        return {"bits": self.bits, "shared": self.shared}

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys, self.bits)
        return ((self.shared.value[at >> 3] >> (7 - (at & 7))) & 1).all(axis=0).astype(bool)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone`` (one column of longs); only possible matches are shuffled."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    known = KeyFilter(gone)

    @F.pandas_udf("boolean")
    def maybe(x):
        import pandas as pd

        return pd.Series(known.has(x.to_numpy()))

    name = f"_maybe_{uuid.uuid4().hex}"
    seen = lean(docs).withColumn(name, maybe(key))
    gone = gone.select(F.col(gone.columns[0]).alias(f"{name}_id")).distinct()
    return seen.where(~F.col(name)).unionByName(seen.where(name).join(gone, F.col("doc_id").cast("long") == F.col(f"{name}_id"), "left_anti")).drop(name)
