"""Nearest vectors by squared Euclidean distance, or those of the same label: every query against every vector, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1024  #: vectors, and queries, that are compared at once
CELLS = 48  #: of the grid of a lookup at least, so that they even out over tasks
BATCH_BYTES = 8 << 20  #: of blocks beside blocks that a task reads at once
EDGE = 1e-5  #: distances so near to the farthest one, relatively, are rounded before they are compared


def _blocks(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(keys, matrix): blocks of at most BLOCK vectors of one length, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, list] = {}
            for k, v in zip(b.column("k").to_pylist(), b.column("v").to_pylist(), strict=True):
                if v is not None and None not in v:
                    by.setdefault(len(v), []).append((k, v))
            for size, rows in by.items():
                for at in range(0, len(rows), BLOCK):
                    part = rows[at : at + BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([np.array([k for k, _ in part], np.int64).tobytes()]), pa.array([np.array([v for _, v in part], np.float64).tobytes()])], ["size", "keys", "matrix"])

    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(embedding).cast("array<double>").alias("v")).where("k is not null")
    return rows.mapInArrow(run, "size int, keys binary, matrix binary")


def _grid(cells: int, n_vectors: int, n_queries: int) -> tuple[int, int]:
    """(across, down) of about ``cells`` cells: vectors go to ``across`` of them, queries to ``down``; no more than there are blocks."""
    across = max(1, round((cells * max(n_queries, 1) / max(n_vectors, 1)) ** 0.5))
    across = min(across, max(1, -(-n_queries // BLOCK)))
    return across, min(max(1, -(-cells // across)), max(1, -(-n_vectors // BLOCK)))


def _met(b: DataFrame, q: DataFrame, n_vectors: int, n_queries: int, same: list[str], cells: int = 1) -> DataFrame:
    """Each block of ``b`` beside each of ``q`` that is alike in ``same``, once, in a grid of ``cells`` at least."""
    across, down = _grid(max(cells, int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))), n_vectors, n_queries)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    b = b.withColumn("row", F.pmod(F.xxhash64("keys"), F.lit(down)).cast("int")).withColumn("column", each(across))
    q = q.withColumn("column", F.pmod(F.xxhash64("qkeys"), F.lit(across)).cast("int")).withColumn("row", each(down))
    return b.join(q, [*same, "row", "column"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int | None, farthest: float | None = None, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, vec_id, distance): the ``k`` nearest of each query, those within ``farthest``, or both.

    Blocks of vectors meet blocks of queries in a grid: each side is dealt into rows or columns by its keys and goes once to each
    of the other side's, with as many rows and columns as move least in all; of a pair of blocks only what is near enough, at
    most ``k`` a query, leaves its task.
    """
    q = _blocks(queries, key, embedding).select("size", F.col("keys").alias("qkeys"), F.col("matrix").alias("qmatrix"))
    met = _met(_blocks(vectors, key, embedding), q, vectors.count(), queries.count(), ["size"]).select("size", "keys", "matrix", "qkeys", "qmatrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, qkeys = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["qkeys"], np.int64)
                x, y = np.frombuffer(r["matrix"]).reshape(len(keys), -1), np.frombuffer(r["qmatrix"]).reshape(len(qkeys), -1)
                d = np.abs((y * y).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * y @ x.T).round(6)
                hit = np.ones(d.shape, bool) if farthest is None else d <= farthest
                if k is not None and k < len(keys):  # ties at the k-th place stay for the last choice
                    hit &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                i, j = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(qkeys[i]), pa.array(keys[j]), pa.array(d[i, j])], ["query_id", key, "distance"])

    near = met.mapInArrow(run, f"query_id long, {key} long, distance double")
    if k is None:
        return near
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def _labelled(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """(size, keys, labels, matrix): all vectors in blocks of one length; those that are null, empty or hold nulls have size 0."""
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(label).alias("l"), F.col(embedding).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        for b in batches:
            by: dict[int, list] = {}
            for i, v in enumerate(b.column("v").to_pylist()):
                by.setdefault(0 if v is None or None in v else len(v), []).append((i, v))
            for size, found in by.items():
                for at in range(0, len(found), BLOCK):
                    part = found[at : at + BLOCK]
                    places = pa.array([i for i, _ in part], pa.int64())
                    matrix = np.array([v for _, v in part], np.float64).tobytes() if size else b""
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), one(b.column("k").take(places)), one(b.column("l").take(places)), pa.array([matrix])], ["size", "keys", "labels", "matrix"])

    return rows.mapInArrow(run, f"size int, keys array<bigint>, labels array<{rows.schema['l'].dataType.simpleString()}>, matrix binary")


def lookup(vectors: DataFrame, queries: DataFrame, farthest: float, label: str = "label", key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, vec_id, tier), each pair once: tier 0 for vectors of the query's label, 1 for others within ``farthest``.

    Both are decided where a block of vectors meets a block of queries, as in ``nearest``, so that pairs, which grow with the
    square of the input, are neither joined nor shuffled; only if an id stands more than once are they brought together.  Null
    labels equal none; vectors that are null, empty or hold nulls, and those of different lengths, are not near.  Arrow batches
    of the session are held to ``BATCH_BYTES`` from then on.
    """
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    names = {c: f"q{c}" for c in ("size", "keys", "labels", "matrix")}
    q = _labelled(queries, key, embedding, label).withColumnsRenamed(names)
    (n_vectors, most), (n_queries, most_queries) = (df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first() for df in (vectors, queries))
    met = _met(_labelled(vectors, key, embedding, label), q, n_vectors, n_queries, [], CELLS).select(*names, *names.values())
    slack = EDGE * max(1, abs(farthest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                keys, labels, qkeys, qlabels = (b.column(c)[at].values for c in ("keys", "labels", "qkeys", "qlabels"))
                codes = pa.concat_arrays([labels, qlabels]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                code, qcode = codes[: len(keys)], codes[len(keys) :]
                hit = exact = (code == qcode[:, None]) & (qcode >= 0)[:, None]
                size = b.column("size")[at].as_py()
                if size and size == b.column("qsize")[at].as_py():
                    x, y = (np.frombuffer(b.column(c)[at].as_buffer()).reshape(-1, size) for c in ("matrix", "qmatrix"))
                    d = y @ (-2 * x.T)
                    d += (x * x).sum(1)
                    d += (y * y).sum(1)[:, None]
                    near = d <= farthest - slack
                    edge = near ^ (d <= farthest + slack)
                    near[edge] = np.abs(d[edge]).round(6) <= farthest
                    hit = exact | near
                found = np.flatnonzero(hit)
                i, j = np.divmod(found, len(keys))
                yield pa.RecordBatch.from_arrays([qkeys.take(pa.array(i)), keys.take(pa.array(j)), pa.array((~exact.ravel()[found]).astype(np.int32))], ["query_id", key, "tier"])

    found = met.mapInArrow(run, f"query_id long, {key} long, tier int")
    return found if max(most, most_queries) <= 1 else found.groupBy("query_id", key).agg(F.min("tier").alias("tier"))
