"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct 5-word shingles.  Shingles are ordered by document frequency, rarest first; two sets
with Jaccard similarity of at least the threshold share a shingle among the first n - ceil(t n) + 1 of both.

1. Every batch of texts sends its shingle hashes as packed arrays to hash buckets, which count document frequencies and
   send back only those of shingles that more than one document has.  A document whose prefix holds no such shingle is
   linked with nothing and takes no further part.
2. Documents with the same prefix and size form one group.  Groups that share a prefix shingle and pass the size and
   position filters become pairs of groups; pairs expand to their members, whose whole sets are compared.
3. Only connectedness is asked for, so a prefix shingle's documents are first compared with one pivot.  What is left are
   pairs across the components so found, which are all compared: pairs of a shingle with few documents leave their task
   and meet their sets once, however many shingles name them; documents of a frequent shingle meet in blocks inside
   tasks, where filters pick the pairs and a matrix product verifies them, and only links that connect anything new
   leave.  So rows grow with the documents of a shingle, not with their pairs, and no candidate is left out.

Cases: words are runs outside ``\\x20 \\x09-\\x0D`` after lower-casing A-Z; with fewer words than ``n`` the whole
sequence is the one shingle; null, empty and blank texts have no set and are linked with nothing; equal sets are linked
(also of repeated rows); a component's id is the smallest doc_id in it (nulls aside); rows that share a doc_id stand or
fall together in ``drop_near_copies``; an empty table gives an empty result; extra columns are passed over or kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import components, cut, hot_join, KeyFilter, lean, mix64, tokens, U, without

NGRAM = 5
PERCENT = 75  #: Jaccard similarity, in hundredths
BUCKET_SHINGLES = 1 << 18  #: shingles that a bucket holds on average
PIVOT_CHUNK = 128  #: documents compared with one pivot in one group of a task
SMALL_LIST = 64  #: classes of a shingle up to which pairs leave a task; those of others are compared in blocks
BUNDLE = 4096  #: entries of such shingles that one group of a task looks at
BLOCK_CLASSES = 1024  #: classes, and shingles of them, that a block holds
BLOCK_SHINGLES = 1 << 20
COLUMNS = 4096  #: shingles that are multiplied at once


def shingle_sets(column: pa.Array, n: int = NGRAM) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for t in tokens(column):
        h = t.hash
        k = max(0, len(h) - n + 1)
        s = np.zeros(k, dtype=U)
        with np.errstate(over="ignore"):
            for i in range(n):
                s = mix64(s * U(0x9E3779B97F4A7C15) + h[i : k + i])
        b = t.bounds
        for lo, hi in zip(b[:-1], b[1:], strict=True):
            if hi - lo >= n:
                yield np.unique(s[lo : hi - n + 1])
            elif hi == lo:
                yield s[:0]
            else:
                x = np.zeros(1, dtype=U)
                with np.errstate(over="ignore"):
                    for v in h[lo:hi]:
                        x = mix64(x * U(0x9E3779B97F4A7C15) + v)
                    yield mix64(x + U(hi - lo))


def prefix_length(n, percent: int):
    return n - (n * percent + 99) // 100 + 1


def _set_key(s: np.ndarray) -> int:
    """64-bit hash of a set of hashes."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(s))]))[0].astype(np.int64))


def _scatter(docs: DataFrame, buckets: int, n: int) -> DataFrame:
    """Per batch: one row of ids, set sizes and set keys, and one row per bucket with (hash, document in batch) packed."""
    bits = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                ids = b.column("doc_id")
                sets = list(shingle_sets(b.column("text"), n))
                size = np.array([len(s) for s in sets], dtype=np.int32)
                key = np.array([_set_key(s) for s in sets], dtype=np.int64)
                null = np.array(ids.is_null(), dtype=bool)
                plain = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                batch, seq = TaskContext.get().partitionId() << 32 | seq, seq + 1
                h = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets), dtype=np.uint16), size)
                to = (h >> U(64 - bits)).astype(np.uint32) if bits else np.zeros(len(h), np.uint32)
                order = np.argsort(to.astype(np.uint16) if bits <= 16 else to, kind="stable")
                to, doc, low = to[order], doc[order], h[order].astype(np.uint32)
                cuts = np.flatnonzero(np.diff(to)) + 1
                lo, hi = np.concatenate([[0], cuts]).astype(int), np.concatenate([cuts, [len(to)]]).astype(int)
                if not len(to):
                    lo = hi = lo[:0]
                k = len(lo)
                # the row of the batch itself travels through a bucket that its own hash picks
                bucket = np.append(to[lo].astype(np.int64), int(mix64(np.array([batch], dtype=U))[0]) % buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(np.full(k + 1, batch, np.int64)), pa.array([*(low[a:z].tobytes() for a, z in zip(lo, hi, strict=True)), size.tobytes() + key.tobytes()], pa.binary()), pa.array([*(doc[a:z].tobytes() for a, z in zip(lo, hi, strict=True)), plain.tobytes() + null.tobytes()], pa.binary()), pa.array(np.append(np.zeros(k, bool), True))],
                    ["bucket", "batch", "x", "y", "head"],
                )

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, batch long, x binary, y binary, head boolean")


def _frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
    """In a bucket: for each batch, the entries of shingles that several documents have, with their frequency."""
    head = pdf[pdf["head"]].assign(df=b"")
    rest = pdf[~pdf["head"]]
    if not len(rest):
        return head
    h = np.concatenate([np.frombuffer(x, np.uint32) for x in rest["x"]])
    doc = np.concatenate([np.frombuffer(y, np.uint16) for y in rest["y"]])
    order = np.argsort(h, kind="stable")
    s = h[order]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]])
    run = np.diff(edge)
    df = np.empty(len(h), dtype=np.uint16)
    df[order] = np.repeat(np.minimum(run, 65535), run).astype(np.uint16)
    many = df > 1
    ends = np.cumsum([len(x) // 4 for x in rest["x"]])
    out = []
    for a, z, bucket, batch in zip(np.concatenate([[0], ends[:-1]]), ends, rest["bucket"], rest["batch"], strict=True):
        m = many[a:z]
        if m.any():
            out.append((bucket, batch, h[a:z][m].tobytes(), doc[a:z][m].tobytes(), False, df[a:z][m].tobytes()))
    return pd.concat([head, pd.DataFrame(out, columns=["bucket", "batch", "x", "y", "head", "df"])])


def _prefixes(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, rest = pdf[pdf["head"]], pdf[~pdf["head"]].sort_values("bucket")
        n = len(heads["y"].iloc[0]) // 9
        x, y = heads["x"].iloc[0], heads["y"].iloc[0]
        size, key = np.frombuffer(x[: 4 * n], np.int32).astype(np.int64), np.frombuffer(x[4 * n :], np.int64)
        ids, null = np.frombuffer(y[: 8 * n], np.int64), np.frombuffer(y[8 * n :], bool)
        prefix: list = [None] * n
        first = np.zeros(n, dtype=np.int32)
        if len(rest):
            h = np.concatenate([np.frombuffer(v, np.uint32) for v in rest["x"]])
            doc = np.concatenate([np.frombuffer(v, np.uint16) for v in rest["y"]])
            df = np.concatenate([np.frombuffer(v, np.uint16) for v in rest["df"]])
            bucket = np.repeat(rest["bucket"].to_numpy(np.int64), [len(v) // 4 for v in rest["x"]])
            order = np.argsort((doc.astype(U) << U(48)) | (df.astype(U) << U(32)) | h.astype(U), kind="stable")
            token = (bucket << 32 | h.astype(np.int64))[order]
            bounds = np.searchsorted(doc[order], np.arange(n + 1))
            for i in range(n):
                shared = bounds[i + 1] - bounds[i]
                alone = size[i] - shared
                take = prefix_length(size[i], percent) - alone
                if size[i] and shared and take > 0:
                    mine = token[bounds[i] : bounds[i] + take]
                    prefix[i] = mine[np.sort(np.unique(mine, return_index=True)[1])]  # colliding hashes count once
                    first[i] = alone
        out = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n": size, "set_key": key, "prefix": prefix, "first": first})
        out.loc[null, "doc_id"] = pd.NA
        return out

    return run


def prefixes(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, set_key, prefix, first): set size and, where a link is possible, prefix and its first position."""
    total = docs.agg(F.sum(F.length(F.col("text").cast("string"))).alias("c")).first()["c"] or 0
    buckets = 1 << max(4, (int(total / 6 / BUCKET_SHINGLES)).bit_length())
    sent = _scatter(docs, buckets, n)
    met = sent.groupBy("bucket").applyInPandas(_frequencies, "bucket long, batch long, x binary, y binary, head boolean, df binary")
    return met.groupBy("batch").applyInPandas(_prefixes(percent), "doc_id long, n long, set_key long, prefix array<long>, first int")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(class, hashes) of the documents in ``wanted`` (doc_id, class)."""
    known = KeyFilter(wanted.select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(known.has(b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))))
            sets = [s.tobytes() for s in shingle_sets(b.column("text"), n)]
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(np.frombuffer(s, U)) for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["class", "hashes"])

    some = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # some others pass the filter, and a doc_id may have several rows: only rows of a wanted class count, once
    found = some.mapInArrow(run, "class long, hashes binary").join(wanted.select("class").distinct(), "class", "left_semi")
    return found.dropDuplicates(["class"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar.  Per pivot ``a``, at most PIVOT_CHUNK of ``b`` meet in a group."""
    count = pairs.groupBy("a").agg(F.count("*").alias("c"))
    chunk = F.when(F.col("c") <= PIVOT_CHUNK, F.lit(0)).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / (PIVOT_CHUNK / 2)).cast("long"))).cast("long")
    placed = cut(pairs.join(count, "a").select("a", "b", chunk.alias("chunk")))
    left = placed.select("a", "chunk").distinct().join(sets, F.col("a") == F.col("class")).select("a", "chunk", F.lit(0).cast("long").alias("b"), "hashes", F.lit(True).alias("pivot"))
    right = placed.join(sets, F.col("b") == F.col("class")).select("a", "chunk", "b", "hashes", F.lit(False).alias("pivot"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf["pivot"].to_numpy(bool)
        x = np.frombuffer(pdf["hashes"][whole].iloc[0], U)
        hit = []
        for b, raw in zip(pdf["b"][~whole], pdf["hashes"][~whole], strict=True):
            y = np.frombuffer(raw, U)
            both = len(x) + len(y) - len(np.union1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                hit.append(int(b))
        return pd.DataFrame({"a": np.full(len(hit), pdf["a"].iloc[0], np.int64), "b": np.array(hit, np.int64)})

    return left.unionByName(right).groupBy("a", "chunk").applyInPandas(run, "a long, b long")


def _fits(n, p, m, q, percent: int):
    """Size and position filter of two entries (sizes n, m; positions p, q) of one shingle: columns or arrays.

    The first shingle that two similar sets share leaves room for all of their overlap in what follows it, so a pair need
    only be met where that holds.
    """
    least, most = (np.minimum, np.maximum) if isinstance(n, np.ndarray) else (F.least, F.greatest)
    return (100 * least(n, m) >= percent * most(n, m)) & ((100 + percent) * least(n - p, m - q) >= percent * (n + m))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of hashes: products of 0/1 matrices over hashes that several hold."""
    k = len(sets)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(k), [len(s) for s in sets])[order]
    flat = flat[order]
    edge = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(edge) - 1
    many = np.bincount(column)[column] > 1
    owner, edge = owner[many], edge[many]
    column = np.cumsum(edge) - 1
    total = np.zeros((k, k))
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + COLUMNS, COLUMNS))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            x = np.zeros((k, min(COLUMNS, column[hi - 1] - column[lo] + 1)), np.float32)
            x[owner[lo:hi], column[lo:hi] - column[lo]] = 1
            total += x @ x.T
    return total


def _forest(link: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that connect what ``link`` connects, given that rows of one component are connected already."""
    _, root = np.unique(comp, return_inverse=True)
    out = []
    for i in range(len(link)):
        for j in np.flatnonzero(link[i]):
            if root[i] != root[j]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out


def _block_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, p, comp = (pdf[c].to_numpy(np.int64) for c in ("n", "p", "comp"))
        side = pdf["side"].to_numpy()
        ask = _fits(n[:, None], p[:, None], n[None, :], p[None, :], percent) & (comp[:, None] != comp[None, :])
        if side.min() != side.max():  # two blocks: each was compared within itself elsewhere
            ask &= side[:, None] != side[None, :]
        at = np.flatnonzero(ask.any(axis=1))
        if not len(at):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        ids, n, comp, ask = pdf["class"].to_numpy(np.int64)[at], n[at], comp[at], ask[np.ix_(at, at)]
        both = intersections([np.frombuffer(x, U) for x in pdf["hashes"].iloc[at]])
        found = _forest(ask & (100 * both >= percent * (n[:, None] + n[None, :] - both)), comp)
        return pd.DataFrame({"a": np.array([ids[i] for i, _ in found], np.int64), "b": np.array([ids[j] for _, j in found], np.int64)})

    return run


def _blocks(large: DataFrame, percent: int) -> DataFrame:
    """Rows of ``large`` (token, class, n, ...) for each pair of blocks of their token: (token, x, y, side, ...).

    A token's classes form one block, or blocks of about BLOCK_CLASSES classes and BLOCK_SHINGLES shingles, by size class:
    sizes of similar sets lie in the same size class or in neighbouring ones, so only such blocks meet.
    """
    step = float(np.log(100.5 / percent))
    whole = large.groupBy("token").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("k"))
    cls = F.when(F.col("k") == 1, F.lit(0)).otherwise(F.floor(F.log(F.col("n").cast("double")) / step)).cast("int")
    rows = cut(large.join(whole, "token").withColumn("s", cls).drop("k"))
    size = rows.groupBy("token", "s").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("k"))
    near = size
    for d, name in ((-1, "before"), (1, "after")):
        near = near.join(size.select("token", (F.col("s") - d).alias("s"), F.col("k").alias(name)), ["token", "s"], "left")
    rows = rows.join(near, ["token", "s"]).withColumn("mine", F.struct("s", F.pmod(F.xxhash64("class"), F.col("k").cast("long")).cast("int").alias("i")))
    of = lambda d, k: F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct((F.col("s") + d).alias("s"), i.alias("i")))).otherwise(F.array().cast("array<struct<s:int,i:int>>"))
    rows = rows.withColumn("other", F.explode(F.concat(of(0, F.col("k")), of(-1, F.coalesce("before", F.lit(0))), of(1, F.coalesce("after", F.lit(0))))))
    return rows.select("token", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).alias("side"), "class", "comp", "n", "p")


def _small_pairs(small: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that the filters leave, of tokens with at most SMALL_LIST classes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token", kind="stable")
        token, n, p, comp, ids = (pdf[c].to_numpy(np.int64) for c in ("token", "n", "p", "comp", "class"))
        a, b = [], []
        for d in range(1, SMALL_LIST):
            i = np.flatnonzero((token[d:] == token[:-d]) & (comp[d:] != comp[:-d]))
            i = i[_fits(n[i], p[i], n[i + d], p[i + d], percent)]
            a.append(ids[i])
            b.append(ids[i + d])
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    bundles = max(1, small.count() // BUNDLE)
    return small.groupBy(F.pmod(F.xxhash64("token"), F.lit(bundles))).applyInPandas(run, "a long, b long").distinct()


def link_classes(docs: DataFrame, table: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(node, label) of the classes (equal sets) that are linked with another class."""
    live = table.where("prefix is not null")
    classes = cut(live.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("first").alias("first"), F.first("prefix").alias("prefix")).withColumn("grp", F.xxhash64("n", "prefix")))
    member = classes.select("grp", F.col("set_key").alias("class"))
    group = classes.groupBy("grp").agg(F.min("set_key").alias("pivot"), F.min("n").alias("n"), F.min("first").alias("first"), F.first("prefix").alias("prefix"), F.count("*").alias("members"))
    # one entry per group and prefix shingle; p: its position in the set's order
    entry = cut(group.select("grp", "pivot", "n", "members", F.posexplode("prefix").alias("i", "token"), "first").select("grp", "pivot", "n", "members", "token", (F.col("first") + F.col("i")).cast("long").alias("p")))
    # of shingles that the same groups hold, the first in order stands for all: two sets that share one share it first
    shared = entry.groupBy("token").agg(F.sum("members").alias("m"), F.bit_xor(F.xxhash64("grp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "grp")).alias("y"), F.min(F.struct("grp", "p")).alias("at")).where("m > 1")
    lists = shared.groupBy("x", "y", "m").agg(F.min(F.struct(F.col("at.p"), F.col("token"))).alias("t")).select("t.token")
    entry = cut(entry.join(cut(lists), "token").drop("members"))
    sets = cut(_sets(docs, classes.select("doc_id", F.col("set_key").alias("class")), n))
    # a pivot for each shingle, and for each group: its own
    top = entry.groupBy("token").agg(F.min(F.struct("pivot", "n", "p")).alias("t")).select("token", F.col("t.pivot").alias("a"), F.col("t.n").alias("m"), F.col("t.p").alias("q"))
    pairs = entry.join(top, "token").where(F.col("pivot") != F.col("a")).where(_fits(F.col("n"), F.col("p"), F.col("m"), F.col("q"), percent)).select("a", F.col("pivot").alias("b")).distinct()
    tried = cut(pairs.union(member.join(group.where("members > 1").select("grp", "pivot"), "grp").where("class <> pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b"))))
    links = cut(_verify(tried, sets, percent))
    label = cut(components(links))
    # what is left: members of different components that share a shingle
    named = member.join(label, F.col("class") == F.col("node"), "left").select("grp", "class", F.coalesce("label", "class").alias("comp"))
    spread = cut(entry.select("grp", "n", "token", "p").join(named, "grp"))
    mixed = spread.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("c")).where("least <> most").select("token", "c")
    spread = cut(spread.join(mixed, "token"))
    rest = _small_pairs(spread.where(F.col("c") <= SMALL_LIST).drop("c"), percent)
    rest = cut(rest.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    met = _blocks(spread.where(F.col("c") > SMALL_LIST).drop("c"), percent).join(sets, "class")
    far = met.groupBy("token", "x", "y").applyInPandas(_block_links(percent), "a long, b long")
    return components(links.union(_verify(rest, sets, percent)).union(cut(far)))


def near_copies(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, set_key, component_id) for each row of ``docs``."""
    table = cut(prefixes(docs, n, percent))
    label = link_classes(docs, table, n, percent)
    live = table.where("prefix is not null").select("doc_id", F.col("n").alias("n_shingles"), "set_key")
    own = live.groupBy("set_key").agg(F.min("doc_id").alias("least"))
    own = cut(own.join(label, F.col("set_key") == F.col("node"), "left").select("set_key", "least", F.coalesce("label", "set_key").alias("comp")))
    least = own.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = hot_join(live, hot_join(own.select("set_key", "comp"), least, "comp").select("set_key", "component_id"), "set_key")
    rest = table.where("prefix is null").select("doc_id", F.col("n").alias("n_shingles"), "set_key", F.col("doc_id").alias("component_id"))
    return named.select("doc_id", "n_shingles", "set_key", "component_id").union(rest)


def drop_near_copies(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document, that of the smallest doc_id, of each component."""
    gone = cut(near_copies(docs, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    return without(docs, gone)
