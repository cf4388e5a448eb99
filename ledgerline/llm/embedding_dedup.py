"""Near-duplicate embeddings by NN-descent.

Equal vectors are collapsed first.  A neighbour graph starts from blocks of vectors that fall on the same sides of random
hyperplanes, and is refined by joining neighbours of neighbours until few lists change.  Pairs at the threshold are
checked in double precision and give components.  A vector whose whole list is at the threshold is saturated: its list is
enlarged to its component, whose vectors are compared block by block, so that only counts leave a task and no pair is
listed.  The number of start tables grows with that of the hyperplanes.  Recall is audited against brute force for a
bounded number of vectors, each weighing the same, those of small groups also by themselves; while it falls short, the
graph is built again with more tables and longer lists, and after ``ATTEMPTS`` the search fails with an error.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
lengths link with nothing of another length; equal vectors (also of repeated rows) link with each other; a component's id
is the smallest vec_id in it (nulls aside); an empty table gives an empty result; extra columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import components, cut, lean

LEAST = 0.9
SLACK = 1e-5  #: single precision's error, allowed for until pairs are checked in double precision
NEIGHBOURS = 8
TABLES = 4  #: start tables at least
MEET = 0.95  #: chance that a pair at the threshold shares a start block
BLOCK = 192  #: vectors that are compared at once in a start block
DENSE = 512  #: vectors of a component in one block of its counts
ROUNDS = 3
AUDITED = 128  #: vectors of small groups that the audit looks for
AUDITS = (1024, 8192)  #: vectors that it compares with all, the second if the first show too few of small groups
SMALL = NEIGHBOURS  #: links of a vector of a small group at most
RECALL = 0.95
ATTEMPTS = 5
MOST_NEIGHBOURS = 32


def unit_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, node, unit): node is a hash of the components, unit the normalised doubles; null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, units = [], []
            for x in b.column("embedding").to_pylist():
                v = np.array([np.nan if y is None else y for y in x], dtype=np.float64) if x else np.zeros(0)
                # scaled first: squares of very large or very small components would not fit
                top = np.abs(v).max() if len(v) else 0.0
                if not np.isfinite(top) or top == 0:
                    nodes.append(None)
                    units.append(None)
                    continue
                v = v / top + 0.0
                v /= np.sqrt(v @ v)
                nodes.append(int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True))
                units.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())], ["vec_id", "node", "unit"])

    return lean(table).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, node long, unit binary")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each ``u``; lists are short (a few times k), whatever a vector's popularity."""
    top = edges.groupBy("u").agg(F.slice(F.sort_array(F.collect_set(F.struct("sim", "v")), asc=False), 1, k).alias("l"))
    return top.select("u", F.explode("l").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.sim").alias("sim"))


def _pairs_of(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k nearest in a block, and a chain of one threshold pair per row beside them."""
    n = len(ids)
    np.fill_diagonal(sims, -2)
    k = min(k, n - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    u, v = np.repeat(np.arange(n), k), near.ravel()
    low = np.triu(sims >= LEAST - SLACK)
    some = np.flatnonzero(low.any(axis=1))
    u, v = np.concatenate([u, some]), np.concatenate([v, low[some].argmax(axis=1)])
    return ids[u], ids[v], sims[u, v]


def _bits(n: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, n / BLOCK)))))


def start_tables(n: int) -> int:
    """Tables after which a pair at the threshold has shared a block with probability ``MEET``."""
    same = (1 - np.arccos(LEAST) / np.pi) ** _bits(n)
    return max(TABLES, int(np.ceil(np.log(1 - MEET) / np.log(1 - same))))


def _start(nodes: DataFrame, n: int, tables: int, k: int) -> DataFrame:
    bits = _bits(n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            out: list[tuple] = []
            for node, raw in zip(b.column("node").to_pylist(), b.column("unit").to_pylist(), strict=True):
                v = np.frombuffer(raw)
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng(1234 + len(v)).normal(size=(tables * bits, len(v)))
                sides = (planes[len(v)] @ v > 0).reshape(tables, bits) @ (1 << np.arange(bits))
                out += [(t, len(v), int(s), node, v.astype(np.float32).tobytes()) for t, s in enumerate(sides)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["t", "dim", "side", "node", "unit"])

    placed = cut(nodes.mapInArrow(place, "t int, dim int, side long, node long, unit binary"))
    size = placed.groupBy("t", "dim", "side").agg(F.count("*").alias("c"))
    parts = F.ceil(F.col("c") / BLOCK).cast("long")
    placed = placed.join(size, ["t", "dim", "side"]).withColumn("part", F.pmod(F.xxhash64("t", "node"), parts))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"u": [], "v": [], "sim": []})
        x = np.stack([np.frombuffer(r, np.float32) for r in pdf["unit"]])
        u, v, s = _pairs_of(pdf["node"].to_numpy(), x @ x.T, k)
        return pd.DataFrame({"u": u, "v": v, "sim": s})

    return placed.groupBy("t", "dim", "side", "part").applyInPandas(run, "u long, v long, sim float")


def _refine(graph: DataFrame, nodes: DataFrame, n: int, k: int) -> DataFrame:
    """Pairs of neighbours of each vector that are nearer than what both have."""
    # of the many that may point to one vector, about k take part in a round: a heuristic of the search, not of the result
    popular = graph.groupBy("v").agg(F.count("*").alias("c"))
    reverse = graph.join(popular, "v").where(F.pmod(F.xxhash64("u", "v"), F.col("c")) < k).select(F.col("v").alias("c"), F.col("u").alias("m"))
    member = graph.select(F.col("u").alias("c"), F.col("v").alias("m")).union(reverse).distinct()
    worst = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("k"))
    known = nodes.join(worst, F.col("node") == F.col("u"), "left").select("node", "unit", F.when(F.col("k") < k, F.lit(-2.0)).otherwise(F.col("worst")).cast("float").alias("worst"))
    known = known.withColumn("worst", F.coalesce("worst", F.lit(-2.0).cast("float")))
    bundles = max(1, n // 256)
    rows = member.join(known, F.col("m") == F.col("node")).select("c", F.pmod(F.xxhash64("c"), F.lit(bundles)).alias("bundle"), "m", "unit", "worst")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c", kind="stable")
        c, m, w = pdf["c"].to_numpy(), pdf["m"].to_numpy(), pdf["worst"].to_numpy()
        units = pdf["unit"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1, [len(c)]])
        us, vs, ss = [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            by: dict[int, list[int]] = {}
            for i in range(lo, hi):
                by.setdefault(len(units[i]), []).append(i)
            for at in by.values():
                x = np.stack([np.frombuffer(units[i], np.float64) for i in at]).astype(np.float32)
                s = x @ x.T
                ids, worst = m[at], w[at]
                hit = s > worst[:, None]
                np.fill_diagonal(hit, False)
                a, b = np.nonzero(hit)
                us.append(ids[a])
                vs.append(ids[b])
                ss.append(s[a, b])
        if not us:
            return pd.DataFrame({"u": [], "v": [], "sim": []})
        out = pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs), "sim": np.concatenate(ss)})
        return out.drop_duplicates(["u", "v"])

    return rows.groupBy("bundle").applyInPandas(run, "u long, v long, sim float")


def _search(nodes: DataFrame, n: int, tables: int, k: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph (u, v, sim), and all threshold pairs (u, v) met on the way that chains keep."""
    met = cut(_start(nodes, n, tables, k))
    near = met.where(F.col("sim") >= LEAST - SLACK).select("u", "v").distinct()
    graph = cut(_best(met, k))
    for _ in range(rounds):
        new = cut(_refine(graph, nodes, n, k))
        grown = cut(_best(graph.union(new), k))
        changed = grown.join(graph.select("u", "v"), ["u", "v"], "left_anti").count()
        graph = grown
        if changed <= 0.001 * n * k:
            break
    near = near.union(graph.where(F.col("sim") >= LEAST - SLACK).select("u", "v"))
    return graph, near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def _checked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [bool(np.frombuffer(x) @ np.frombuffer(y) >= LEAST) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    met = pairs.join(nodes.select(F.col("node").alias("a"), F.col("unit").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _dense_counts(members: DataFrame) -> DataFrame:
    """(node, links) within each component: (comp, node, unit, copies) compared block by block, counts only."""
    size = members.groupBy("comp").agg(F.ceil(F.count("*") / DENSE).cast("int").alias("blocks"))
    placed = members.join(size, "comp").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    pairs = placed.select("comp", "node", "unit", "copies", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("comp", "node", "unit", "copies", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(r) for r in pdf["unit"]])
        c = pdf["copies"].to_numpy()
        left = (pdf["mine"] == pdf["i"]).to_numpy()
        right = (pdf["mine"] == pdf["j"]).to_numpy()
        near = x[left] @ x[right].T >= LEAST
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"node": pdf["node"], "links": near @ c})
        ids = pdf["node"].to_numpy()
        return pd.DataFrame({"node": np.concatenate([ids[left], ids[right]]), "links": np.concatenate([near @ c[right], near.T @ c[left]])})

    return pairs.groupBy("comp", "i", "j").applyInPandas(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _links(nodes: DataFrame, n: int, tables: int, k: int, rounds: int) -> DataFrame:
    """(node, label, links) of the nodes that have links with other nodes."""
    graph, near = _search(nodes, n, tables, k, rounds)
    links = cut(_checked(near, nodes))
    label = cut(components(links))
    worst = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("c"))
    full = worst.where((F.col("worst") >= LEAST - SLACK) & (F.col("c") >= k)).select(F.col("u").alias("node"))
    dense = cut(label.join(full, "node", "left_semi").select("label").distinct())
    member = label.join(dense, "label", "left_semi").join(nodes.select("node", "unit", "copies"), "node").select(F.col("label").alias("comp"), "node", "unit", "copies")
    counted = _dense_counts(member)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sparse = both.join(label.join(dense, "label", "left_anti").select(F.col("node").alias("a")), "a").join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("links"))
    return cut(label.join(counted.union(sparse), "node"))


def _audit(nodes: DataFrame, some: DataFrame, found: DataFrame) -> tuple[int, float, int, float]:
    """Vectors of ``some`` that have links, the sum of their recalls, and both for those of small groups."""
    rows = some.select("node", "unit").collect()  # at most about the last of AUDITS
    if not rows:
        return 0, 0.0, 0, 0.0
    shared = nodes.sparkSession.sparkContext.broadcast([(r["node"], bytes(r["unit"])) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for i, u in shared.value:
            by.setdefault(len(u), []).append((i, np.frombuffer(u)))
        asked = {size: (np.array([i for i, _ in xs]), np.stack([x for _, x in xs])) for size, xs in by.items()}
        count = {size: np.zeros(len(ids), np.int64) for size, (ids, _) in asked.items()}
        for b in batches:
            node, copies, raw = b.column("node").to_numpy(), b.column("copies").to_numpy(), b.column("unit").to_pylist()
            at: dict[int, list[int]] = {}
            for j, r in enumerate(raw):
                if len(r) in asked:
                    at.setdefault(len(r), []).append(j)
            for size, js in at.items():
                ids, x = asked[size]
                for lo in range(0, len(js), 256):
                    part = js[lo : lo + 256]
                    near = x @ np.stack([np.frombuffer(raw[j]) for j in part]).T >= LEAST
                    near &= ids[:, None] != node[part]
                    count[size] += near @ copies[part]
        for size, (ids, _) in asked.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(count[size])], ["node", "links"])

    true = lean(nodes).select("node", "unit", "copies").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).where("links > 0")
    recall = F.least("links", F.coalesce("got", F.lit(0))) / F.col("links")
    small = F.col("links") <= SMALL
    got = true.join(found.select("node", F.col("links").alias("got")), "node", "left").agg(F.count("*"), F.sum(recall), F.count_if(small), F.sum(F.when(small, recall))).first()
    return got[0], got[1] or 0.0, got[2], got[3] or 0.0


def audit_recall(nodes: DataFrame, n: int, found: DataFrame) -> float:
    """Mean recall of the vectors that have links, or of those of small groups if that is less.

    Vectors are picked by hash and compared with all.  Each weighs the same, however many links it has; a second, larger
    part is looked at where the first holds fewer than ``AUDITED`` vectors of small groups.
    """
    place = F.pmod(F.xxhash64(F.lit(99), "node"), F.lit(1 << 30))
    total, done = np.zeros(4), 0
    for most in AUDITS:
        upto = int((1 << 30) * min(1.0, most / max(n, 1)))
        if upto > done and total[2] < AUDITED:
            total += _audit(nodes, nodes.where((place >= done) & (place < upto)), found)
            done = upto
    linked, recall, small, small_recall = total
    return float(min(recall / linked if linked else 1.0, small_recall / small if small else 1.0))


def near_duplicates(table: DataFrame, tables: int = TABLES, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``table``."""
    rows = cut(unit_vectors(table))
    nodes = cut(rows.where("node is not null").groupBy("node").agg(F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    n = nodes.count()
    tables = max(tables, start_tables(n))
    for _ in range(ATTEMPTS):
        found = _links(nodes, n, tables, k, rounds)
        recall = audit_recall(nodes, n, found) if n > 1 else 1.0
        if recall >= RECALL:
            break
        tables, k, rounds = 2 * tables, max(k, min(2 * k, MOST_NEIGHBOURS)), rounds + 2
    else:
        raise RuntimeError(f"near-duplicate search found {recall:.3f} of the audited links after {ATTEMPTS} attempts; {RECALL} are asked for")
    named = nodes.select("node", "copies", "least").join(found, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = cut(named.join(least, "label").select("node", "n_links", "component_id"))
    out = rows.where("node is not null").select("vec_id", "node").join(by_node, "node").select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
