"""Language-model scores of whole documents by a gated recurrent network.

Counts of all training tokens give the base score and the vocabulary.  The network reads a text token by token: an update
gate mixes the state with a candidate; a softmax over classes, then one within the class, gives the next token's
probability.  The ``WORDS`` most frequent words form classes of about equal root frequency and have a learnt softmax
within them; all other words, seen or not, fall in classes by their first and last bytes and share the class's
probability in proportion to count + 1, so the model is a proper distribution over words and one unknown word per class.

Texts are tokenised twice, for counts and for ids, which are written once and read by training and scoring.  Training is
truncated backpropagation in numpy, over windows of ``WINDOW`` tokens with the state carried on; shards of texts, picked
by hash, train apart and the weights are averaged, ``ROUNDS`` times.  It learns from the whole text of every training
document: the rounds take disjoint parts of them, by hash, which together are all.  Scores do not depend on how the table
is laid out.  Scoring carries the state across windows to the end of each text.  Words beyond the ``HEAD`` most frequent meet their counts in a join.

Cases: a null text counts as empty and is scored as its end token; doc_id null counts as the empty id; repeated rows get
equal scores; without training documents every count is 0; an empty table gives an empty result; extra columns are
passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import U, Tokens, crc_mod, cut, lean, tokens

HEAD = 1 << 17  #: most frequent words that every task knows (2 MB)
WORDS = 2048  #: words with a learnt probability
CLASSES = 48  #: classes of those words
KINDS = 64  #: classes of all other words
STATE = 16
WINDOW = 16
TRAIN_BATCH = 256
SAFE = 60.0  #: logits whose exponents single precision holds, and sums of them
CHUNK = 8192  #: tokens whose probabilities are found at once: a fixed cost a class is spread over them
ROUNDS = 2
SCORE_DOCS = 8192  #: texts that are scored side by side
SCORE_TOKENS = 8192  #: tokens that a window of them spans, so that few long texts left don't make small ones
END = U(0x1D0C5E17AB54A98C)  #: hash of the end token
RATE = 0.015
START = WORDS + KINDS  #: input before a text's first token
STREAM = 64  #: windows that a task's texts fill before they are learnt
SHARD = 1 << 20  #: training tokens that one shard holds at least

_LETTER = np.full(256, 3, dtype=np.int64)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 0
_LETTER[46] = 1
_LETTER[44] = 2


def kinds(t: Tokens) -> np.ndarray:
    """The class, from 0, of each token as a rare word: its first two bytes and its last."""
    first = t.buf[t.starts].astype(np.int64)
    second = t.buf[np.minimum(t.starts + 1, t.ends - 1)].astype(np.int64)
    return (first * 31 + second * 7) % (KINDS // 4) * 4 + _LETTER[t.buf[t.ends - 1]]


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, kind, c): count of each distinct token of ``docs``, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ends = size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h = np.concatenate([x[0] for x in held])
            d, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return d, np.concatenate([x[1] for x in held])[first], np.bincount(inverse, np.concatenate([x[2] for x in held])).astype(np.int64)

        def batch(d, k, c):
            return pa.RecordBatch.from_arrays([pa.array(d.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(c)], ["h", "kind", "c"])

        for b in batches:
            ends += b.num_rows
            for t in tokens(b.column("text")):
                d, first, c = np.unique(t.hash, return_index=True, return_counts=True)
                held.append((d, kinds(t)[first], c))
                size += len(d)
            if size > 2_000_000:
                one = merged()
                held[:] = [one]
                size = len(one[0])
                if size > 1_000_000:
                    yield batch(*one)
                    held.clear()
                    size = 0
        if held:
            yield batch(*merged())
        if ends:
            yield batch(np.array([END]), np.zeros(1, np.int64), np.array([ends]))

    return lean(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, kind int, c long").groupBy("h").agg(F.first("kind").alias("kind"), F.sum("c").alias("c"))


class Vocabulary:
    """The most frequent words: ids below ``WORDS`` are learnt words by class, then ``WORDS + kind``."""

    def __init__(self, h: np.ndarray, c: np.ndarray, kind: np.ndarray, mass: np.ndarray, total: int, distinct: int):
        order = np.lexsort((h, -c))
        h, c, kind = h[order].view(U), c[order], kind[order]
        self.total, self.distinct = total, distinct
        n = self.words = min(WORDS, len(h))
        root = np.sqrt(c[:n].astype(float))
        self.cls = np.minimum((np.cumsum(root) - root) / max(root.sum(), 1e-9) * CLASSES, CLASSES - 1).astype(np.int64) if n else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.cls, np.arange(CLASSES + 1))
        self.count = c[:n]
        # what the classes of rare words weigh: counts + 1 of their words, and 1 for the unknown one
        own = np.bincount(kind[:n], c[:n] + 1.0, KINDS) if n else np.zeros(KINDS)
        self.mass = mass - own + 1
        ident = np.where(np.arange(len(h)) < n, np.arange(len(h)), WORDS + kind)
        at = np.argsort(h)
        self.h, self.ident, self.log = h[at], ident[at].astype(np.int32), np.log10(c[at] + 1.0)

    def look(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, known in the head, log10(count + 1) there) of tokens."""
        if not len(self.h):
            return (WORDS + kind).astype(np.int32), np.zeros(len(h), bool), np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[at] == h
        return np.where(known, self.ident[at], WORDS + kind).astype(np.int32), known, np.where(known, self.log[at], 0.0)


def vocabulary(counts: DataFrame) -> Vocabulary:
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = {r["l"]: r["n"] for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()}  # at most 8 * 63 rows
    room, least = HEAD, 1 << 30
    for lv in sorted(sizes, reverse=True):
        if sizes[lv] > room:
            break
        room, least = room - sizes[lv], lv
    head = counts.where(level >= least).select("h", "kind", "c").toPandas()  # at most HEAD rows
    mass = counts.groupBy("kind").agg(F.sum(F.col("c") + 1).alias("m"), F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    m = np.zeros(KINDS)
    for r in mass:
        m[r["kind"]] = r["m"]
    return Vocabulary(head["h"].to_numpy(np.int64), head["c"].to_numpy(np.int64), head["kind"].to_numpy(np.int64), m, int(sum(r["c"] for r in mass)), int(sum(r["n"] for r in mass)))


def _with_ones(h: np.ndarray) -> np.ndarray:
    """States as columns, with a last row of ones that biases meet."""
    out = np.ones((h.shape[1] + 1, len(h)), h.dtype)
    out[:-1] = h.T
    return out


class Network:
    """Parameters: e (inputs), u (state), wc/bc (classes), ww/bw (words within classes)."""

    NAMES = ("e", "u", "wc", "bc", "ww", "bw")

    def __init__(self, v: Vocabulary, weights: dict[str, np.ndarray] | None = None):
        self.first, self.cls = v.first, v.cls
        if weights is not None:
            self.w = weights
            return
        rng = np.random.default_rng(11)
        word = np.bincount(v.cls, v.count + 1.0, CLASSES) if v.words else np.zeros(CLASSES)
        self.w = {
            "e": rng.normal(0, 0.1, (WORDS + KINDS + 1, 2 * STATE)).astype(np.float32),
            "u": rng.normal(0, 0.2, (STATE, 2 * STATE)).astype(np.float32),
            "wc": np.zeros((STATE, CLASSES + KINDS), np.float32),
            "bc": np.log(np.concatenate([np.where(word > 0, word, 1e-4), v.mass])).astype(np.float32),
            "ww": np.zeros((max(v.words, 1), STATE), np.float32),
            "bw": np.log(np.concatenate([v.count + 1.0, np.ones(max(0, 1 - v.words))])).astype(np.float32),
        }

    def run(self, x: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each of the inputs ``x`` (steps, texts), and the last one; a text's start clears the state."""
        u, gates, fresh = self.w["u"], self.w["e"][x], x == START
        out = np.empty((*x.shape, STATE), np.float32)
        for s in range(len(x)):
            if fresh[s].any():
                h = np.where(fresh[s][:, None], np.float32(0), h)
            a = gates[s] + h @ u
            z = 1 / (1 + np.exp(-a[:, :STATE]))
            c = np.tanh(a[:, STATE:])
            if keep is not None:
                keep.append((h, z, c))
            h = h + z * (c - h)
            out[s] = h
        return out, h

    def _kinds(self, y: np.ndarray) -> np.ndarray:
        """The class of each target, in bytes, which sort fast."""
        return np.where(y < WORDS, self.cls[np.minimum(y, len(self.cls) - 1)] if len(self.cls) else 0, y - WORDS + CLASSES).astype(np.uint8)

    def _stacked(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights of classes and words with their biases as a last row or column, and whether all logits lie within
        ``SAFE``: then exponents need no shift, as states lie within 1."""
        wc, ww = np.concatenate([self.w["wc"], self.w["bc"][None]]), np.concatenate([self.w["ww"], self.w["bw"][:, None]], axis=1)
        return wc, ww, max(np.abs(wc).sum(axis=0).max(), np.abs(ww).sum(axis=1).max()) < SAFE

    def log_p(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """ln of the probability of the class of each target, times that within the class for learnt words."""
        out, stacked = np.empty(len(y), np.float32), self._stacked()
        for at in range(0, len(y), CHUNK):
            self._log_p(h[at : at + CHUNK], y[at : at + CHUNK], out[at : at + CHUNK], *stacked)
        return out

    def _log_p(self, h: np.ndarray, y: np.ndarray, out: np.ndarray, wc: np.ndarray, ww: np.ndarray, safe: bool) -> None:
        # tokens lie along the last axis throughout, sorted by class: sums over words then run over whole rows
        k = self._kinds(y)
        order = np.argsort(k, kind="stable")
        k, y, ht = k[order], y[order], _with_ones(h[order])
        logits = wc.T @ ht
        if not safe:
            logits -= logits.max(axis=0)
        got = logits[k, np.arange(len(y))]
        got -= np.log(np.exp(logits, out=logits).sum(axis=0))
        cuts = np.searchsorted(k, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            lo, hi, a, z = cuts[c], cuts[c + 1], self.first[c], self.first[c + 1]
            if hi > lo and z - a > 1:
                l = ww[a:z] @ ht[:, lo:hi]
                if not safe:
                    l -= l.max(axis=0)
                own = l[y[lo:hi] - a, np.arange(hi - lo)]
                got[lo:hi] += own - np.log(np.exp(l, out=l).sum(axis=0))
        out[order] = got

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, h0: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean negative log probability over one window, truncated at its start, and the last state."""
        keep: list = []
        hs, h = self.run(x, h0, keep)
        flat = np.flatnonzero(real.ravel())
        yf = y.ravel()[flat]
        n = np.float32(max(len(flat), 1))
        k = self._kinds(yf)
        order = np.argsort(k, kind="stable")
        flat, k, yf = flat[order], k[order], yf[order]
        hf = hs.reshape(-1, STATE)[flat]
        ht = _with_ones(hf)
        wc, ww, safe = self._stacked()
        p = wc.T @ ht
        if not safe:
            p -= p.max(axis=0)
        np.exp(p, out=p)
        p *= 1 / (p.sum(axis=0) * n)
        p[k, np.arange(len(yf))] -= 1 / n
        g = {"wc": (p @ hf).T, "bc": p.sum(axis=1), "ww": np.zeros_like(self.w["ww"]), "bw": np.zeros_like(self.w["bw"])}
        dh = self.w["wc"] @ p
        cuts = np.searchsorted(k, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            lo, hi, a, z = cuts[c], cuts[c + 1], self.first[c], self.first[c + 1]
            if hi > lo and z - a > 1:
                q = ww[a:z] @ ht[:, lo:hi]
                if not safe:
                    q -= q.max(axis=0)
                np.exp(q, out=q)
                q *= 1 / (q.sum(axis=0) * n)
                q[yf[lo:hi] - a, np.arange(hi - lo)] -= 1 / n
                g["ww"][a:z], g["bw"][a:z] = q @ hf[lo:hi], q.sum(axis=1)
                dh[:, lo:hi] += self.w["ww"][a:z].T @ q
        full = np.zeros((hs.shape[0] * hs.shape[1], STATE), np.float32)
        full[flat] = dh.T
        full = full.reshape(hs.shape)
        back = np.zeros_like(h0)
        da = np.empty((*x.shape, 2 * STATE), np.float32)
        hps, zs, cs = (np.stack(part) for part in zip(*keep, strict=True))
        by_z, by_c, left = (cs - hps) * zs * (1 - zs), zs * (1 - cs * cs), 1 - zs
        fresh, ut = x == START, np.ascontiguousarray(self.w["u"].T)
        for s in range(len(x) - 1, -1, -1):
            back += full[s]
            np.multiply(back, by_z[s], out=da[s, :, :STATE])
            np.multiply(back, by_c[s], out=da[s, :, STATE:])
            back *= left[s]
            back += da[s] @ ut
            if fresh[s].any():
                back[fresh[s]] = 0
        da = da.reshape(-1, 2 * STATE)
        g["u"] = hps.reshape(-1, STATE).T @ da
        # sums by input: only rows of inputs that the window holds are written
        xs = x.ravel()
        order = np.argsort(xs.astype(np.uint16), kind="stable")
        ids, first = np.unique(xs[order], return_index=True)
        g["e"] = np.zeros_like(self.w["e"])
        g["e"][ids] = np.add.reduceat(da[order], first, axis=0)
        return g, h


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """One row per row of ``docs``: its number, doc_id, ids of its tokens, sums over those in the head, and the other tokens' hashes and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        mass = np.log10(np.maximum(v.mass, 1.0))
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in tokens(b.column("text")):
                ids, known, log = v.look(t.hash, kinds(t))
                own = log - np.where(ids >= WORDS, mass[np.maximum(ids - WORDS, 0)], log)
                small = ids.astype("<u2")
                for a, z in zip(t.bounds[:-1], t.bounds[1:], strict=True):
                    rest = t.hash[a:z][~known[a:z]]
                    d, c = np.unique(rest, return_counts=True) if len(rest) else (rest, np.zeros(0, np.int64))
                    for col, x in zip(cols, (small[a:z].tobytes(), int(z - a), int(known[a:z].sum()), float(log[a:z].sum()), float(own[a:z].sum()), d.view(np.int64), c), strict=True):
                        col.append(x)
            n = b.num_rows
            lists = [pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in col])]), np.concatenate([np.zeros(0, np.int64), *col])).cast(pa.list_(pa.int64())) for col in cols[5:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), b.column("doc_id"), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64()), *lists], ["row", "doc_id", "ids", "size", "n_head", "log", "own", "tail", "tail_n"])
            row += n

    rows = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, ids binary, size long, n_head long, log double, own double, tail array<long>, tail_n array<long>")


def _windows(seqs: list[np.ndarray], end: int, start: int, least: int, span: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, inputs, targets, real) of windows over texts sorted by length, longest first; inputs and targets are (steps, texts).

    A window has ``least`` steps, or more if that many of the texts left hold fewer than ``span`` tokens.
    """
    size = np.array([len(s) + 1 for s in seqs])
    at = 0
    while at < size[0]:
        n = int((size > at).sum())
        width = max(least, min(span // n, int(size[0]) - at))
        y = np.full((width, n), end, np.int64)
        x = np.full((width, n), start, np.int64)
        for j in range(n):
            part = seqs[j][at : at + width]
            y[: len(part), j] = part
            before = seqs[j][max(at - 1, 0) : at + width - 1]
            x[int(at == 0) : len(before) + (at == 0), j] = before
        real = np.arange(at, at + width)[:, None] < size[:n]
        steps = int(real.any(axis=1).sum())
        yield n, x[:steps], y[:steps], real[:steps]
        at += width


def _end(v: Vocabulary) -> int:
    return int(v.look(np.array([END]), np.zeros(1, np.int64))[0][0])


def _train(rows: DataFrame, v: Vocabulary, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One round: each shard trains from ``weights`` on its texts (``ids``), in order; the results' mean, weighted by tokens.

    Shards are as many as the tokens ask for and hold texts by hash, so they are the same however the table is laid out.
    """
    spark = rows.sparkSession
    shards = max(1, (rows.agg(F.sum(F.col("size") + 1).alias("n")).first()["n"] or 0) // SHARD)
    rows = rows.select("ids", F.xxhash64(F.lit(7), "doc_id", "ids").alias("at")).repartition(shards, "at").sortWithinPartitions("at", "ids")
    shared = spark.sparkContext.broadcast((v, weights))
    shapes = [(n, weights[n].shape) for n in Network.NAMES]
    cuts = np.cumsum([weights[n].size for n in Network.NAMES])
    segments = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = shared.value
        net = Network(v, {n: a.copy() for n, a in w.items()})
        m1, m2 = {n: np.zeros_like(a) for n, a in w.items()}, {n: np.zeros_like(a) for n, a in w.items()}
        end, step, seen, size = np.array([_end(v)]), 0, 0, 0
        held: list[np.ndarray] = []

        def learn(flat: np.ndarray) -> None:
            """Texts one after the other in TRAIN_BATCH streams, so that every window is full."""
            nonlocal step, seen
            steps = -(-len(flat) // TRAIN_BATCH)
            before = np.concatenate([[START], flat[:-1]])
            before = np.where(before == end[0], START, before)
            real = np.arange(steps * TRAIN_BATCH) < len(flat)
            shape = lambda a, pad: np.concatenate([a, np.full(steps * TRAIN_BATCH - len(flat), pad)]).reshape(TRAIN_BATCH, steps).T
            x, y, real = shape(before, START), shape(flat, end[0]), real.reshape(TRAIN_BATCH, steps).T
            h = np.zeros((TRAIN_BATCH, STATE), np.float32)
            for at in range(0, steps, WINDOW):
                g, h = net.gradients(x[at : at + WINDOW], y[at : at + WINDOW], real[at : at + WINDOW], h)
                step += 1
                seen += int(real[at : at + WINDOW].sum())
                for k in Network.NAMES:
                    m1[k] += 0.1 * (g[k] - m1[k])
                    m2[k] += 0.01 * (g[k] * g[k] - m2[k])
                    net.w[k] -= RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)

        for b in batches:
            for raw in b.column("ids").to_pylist():
                ids = np.frombuffer(raw, "<u2")
                held += [ids, end]
                size += len(ids) + 1
                if size >= TRAIN_BATCH * WINDOW * STREAM:
                    learn(np.concatenate(held).astype(np.int64))
                    held, size = [], 0
        if held:
            learn(np.concatenate(held).astype(np.int64))
        if seen:
            flat = np.concatenate([net.w[n].ravel() for n in Network.NAMES]) * np.float32(seen / 1e6)
            task = TaskContext.get().partitionId()
            parts = np.array_split(flat, segments)
            yield pa.RecordBatch.from_arrays([pa.array(list(range(segments)), pa.int32()), pa.array([task % 64] * segments, pa.int32()), pa.array([seen / 1e6] * segments, pa.float64()), pa.array([p.astype(np.float64).tobytes() for p in parts], pa.binary())], ["segment", "grp", "n", "w"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["w"].iloc[0]) // 8)
        for raw in pdf["w"]:
            total += np.frombuffer(raw)
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "grp": [pdf["grp"].iloc[0]], "n": [pdf["n"].sum()], "w": [total.tobytes()]})

    schema = "segment int, grp int, n double, w binary"
    rows = lean(rows).select("ids").mapInArrow(run, schema).groupBy("segment", "grp").applyInPandas(add, schema).groupBy("segment").applyInPandas(add, schema).collect()  # one set of weights
    if not rows:
        return weights
    flat = np.concatenate([np.frombuffer(r["w"]) / r["n"] for r in sorted(rows, key=lambda r: r["segment"])]).astype(np.float32)
    return {n: p.reshape(s) for (n, s), p in zip(shapes, np.split(flat, cuts[:-1]), strict=True)}


def learn(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Counts and vocabulary of the training documents ``docs``."""
    counts = cut(count_tokens(docs))
    return counts, vocabulary(counts)


def train(rows: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """Weights learnt from encoded training documents, all of them, a disjoint part a round."""
    weights = Network(v).w
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id", "ids"), F.lit(ROUNDS))
    for r in range(ROUNDS):
        weights = _train(rows.where(part == r), v, weights)
    return weights


def score(rows: DataFrame, counts: DataFrame, v: Vocabulary, weights: dict[str, np.ndarray]) -> DataFrame:
    """(row, doc_id, n_tokens, n_known, base_score, score) for each of the encoded ``rows`` (a table cut from its lineage)."""
    shared = rows.sparkSession.sparkContext.broadcast((v, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = shared.value
        net, end = Network(v, w), _end(v)
        ids: list = []
        seqs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
            mine = [seqs[i] for i in order]
            h, total = np.zeros((len(mine), STATE), np.float32), np.zeros(len(mine))
            for n, x, y, real in _windows(mine, end, START, WINDOW, SCORE_TOKENS):
                hs, h = net.run(x, h[:n])
                flat = np.flatnonzero(real.ravel())
                p = net.log_p(hs.reshape(-1, STATE)[flat], y.ravel()[flat])
                total[:n] += np.bincount(flat % n, p, n)
            ln = np.empty(len(mine))
            ln[order] = total / np.log(10)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ln)], ["row", "net"])
            ids.clear(), seqs.clear()
            return out

        for b in batches:
            for i, raw in zip(b.column("row").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids.append(i)
                seqs.append(np.frombuffer(raw, "<u2").astype(np.int64))
                held += len(seqs[-1]) + 1
                if len(seqs) >= SCORE_DOCS or held > 8_000_000:
                    yield flush()
                    held = 0
        if seqs:
            yield flush()

    _, end_known, end_log = (x[0] for x in v.look(np.array([END]), np.zeros(1, np.int64)))
    end = _end(v)
    end_own = float(end_log - np.log10(max(v.mass[end - WORDS], 1.0))) if end >= WORDS else 0.0
    net = lean(rows).select("row", "ids").mapInArrow(run, "row long, net double")
    tail = rows.where(F.size("tail") > 0).select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("h"), F.col("t.tail_n").alias("n")).join(counts.select("h", "c"), "h")
    tail = tail.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_log"))
    met = rows.select("row", "doc_id", "size", "n_head", "log", "own").join(net, "row").join(tail, "row", "left")
    log, n = F.coalesce("more_log", F.lit(0.0)), F.col("size") + 1
    known = F.col("n_head") + F.lit(int(end_known)) + F.coalesce("more", F.lit(0))
    base = F.col("log") + F.lit(float(end_log)) + log - n * F.lit(float(np.log10(v.total + v.distinct + 1)))
    return met.select("row", "doc_id", n.alias("n_tokens"), known.alias("n_known"), base.alias("base_score"), (F.col("net") + F.col("own") + F.lit(end_own) + log).alias("score"))


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): trained where crc32(doc_id) mod 7 is not 2."""
    counts, v = learn(docs.where(crc_mod("doc_id", 7) != 2))
    rows = cut(encode(docs, v))
    got = score(rows, counts, v, train(rows.where(crc_mod("doc_id", 7) != 2), v))
    return got.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")
