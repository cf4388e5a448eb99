"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed lower-cased words (without the punctuation around them); the score is
``sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)``, so that a pair such as an insult with a group's name may weigh more
than its parts.  The model is fitted on a bounded sample of labelled rows (``MOST_ROWS``, a documented parameter):
labelled ids are taken by hash, the same ones on every run.  Scoring reads every whole text in one pass without a shuffle.

Cases: a null text counts as empty and gets the score of the empty set; a null doc_id counts as the empty id; rows whose
label is null or neither 0 nor 1 are not learnt from; repeated labels of a document are learnt once (toxic if any says
so); without labelled rows every score is 0.5 (0 for ``predicted`` is then decided by >= 0.5, so 1); an empty table gives
an empty result; extra columns are passed over or kept (``drop_toxic``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import crc_mod, lean, mix64, tokens, U

MOST_ROWS = 8_000  #: labelled documents that the model is fitted on at most
TERM_BITS = 18
FEATURES = 2048  #: hashed terms with weights of their own, picked by how much they tell of the label
LEAST_CHI = 10.0  #: a term with a smaller chi-square (about one chance in 600) tells too little
FACTORS = 4
EDGE = np.ones(256, dtype=bool)  #: bytes that are trimmed from a word's ends
EDGE[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = False


def term_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct hashed terms of each text."""
    for t in tokens(column):
        if not len(t.starts):
            yield from (np.zeros(0, np.int64) for _ in t.bounds[1:])
            continue
        a, z = t.starts.copy(), t.ends.copy()
        while len(go := np.flatnonzero((a < z) & EDGE[t.buf[np.minimum(a, len(t.buf) - 1)]])):
            a[go] += 1
        while len(go := np.flatnonzero((a < z) & EDGE[t.buf[z - 1]])):
            z[go] -= 1
        up, down = t.powers()
        with np.errstate(over="ignore"):
            h = mix64((t.total[z] - t.total[a]) * down[a] + (z - a).astype(U))
        h = (h >> U(64 - TERM_BITS)).astype(np.int64)
        for lo, hi in zip(t.bounds[:-1], t.bounds[1:], strict=True):
            s = h[lo:hi][a[lo:hi] < z[lo:hi]]
            yield np.unique(s)


class FactorMachine:
    """Weights over ``terms`` (sorted); fitted by Adam on batches of dense 0/1 rows, both labels weighing the same."""

    def __init__(self, terms: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.terms, self.w0, self.w, self.v = terms, w0, w, v

    def raw(self, sets: list[np.ndarray]) -> np.ndarray:
        if not len(self.terms):
            return np.full(len(sets), self.w0)
        n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        hit = self.terms[at] == flat
        doc, at = np.repeat(np.arange(len(sets)), n)[hit], at[hit]
        lin = np.bincount(doc, self.w[at], len(sets)).astype(np.float64)  # counts are integers where nothing is hit
        for f in range(self.v.shape[1]):
            v = self.v[at, f]
            lin += 0.5 * (np.bincount(doc, v, len(sets)) ** 2 - np.bincount(doc, v * v, len(sets)))
        return self.w0 + lin

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(sets), -40, 40)))

    @staticmethod
    def fit(sets: list[np.ndarray], labels: np.ndarray, steps: int = 240, seed: int = 7) -> FactorMachine:
        y = labels.astype(np.float64)
        if not len(y) or y.min() == y.max():
            p = (y.sum() + 1) / (len(y) + 2)
            return FactorMachine(np.zeros(0, np.int64), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, FACTORS)))
        flat = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        size = 1 << TERM_BITS
        df, pos = np.bincount(flat, minlength=size), np.bincount(flat, y[doc], size)
        rate = y.mean()
        # chi-square of presence against label; a term's frequency is large enough to tell
        chi = np.where(df >= 5, (pos - df * rate) ** 2 / np.maximum(df * rate * (1 - rate) * (1 - df / len(y)), 1e-9), 0)
        terms = np.sort(np.argsort(-chi, kind="stable")[: min(FEATURES, int((chi > LEAST_CHI).sum()))])
        at = np.minimum(np.searchsorted(terms, flat), max(len(terms) - 1, 0))
        hit = terms[at] == flat if len(terms) else np.zeros(len(flat), bool)
        doc, at = doc[hit], at[hit]
        x = np.zeros((len(y), len(terms)), dtype=np.float32)
        x[doc, at] = 1
        rng = np.random.default_rng(seed)
        w0, w, v = float(np.log(rate / (1 - rate))), np.zeros(len(terms), np.float32), rng.normal(0, 0.05, (len(terms), FACTORS)).astype(np.float32)
        m = [np.zeros(1), np.zeros_like(w), np.zeros_like(v)]
        s = [np.zeros(1), np.zeros_like(w), np.zeros_like(v)]
        weight = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)).astype(np.float32)
        batch = 1024
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(y), batch) if len(y) > batch else np.arange(len(y))
            xb = x[rows]
            q = xb @ v
            z = w0 + xb @ w + 0.5 * ((q**2).sum(1) - xb @ (v**2).sum(1))
            g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grads = [np.array([g.sum()]), xb.T @ g + 2e-4 * w, xb.T @ (g[:, None] * q) - v * (xb.T @ g)[:, None] + 2e-3 * v]
            new = []
            for k, (p, d) in enumerate(zip((np.array([w0]), w, v), grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.99 * s[k] + 0.01 * d * d
                new.append(p - 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6))
            w0, w, v = float(new[0][0]), new[1].astype(np.float32), new[2].astype(np.float32)
        return FactorMachine(terms, w0, w.astype(np.float64), v.astype(np.float64))


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> FactorMachine:
    """Fit on at most about ``most_rows`` labelled documents whose crc32(doc_id) mod 5 is not 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    known = known.where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * most_rows / n))
    # bounded by most_rows: small enough to be sent to every executor
    texts = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic", F.xxhash64("doc_id", "text").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("toxic"), pa.array([s.astype(np.int32).tobytes() for s in term_sets(b.column("text"))], pa.binary())], ["at", "toxic", "terms"])

    rows = sorted(texts.mapInArrow(run, "at long, toxic int, terms binary").toLocalIterator(), key=lambda r: (r["at"], r["toxic"]))
    return FactorMachine.fit([np.frombuffer(r["terms"], np.int32).astype(np.int64) for r in rows], np.array([r["toxic"] for r in rows], dtype=np.int64))


def score(docs: DataFrame, model: FactorMachine) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores(list(term_sets(b.column("text")))), pa.float64())], ["doc_id", "score"])

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: FactorMachine, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(list(term_sets(pa.array(texts, pa.string())))), index=texts.index, dtype="float64")

    name = f"_score_{uuid.uuid4().hex}"
    return lean(docs).withColumn(name, rate(F.col("text").cast("string"))).where(F.col(name) < threshold).drop(name)
