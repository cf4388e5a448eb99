"""The n-gram Jaccard join on a large group of near copies and a passage that many documents share, against all pairs."""

import numpy as np
import pytest

from ledgerline.llm import ngram_join


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> smallest doc_id reachable by links, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=lambda i: rows[i][0])
                root[y] = x
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(5000)])
    base, passage = rng.choice(words, 90), list(rng.choice(words, 60))
    rows = []
    for _ in range(150):  # near copies that differ by one to four words: some pairs link, some are only reachable
        w = base.copy()
        w[rng.integers(0, len(w), rng.integers(1, 5))] = rng.choice(words)
        rows.append(" ".join(w))
    for k in range(120):  # one passage with some words around it, so that similarities lie on both sides of the threshold
        rows.append(" ".join([*rng.choice(words, k % 13), *passage, *rng.choice(words, k % 7)]))
    rows += [" ".join(rng.choice(words, 50)) for _ in range(60)]
    rows += rows[:40] + [None, "", " ", "one two", "One  two", "x " * 3000, " ".join(passage * 2)]
    return list(zip(rng.permutation(len(rows)).tolist(), rows, strict=True))


@pytest.mark.parametrize("block", [ngram_join.BLOCK_CLASSES, 24])
def test_matches_all_pairs(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)  # 24: several blocks per shingle
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_copies(docs).collect()}
    want = brute(corpus)
    assert got == {i: (len(shingles(t)), want[i]) for i, t in corpus}
    assert len(set(want.values())) > 60 and len([1 for c in want.values() if c == want[corpus[0][0]]]) > 50


def test_extra_columns(spark, corpus):
    names = ["_gone", "_maybe", "a.b", "component_id", "prefix", "class"]
    docs = spark.createDataFrame([(i, t, *[str(i)] * len(names)) for i, t in corpus[-30:]], ["doc_id", "text", *names])
    left = ngram_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    want = brute(corpus[-30:])
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(want.values()))


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = ngram_join.intersections(sets)
    assert all(got[i, j] == want[i][j] for i in range(20) for j in range(20) if i != j)
