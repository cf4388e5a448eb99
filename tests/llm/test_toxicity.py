"""The factorization machine: its score against the explicit sum over pairs, and pairs that no additive model tells apart."""

import itertools
import math

import numpy as np

from ledgerline.llm.toxicity import FactorMachine


def test_sum_over_pairs():
    rng = np.random.default_rng(1)
    terms = np.sort(rng.choice(10_000, 30, replace=False))
    model = FactorMachine(terms, -0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    sets = [np.sort(rng.choice(terms, n, replace=False)) for n in (0, 1, 2, 7, 30)] + [np.array([3, 5], np.int64)]
    for s, got in zip(sets, model.scores(sets), strict=True):
        at = [int(np.flatnonzero(terms == t)[0]) for t in s if t in terms]
        z = model.w0 + sum(model.w[i] for i in at) + sum(model.v[i] @ model.v[j] for i, j in itertools.combinations(at, 2))
        assert math.isclose(got, 1 / (1 + math.exp(-max(-40, min(40, z)))), rel_tol=1e-9)


def test_planted_interaction():
    """Two insults and two groups: each insult is toxic with one group and clean with the other, so that both kinds of
    documents hold words of the same weights; only the products of a pair tell them apart."""
    rng = np.random.default_rng(2)
    one, two, red, blue = 1, 2, 3, 4

    def texts(pair, n):
        return [np.unique(np.concatenate([pair, rng.integers(100, 300, 12)])).astype(np.int64) for _ in range(n)]

    def corpus(n):
        sets = texts([one, red], 2 * n) + texts([two, blue], 2 * n) + texts([one, blue], n) + texts([two, red], n) + texts([], 6 * n)
        return sets, np.array([1] * (4 * n) + [0] * (8 * n))

    model = FactorMachine.fit(*corpus(100))
    sets, labels = corpus(40)
    right = (model.scores(sets) >= 0.5) == labels
    additive = FactorMachine(model.terms, model.w0, model.w, np.zeros_like(model.v))
    assert right.mean() > 0.95 and right[160:240].mean() > 0.85
    assert ((additive.scores(sets) >= 0.5) == labels).mean() < 0.9
