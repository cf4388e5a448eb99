"""The numbered operators against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from ledgerline.llm import dedup, embedding_dedup, html_text, licenses, lm_score, mixing, ngram_join, packing, token_counts, toxicity

BASE = "the quick brown fox jumps over the lazy dog while seven wise men look on from the old stone bridge at noon today"
SCHEMA = "doc_id long, text string, source string, a string, lang string"


def texts():
    w = BASE.split()
    near = " ".join([*w[:-1], "yesterday"])
    return [
        (1, BASE, "s1"), (2, BASE.upper(), "s1"), (3, near, "s2"), (4, None, None), (5, "", "s2"), (6, " \n\t ", "s3"), (7, "One Two", "s1"), (8, "one two", "s1"), (9, "x " * 5000, "s1"),
        (10, "Released under the MIT License. See Apache-License", "s2"), (11, "GNU General Public License, version 3 and mit license mit license", "s3"), (12, "naïve café don't <|endoftext|> 12a3,,4", "s2"), (12, "naïve café don't <|endoftext|> 12a3,,4", "s2"), (None, "no id here at all", "s3"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "clash", "en") for i, t, s in texts()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return (t or "").encode().lower()


def test_exact_dedup(docs, empty):
    got = dedup.copies(docs).toPandas()
    groups = {}
    for i, t, _ in texts():
        groups.setdefault(hashlib.sha256(low(t)).digest(), []).append(i)
    assert len(got) == len(texts()) and got["kept"].sum() == len(groups)
    for r in got.itertuples():
        ids = groups[bytes(r.sha)]
        assert r.group_size == len(ids)
        best = max((i for i in ids if i is not None), default=None)
        assert (best is None and np.isnan(r.keep_id)) or r.keep_id == best
    kept = dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert dedup.copies(empty).count() == 0 and dedup.drop_copies(empty).count() == 0


def shingles(t):
    w = low(t).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_ngram_join(docs, empty):
    rows = texts()
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    want = sorted((str(i), len(s), str(min((rows[k][0] for k in range(len(rows)) if root[k] == root[j] and rows[k][0] is not None), default=None))) for j, ((i, _, _), s) in enumerate(zip(rows, sets, strict=True)))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.near_copies(docs).collect())
    assert got == want
    assert ngram_join.near_copies(empty).count() == 0
    left = {r["doc_id"] for r in ngram_join.drop_near_copies(docs).collect()}
    assert {1, 7, 4, 5, 6, 12} <= left and not left & {2, 3, 8}


def test_mixing(docs, empty):
    got = mixing.takes(docs).toPandas()
    want = {}
    for _, t, s in texts():
        want[s] = want.get(s, 0) + len(low(t).split())
    order = sorted((s for s in want if s is not None)) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, target, free = sum(want.values()), {}, set(want)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * want[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * want[s] for s in over}
        free -= over
    for s, rows in got.groupby("source", dropna=False):
        s = None if s is None or s != s else s
        assert math.isclose(rows["target"].iloc[0], target[s], abs_tol=1e-6)
        assert abs(rows["taken"].sum() - target[s]) <= 1
    assert (got["taken"] <= 3 * got["size"]).all()
    assert sorted(map(str, mixing.takes(docs).collect())) == sorted(map(str, mixing.takes(docs).collect()))
    assert mixing.takes(empty).count() == 0
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    assert sum(len(low(r["text"]).split()) for r in copies.collect()) == got["taken"].sum()


CLASHES = ["_sha", "_keep", "_taken", "_size", "_copy", "_rows", "_id", "_key", "_source", "_gone", "_maybe", "a.b", "size", "key", "row", "sha", "taken", "d", "g", "p"]


def test_clashing_columns(spark):
    """Extra columns of any name are passed over, or kept with what they hold."""
    rows = [(i, t, s, *[f"{c}{i}" for c in CLASHES]) for i, t, s in texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    for out in (dedup.drop_copies(docs), mixing.mixed(docs), toxicity.drop_toxic(docs, model)):
        assert out.columns == docs.columns
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in CLASHES)
    assert dedup.copies(docs).count() == mixing.takes(docs).count() == licenses.scan(docs).count() == len(rows)
    assert token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")).count() == lm_score.score_documents(docs).count() == len(rows)
    assert packing.pack(docs, vocabulary("word_bpe_49k.json")).count() >= len(rows)


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, 64).toPandas()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in texts()}
    for r in got.itertuples():
        part = ids[None if np.isnan(r.doc_id) else int(r.doc_id)][r.start : r.start + 64]
        assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert got["length"].sum() == sum(len(ids[i]) for i, _, _ in texts())
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["length"].sum() <= 64 and list(rows["offset"]) == [0, *np.cumsum(rows["length"])[:-1]]
    assert packing.pack(empty, path).count() == 0


def _histogram(sizes):
    sizes, n = np.unique(sizes, return_counts=True)
    return dict(zip(sizes.tolist(), n.tolist(), strict=True))


@pytest.mark.parametrize("kind", ["lognormal", "large", "thirds", "one length", "tiny"])
def test_packing_program(kind):
    """Every piece has a place, most of them by the program's configurations, and no more sequences than best fit needs (but 0.1 %)."""
    rng = np.random.default_rng(3)
    sizes = {"lognormal": lambda: np.minimum(rng.lognormal(5.5, 1.2, 6_000).astype(int) + 1, 2048), "large": lambda: rng.integers(300, 1400, 5_000), "thirds": lambda: rng.integers(600, 760, 6_000), "one length": lambda: np.full(1_000, 700), "tiny": lambda: rng.integers(1, 9, 5)}[kind]()
    histogram = _histogram(sizes)
    plan, left = packing.program(histogram)
    if kind != "tiny":
        assert sum(left.values()) <= 0.1 * len(sizes)
    full = packing.solve(histogram)
    held = {}
    for times, filling in full:
        assert times > 0 and sum(s * c for s, c in filling.items()) <= 2048
        for s, c in filling.items():
            held[s] = held.get(s, 0) + c * times
    assert held == histogram
    n = sum(t for t, _ in full)
    assert n <= math.ceil(1.001 * sum(t for t, _ in packing._best_fit(histogram, 2048)))
    if kind == "thirds":  # three fit only if the program pairs long ones with short ones: best fit needs a tenth more
        assert n <= 1.02 * sum(s * c for s, c in histogram.items()) / 2048
    assert packing.solve({}) == []


def test_packing_knapsack():
    """The dynamic program against all fillings."""
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes, most, value = np.sort(rng.choice(np.arange(1, 15), 4, replace=False))[::-1], rng.integers(0, 4, 4), rng.random(4)
        got = packing._price(value, sizes, most, 20)
        assert (got <= most).all() and got @ sizes <= 20
        best = max(np.array(c) @ value for c in itertools.product(*(range(m + 1) for m in most)) if np.array(c) @ sizes <= 20)
        assert math.isclose(got @ value, best, abs_tol=1e-9)


def test_packing_memory(monkeypatch):
    """Ids stay those of the tokenizer when units share places of the memory and when it starts anew."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "SLOT_BITS", 4)
    monkeypatch.setattr(packing, "SLOTS", 16)
    monkeypatch.setattr(packing, "MOST_IDS", 50)
    monkeypatch.setattr(packing, "_memory", {})
    texts = ["alpha beta alpha 12 don't", "", None, "gamma, delta! (alpha) 3.14 \u00e9t\u00e9 \u4f60\u597d", "alpha beta"] * 40
    got = list(packing.token_ids(pa.array(texts, pa.string()), path)) + list(packing.token_ids(pa.array(texts[::-1], pa.string()), path))
    for t, ids in zip(texts + texts[::-1], got, strict=True):
        assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_licenses(docs, empty):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[10]["n_base"] == 2 and got[10]["base_labels"] == "apache,mit" and (got[10]["first_word"], got[10]["last_word"]) == (3, 6)
    assert got[11]["n_base"] == 3 and "gpl-3.0" in got[11]["labels"].split(",") and got[11]["first_word"] == 1
    assert got[4]["labels"] == "" and got[4]["n_words"] == 0 and got[1]["score"] == 0 and got[1]["first_word"] is None
    assert len(got) + 1 == licenses.scan(docs).count() and licenses.scan(empty).count() == 0


def test_licenses_separators(spark):
    """What stands between the words of a notice does not matter."""
    notices = {
        "All rights{}reserved": "proprietary", "CC{}BY{}4.0": "cc-by-4.0", "cc{}by{}nc{}4{}0": "cc-by-nc-4.0", "cc{}by{}sa{}4{}0": "cc-by-sa-4.0", "the public{}domain": "public-domain",
        "Permission is hereby{}granted, free of{}charge, to any person obtaining a{}copy": "mit", "Permission to{}use, copy, modify, and/or distribute this software for any{}purpose": "isc",
        "Redistribution{}and use in source and binary forms, with or without{}modification, are permitted": "bsd", "the MIT{}License": "mit",
    }
    cases = [(text.replace("{}", gap), label) for text, label in notices.items() for gap in (" ", "\n", "\r\n * ", "\t", "  ", "_", "--")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [t for i, (t, label) in enumerate(cases) if label not in got[i]["labels"].split(",") or got[i]["score"] == 0] == []
    # every rule that does not hold "licen" has its word in the gate
    rest = [p for _, _, p, _, _, _ in licenses.rule_rows() if not any(g in p for g in licenses.GATE)]
    assert all("cc by" in p for p in rest)


def _matches(pattern, most):
    """A match of a rule's pattern: first branches, and optional parts left out or taken (``most``)."""
    from re import _parser

    def walk(items):
        out = ""
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "SUBPATTERN":
                out += walk(arg[3])
            elif op == "BRANCH":
                out += walk(arg[1][-1 if most else 0])
            elif op == "NOT_LITERAL":
                out += "x"
            elif op == "IN":
                out += "x" if str(arg[0][0]) == "NEGATE" else chr(arg[-1 if most else 0][1])
            elif op == "MAX_REPEAT":
                lo, hi, part = arg
                out += walk(part) * (min(hi, lo + 1) if most else lo)
            else:
                assert op == "ASSERT_NOT", op
        return out

    return walk(_parser.parse(pattern))


def test_license_rules(spark):
    """Every rule finds its own text, and the scan finds what all rules find without the gate and the keywords."""
    import re

    rules = licenses.rule_rows()
    assert len(rules) > 200 and len({r[2] for r in rules}) == len(rules)
    cases = [_matches(r[2], most) for r in rules for most in (False, True)]
    for (_, label, pattern, key, _, _), one, two in zip(rules, cases[::2], cases[1::2], strict=True):
        assert re.search(pattern, one) and re.search(pattern, two) and key in one and key in two, label
        assert all(any(g in x for g in (*licenses.GATE, "cc by")) for x in (one, two)), label
    cases += [" and ".join(cases[i : i + 5]) for i in range(0, len(cases), 37)] + ["licenses of mitten apachelike", "no license"]

    def brute(words):
        found = []
        for i, label, pattern, _, _, rank in rules:
            for m in re.finditer(pattern, words):
                a = len(words[: m.start()].split())
                found.append((a, -(a + len(m[0].split())), -rank, i, label))
        labels, reach = {label for p, label in licenses.BASE if f" {p} " in f" {words} "}, -1
        for _, last, _, _, label in sorted(found):
            if -last > reach:
                labels.add(label)
            reach = max(reach, -last)
        return ",".join(sorted(labels))

    rows = [(i, c.upper() if i % 2 else c.replace(" ", "\n ")) for i, c in enumerate(cases)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(c, got[i], brute(c)) for i, c in enumerate(cases) if got[i] != brute(c)] == []


def test_html():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class='cookie-notice'>We use cookies on this site, please accept them all.</div><article><h1>Head &amp; tail</h1><p>A first   paragraph of some length,\nover two lines.<p>Second <b>bold</b> one.</article><div id=comments>A reader's comment that is quite long, longer than forty characters.</div><footer>&copy; x</footer><script>var a='<p>'</script></body></html>"
    assert html_text.extract(page) == "Head & tail\nA first paragraph of some length, over two lines.\nSecond bold one."
    assert html_text.extract(None) == "" and html_text.extract("") == "" and html_text.extract("<script>x") == ""
    plain = "<body><ul class=menu><li>a</li></ul><p>" + "word " * 30 + "</p><p>short end</p><div class=footer>foot</div>"
    assert html_text.extract(plain) == ("word " * 30).strip() + "\nshort end"


def test_token_counts(docs, empty):
    scores = {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.5, "aba": -3.5}
    trie = token_counts.Trie(scores)

    def brute(w):
        best = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            size = len(w[end - 1].encode())
            options = [(best[end - 1][0] + token_counts.BYTE_SCORE * size, best[end - 1][1] + size)]
            options += [(best[s][0] + scores[w[s:end]], best[s][1] + 1) for s in range(end) if w[s:end] in scores]
            best.append(max(options, key=lambda o: (o[0], -o[1])))
        return best[-1][1]

    words = ["▁" + "".join(c) for c in ("abab", "aba", "abba", "xé", "a", "b" * 40, "")]
    assert trie.counts(words) == [brute(w) for w in words]
    path = vocabulary("piece_bpe_32k.model")
    got = token_counts.count_tokens(docs, path).toPandas()
    assert (got["n_words"].sum(), len(got)) == (sum(len(low(t).split()) for _, t, _ in texts()), len(texts()))
    assert (got["n_tokens"] >= got["n_words"]).all() and token_counts.count_tokens(empty, path).count() == 0


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        t = list(rng.choice(words, 40))
        bad = i % 6 == 0
        if bad:
            t[5] = ("idiot", "moron", "scum")[i % 3]
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 6 == 0) for i in held]) > 0.97
    assert toxicity.score(docs, model).count() == len(texts()) and toxicity.score(empty, model).count() == 0
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()} >= {1, 4, 5, 7}
    none = toxicity.learn(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 16))
    x = [centre[i % 20] + rng.normal(scale=0.15, size=16) if i % 3 == 0 else rng.normal(size=16) for i in range(600)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, x[0].tolist()), (601, None), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [1.0, None]), (605, [1.0, 2.0])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = np.array([*x, x[0]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(1) - 1
    mine = np.array([got[i]["n_links"] for i in range(601)])
    assert (mine <= links).all() and mine.sum() >= 0.95 * links.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(601, 606))
    assert got[600]["component_id"] == got[0]["component_id"] and got[0]["n_links"] >= 1


def test_embedding_audit(spark, monkeypatch):
    """Lost pairs show beside a large group that was found, and a search that keeps missing them ends in an error."""
    rng = np.random.default_rng(6)
    centre, pairs = rng.normal(size=32), rng.normal(size=(60, 32))
    x = [*(centre + rng.normal(scale=0.1, size=(300, 32))), *pairs, *(pairs + rng.normal(scale=0.05, size=pairs.shape))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = embedding_dedup.unit_vectors(table).selectExpr("node", "unit", "1L AS copies", "vec_id AS least").cache()
    group = nodes.where("least < 300").selectExpr("node", "0L AS label", "299L AS links")
    assert embedding_dedup.audit_recall(nodes, len(x), group) < 0.1
    whole = group.union(nodes.where("least >= 300").selectExpr("node", "least AS label", "1L AS links"))
    assert embedding_dedup.audit_recall(nodes, len(x), whole) == 1
    monkeypatch.setattr(embedding_dedup, "_links", lambda *_: group)
    with pytest.raises(RuntimeError, match="audited links"):
        embedding_dedup.near_duplicates(table)
    met = [1 - (1 - (1 - math.acos(0.9) / math.pi) ** embedding_dedup._bits(n)) ** embedding_dedup.start_tables(n) for n in (500, 50_000, 3_000_000)]
    assert min(met) >= 0.95


def test_lm_score(docs, empty):
    got = lm_score.score_documents(docs).toPandas()
    train = [t for i, t, _ in texts() if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    count = {}
    for t in train:
        for w in low(t).split():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + len(train), len(count) + 1
    want = sorted((len(low(t).split()) + 1, round(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in low(t).split()) + math.log10((len(train) + 1) / (n + v + 1)), 6)) for _, t, _ in texts())
    assert sorted(zip(got["n_tokens"], got["base_score"].round(6), strict=True)) == want
    assert set(got["train_tokens"]) == {n} and (got["score"] < 0).all()
    assert lm_score.score_documents(empty).count() == 0


def test_lm_trains_on_every_document(spark, monkeypatch):
    """The rounds are disjoint and together hold each training document once."""
    table = spark.createDataFrame([(i, f"text {i} of many", "s", "a", "en") for i in range(400)] + [(None, "no id", "s", "a", "en"), (400, None, "s", "a", "en")], SCHEMA)
    seen = []
    monkeypatch.setattr(lm_score, "_train", lambda part, v, weights: seen.append([r["doc_id"] for r in part.collect()]) or weights)
    _, v = lm_score.learn(table)
    lm_score.train(lm_score.encode(table, v), v)
    assert len(seen) == lm_score.ROUNDS and all(seen)
    assert sorted(map(str, sum(seen, []))) == sorted(map(str, [*range(401), None]))


def grammar(spark, n):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, " ".join(x for _ in range(20) for x in (("a", "b", "c"), ("d", "e", "f"))[rng.integers(2)])) for i in range(n)], "doc_id long, text string")


def test_lm_layout(spark, monkeypatch):
    """Scores are the same for 1 and 16 partitions."""
    monkeypatch.setattr(lm_score, "SHARD", 4000)  # several shards
    one, many = (lm_score.score_documents(grammar(spark, 600).repartition(n)).toPandas().sort_values("doc_id", ignore_index=True) for n in (1, 16))
    assert np.allclose(one["score"], many["score"], rtol=0, atol=1e-4) and (one["n_known"] == many["n_known"]).all()


def test_lm_gain(spark):
    """Held-out texts that follow a grammar score better than by their words alone."""
    got = lm_score.score_documents(grammar(spark, 5000)).where("held_out").selectExpr("sum(score)", "sum(base_score)", "count(*)").first()
    assert got[2] > 500 and got[0] > 0.9 * got[1]


def test_lm_probabilities():
    """Probabilities of all words and of the unknown one of each class sum to 1, in any state."""
    rng = np.random.default_rng(9)
    kind = rng.integers(0, lm_score.KINDS, 3000)
    c = np.arange(3000, 0, -1)
    v = lm_score.Vocabulary(np.arange(3000), c, kind, np.bincount(kind, c + 1.0, lm_score.KINDS), int(c.sum()), 3000)
    net = lm_score.Network(v)
    net.w = {k: w + rng.normal(0, 0.3, w.shape).astype(np.float32) for k, w in net.w.items()}
    for h in rng.normal(0, 0.5, (3, lm_score.STATE)).astype(np.float32):
        y = np.arange(lm_score.WORDS + lm_score.KINDS)
        assert math.isclose(np.exp(net.log_p(np.repeat(h[None], len(y), 0), y).astype(float)).sum(), 1, abs_tol=1e-3)
    rare = np.bincount(kind[lm_score.WORDS :], c[lm_score.WORDS :] + 1.0, lm_score.KINDS) + 1  # of the words of a class, and its unknown one
    assert np.allclose(rare, v.mass)


def test_lm_large_logits(monkeypatch):
    """Logits beyond what exponents hold give the same probabilities as small ones, shifted or not."""
    rng = np.random.default_rng(9)
    kind = rng.integers(0, lm_score.KINDS, 300)
    c = np.arange(300, 0, -1)
    v = lm_score.Vocabulary(np.arange(300), c, kind, np.bincount(kind, c + 1.0, lm_score.KINDS), int(c.sum()), 300)
    net, h, y = lm_score.Network(v), rng.uniform(-1, 1, (40, lm_score.STATE)).astype(np.float32), rng.integers(0, 300, 40)
    plain = net.log_p(h, y)
    monkeypatch.setattr(lm_score, "SAFE", 0.0)
    assert np.allclose(plain, net.log_p(h, y), atol=1e-4)
    net.w["bc"] = net.w["bc"] + np.float32(500)
    assert np.allclose(plain, net.log_p(h, y), atol=1e-3)


def test_lm_state_is_carried():
    """Windows of any width give a text the same probability."""
    rng = np.random.default_rng(2)
    kind = rng.integers(0, lm_score.KINDS, 50)
    v = lm_score.Vocabulary(np.arange(50), np.full(50, 3), kind, np.bincount(kind, np.full(50, 4.0), lm_score.KINDS), 150, 50)
    net = lm_score.Network(v)
    net.w = {k: w + rng.normal(0, 0.3, w.shape).astype(np.float32) for k, w in net.w.items()}
    seqs = sorted((rng.integers(0, 50, n) for n in (0, 1, 16, 33, 70)), key=len, reverse=True)

    def total(width):
        h, out = np.zeros((len(seqs), lm_score.STATE), np.float32), np.zeros(len(seqs))
        for n, x, y, real in lm_score._windows(seqs, lm_score._end(v), lm_score.START, width):
            hs, h = net.run(x, h[:n])
            flat = np.flatnonzero(real.ravel())
            out[:n] += np.bincount(flat % n, net.log_p(hs.reshape(-1, lm_score.STATE)[flat], y.ravel()[flat]), n)
        return out

    assert np.allclose(total(7), total(100), atol=1e-3) and np.allclose(total(16), total(100), atol=1e-3)


def test_lm_gradients():
    """Gradients against differences of the mean log probability, texts' starts and padding included."""
    rng = np.random.default_rng(4)
    kind = rng.integers(0, lm_score.KINDS, 300)
    c = np.arange(300, 0, -1) * 10
    v = lm_score.Vocabulary(np.arange(300), c, kind, np.bincount(kind, c + 1.0, lm_score.KINDS), int(c.sum()), 300)
    net = lm_score.Network(v)
    net.w = {k: w.astype(np.float64) + rng.normal(0, 0.1, w.shape) for k, w in net.w.items()}
    x, y = rng.integers(0, 300, (5, 6)), rng.integers(0, 300, (5, 6))
    y[0, 0], x[0, :3], x[3, 1] = lm_score.WORDS + 5, lm_score.START, lm_score.START
    real, h0 = np.ones(x.shape, bool), np.zeros((6, lm_score.STATE))
    real[4, 5] = False
    mean = lambda: -net.log_p(net.run(x, h0)[0].reshape(-1, lm_score.STATE)[real.ravel()], y[real]).astype(float).mean()
    g, _ = net.gradients(x, y, real, h0)
    for name in lm_score.Network.NAMES:
        way = np.where(g[name] == 0, 0, np.sign(g[name]))
        net.w[name] += 1e-3 * way
        up = mean()
        net.w[name] -= 2e-3 * way
        down = mean()
        net.w[name] += 1e-3 * way
        assert math.isclose((up - down) / 2e-3, np.abs(g[name]).sum(), rel_tol=0.02)


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op8_ngram_jaccard_join", "op9_embedding_near_dedup", "source_mixing_targets", "license_base_places"])
def test_matches_sql(spark, name):
    """The query and its SQL twin give the same rows on driver tables."""
    import os

    import duckdb

    from ledgerline.llm import queries

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("driver tables are not here")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf)
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_lm_windows_widen_where_few_texts_are_left():
    seqs = [np.arange(n) % 7 for n in (5000, 40, 40, 3, 0)]
    got = list(lm_score._windows(seqs, 9, 8, 16, 1024))
    assert len(got) < 10  # with 16 steps each: 313
    for j, s in enumerate(seqs):
        x, y = (np.concatenate([w[i][:, j][w[3][:, j]] for w in got if w[0] > j]) for i in (1, 2))
        assert y.tolist() == [*s, 9] and x.tolist() == [8, *s]
