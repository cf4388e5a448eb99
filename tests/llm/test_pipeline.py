"""The corpus pipeline, stage by stage and as a whole, against plain Python on a small corpus."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(t):
    return (t or "").encode().lower().split()


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(400):
        w = list(rng.choice(vocabulary, 60))
        if i % 8 == 0:
            w[3] = ("idiot", "moron")[i % 16 // 8]
        rows.append((i, " ".join(w), "en", ("a", "b", None)[i % 3]))
    rows += [(1000 + i, rows[i][1].upper(), "en", "a") for i in range(1, 30)]  # exact copies
    rows += [(2000 + i, rows[i][1].rsplit(" ", 1)[0] + " other", "en", "b") for i in range(31, 60)]  # near copies
    rows += [(3000, None, "en", "a"), (3001, "", None, None), (3002, "x " * 3000, "en", "a")]
    path = tmp_path_factory.mktemp("sf")
    docs = [(i, t, lang, s, len(t or ""), "extra") for i, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        out.write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before.toPandas(), now.toPandas())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
    toxic, exact, near, mix, pack = (seen[name] for name, _ in corpus_pipeline.STAGES)
    gone = set(toxic[0]["doc_id"]) - set(toxic[1]["doc_id"])
    assert len([i for i in gone if i < 400 and i % 8 == 0]) >= 45 and len([i for i in gone if i < 400 and i % 8]) <= 5
    # exact copies: the largest doc_id of equal texts stays
    best = {}
    for r in exact[0].itertuples():
        k = b" ".join([(r.text or "").encode().lower()])
        best[k] = max(best.get(k, -1), r.doc_id)
    assert sorted(exact[1]["doc_id"]) == sorted(best.values())
    # near copies: the smallest doc_id of each linked pair stays
    table = [(r.doc_id, shingles(r.text)) for r in near[0].itertuples()]
    worse = {max(i, j) for i, a in table for j, b in table if i != j and a and 100 * len(a & b) >= 75 * len(a | b)}
    assert sorted(near[1]["doc_id"]) == sorted(i for i, _ in table if i not in worse) and len(worse) > 15
    # the mix takes as many words as there are, and no document more than three times
    total = sum(len(words(t)) for t in mix[0]["text"])
    taken = mix[1].assign(n=[len(words(t)) for t in mix[1]["text"]]).groupby("doc_id")["n"].sum()
    size = {r.doc_id: len(words(r.text)) for r in mix[0].itertuples()}
    assert abs(taken.sum() - total) <= 3 * 3 and all(n <= 3 * size[i] for i, n in taken.items())
    # every row is packed whole
    from tokenizers import Tokenizer

    from ledgerline.llm.queries import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    assert pack[1]["length"].sum() == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in pack[0]["text"])
    assert pack[1].groupby("sequence_id")["length"].sum().max() <= 2048


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 300
