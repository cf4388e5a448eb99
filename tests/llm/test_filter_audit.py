"""The filter audit against every order run one after the other, with nulls, ties, repeated rows and labels, and against its SQL."""

import random
import re
from itertools import permutations

from ledgerline.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, source string, part string, n string"
LABELS = "doc_id long, quality int, toxic int, n string"


def made():
    rng = random.Random(4)
    words = ["one", "Two", "three", "FOUR", "five%", "six", "seven", "ünï"]
    docs = []
    for i in range(120):
        text = " ".join(rng.choice(words[: rng.randint(1, 8)]) + (str(rng.randint(0, 400)) if rng.random() < 0.6 else "") for _ in range(rng.choice([3, 150, 199, 200, 260])))
        docs.append((i, rng.choice([text, text, text.replace("%", ""), None, "", " \n"]), rng.choice(["s1", "s2", None, "", "s3"])))
    docs += [(i + 200, docs[i][1], docs[i + 1][2]) for i in range(40)] + docs[5:9] + [(None, docs[0][1], "s1"), (None, "one", "s2"), (None, "one", "s2"), (7, docs[7][1], "s9"), (3, "w " * 20000, "s1")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(150)] + [(3, 1, 0), (None, 1, 1)]
    return docs, labels


def expected(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        rows.append((s or "", {k for k, f in fails.items() if f}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                all_failing = sum(r[0] == part and f in r[1] for r in rows)
                left = [r for r in left if f not in r[1]]
                total[f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), all_failing - len(removed), sum(r[0] == part and r[1] == {f} for r in rows), sum(r[2] for r in removed), sum(r[3] for r in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def test_every_order(spark):
    docs, labels = made()
    df = spark.createDataFrame([(*r, "clash", "ing") for r in docs], SCHEMA).repartition(3)
    got = fa.audit(df, spark.createDataFrame([(*r, "n") for r in labels], LABELS)).collect()
    want = expected(docs, labels)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in docs})
    for r in got:
        assert list(r)[3:] == want[r["part"], r["filter_order"], r["step"]]


def test_nothing_to_audit(spark):
    none = spark.createDataFrame([], LABELS)
    assert fa.audit(spark.createDataFrame([], SCHEMA), none).count() == 0
    one = fa.audit(spark.createDataFrame([(1, None, None, "", "")], SCHEMA), none).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and sum(r["removed"] for r in one if r["filter_order"] == "BACDE") == 1


def test_words_do_not_shuffle(spark):
    df = spark.createDataFrame([(1, "a b", "s", "", "")], SCHEMA)
    plan = fa.word_stats(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
