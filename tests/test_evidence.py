"""Evidence against a plain search over collapsed lines."""

import random
import re

from ledgerline.operators import evidence as ev


def norm(text):
    return re.sub(r"\s+", " ", text).strip()


def expected(texts, path, a, b, excerpt):
    if path not in texts:
        return "MISSING", None, None
    lines = texts[path].splitlines()
    excerpt = norm(excerpt or "")
    if a is None:
        return ("OK" if norm(texts[path]) == excerpt else "STALE"), None, None
    b = a if b is None else b
    if a <= len(lines) and excerpt and b <= len(lines) and norm("\n".join(lines[a - 1 : b])) == excerpt:
        return "OK", None, None
    if excerpt and a <= len(lines) and norm("\n".join(lines[a - 1 : b])) == excerpt:
        return "OK", None, None
    full = [i for i, x in enumerate(lines, 1) if x.strip()]
    hits = [(i, j) for k, i in enumerate(full) for j in full[k:] if excerpt and norm("\n".join(lines[i - 1 : j])) == excerpt]
    if hits:
        first = min(hits, key=lambda h: (abs(h[0] - a), h[0]))
        return "MOVED", *first
    return ("MISSING" if a > len(lines) else "STALE"), None, None


def test_check(spark):
    rng = random.Random(1)
    words = ["if", "(a)", "b", "}", "return x;", "ü", "  two  words"]
    texts = {f"f{i}": rng.choice(["\n", "\r\n"]).join(rng.choice(["", "    ", "\t"]) + rng.choice(words) if rng.random() < 0.8 else "" for _ in range(rng.randint(1, 40))) for i in range(12)}
    texts["empty"] = ""
    texts["one"] = "a b\n"
    rows = []
    for i in range(400):
        path = rng.choice([*texts, "gone", None])
        lines = texts.get(path, "").splitlines()
        a = rng.choice([None, rng.randint(1, 45)])
        b = rng.choice([None, a + rng.randint(0, 4)]) if a else None
        cut = rng.randint(0, max(len(lines) - 1, 0))
        excerpt = rng.choice([norm("\n".join(lines[cut : cut + rng.randint(1, 4)])), "not there", texts.get(path, ""), None, "  ", "}"])
        if a and rng.random() < 0.4:
            excerpt = norm("\n".join(lines[a - 1 : b or a]))
        rows.append((i, path, a, b, excerpt, "clash"))
    files = spark.createDataFrame([(p, t, 0) for p, t in texts.items()] + [(None, "x", 0)], "path string, text string, first int")
    given = spark.createDataFrame(rows + rows[:5], "id int, path string, line int, line_end int, excerpt string, last string")
    got = ev.check(files, given, "path", "text", "line", "line_end", "excerpt").collect()
    assert len(got) == len(rows) + 5
    for r in got:
        assert (r["status"], r["new_line"], r["new_end"]) == expected(texts, r["path"], r["line"], r["line_end"], r["excerpt"]), r
    none = spark.createDataFrame([], given.schema)
    assert ev.check(files, none, "path", "text", "line", "line_end", "excerpt").count() == 0
    assert {r["status"] for r in ev.check(spark.createDataFrame([], files.schema), given, "path", "text", "line", "line_end", "excerpt").collect()} == {"MISSING"}


def test_rewrapped_and_reindented(spark):
    files = spark.createDataFrame([("f", "\n\n    if (a)\n\n      run(b,\n        c);\n    }\nx\nif (a) run(b, c);\n")], "path string, text string")
    cites = spark.createDataFrame([("f", 1, 3, "if (a)\nrun(b, c);"), ("f", 3, 6, "if (a) run(b, c);"), ("f", 9, None, "if (a) run(b, c);"), ("f", 8, None, "if (a) run(b, c);")], "path string, line int, line_end int, excerpt string")
    got = {(r["line"]): (r["status"], r["new_line"], r["new_end"]) for r in ev.check(files, cites, "path", "text", "line", "line_end", "excerpt").collect()}
    assert got == {1: ("MOVED", 3, 6), 3: ("OK", None, None), 9: ("OK", None, None), 8: ("MOVED", 9, 9)}


def test_cite_and_verify(spark):
    files = spark.createDataFrame([("f", "a\n  b\n\n c d")], "path string, text string")
    places = spark.createDataFrame([(1, "f", 1, 2), (1, "f", 4, None), (2, "f", 3, None), (2, "f", 3, 9), (3, "g", 1, 1), (3, "f", None, None)], "rule int, path string, line int, line_end int")
    got = ev.cite(files, places, "path", "text", "line", "line_end").collect()
    assert sorted((r["rule"], r["excerpt"] or "") for r in got) == [(1, "a b"), (1, "c d"), (2, ""), (2, ""), (3, ""), (3, "a b c d")]
    checked = spark.createDataFrame([(1, "OK"), (1, "MOVED"), (2, "STALE")], "rule int, status string")
    rules = spark.createDataFrame([(1,), (2,), (3,), (3,)], "rule int")
    assert sorted(map(tuple, ev.verify(rules, checked, "rule").collect())) == [(1, "MOVED", 2), (2, "STALE", 1), (3, "MISSING", 0)]
