"""Pairing against the greedy walk, statement drift against token by token comparison."""

import random

from ledgerline.operators import pairing, statements


def greedy(left, right, least):
    """Pairs by group: equal sets in order, then classes of the largest overlap, each with its members in order."""
    out = set()
    for by in {x[0] for x in left + right}:
        side = []
        for rows in (left, right):
            classes = {}
            for _, order, tokens in sorted((r for r in rows if r[0] == by), key=lambda r: r[1]):
                classes.setdefault(tuple(sorted({t for t in tokens or [] if t is not None})), []).append(order)
            side.append(classes)
        a, b = side
        ways = []
        for x in a:
            for y in b:
                if x and y:
                    both, either = len(set(x) & set(y)), len(set(x) | set(y))
                    if x == y or (least is not None and 100 * both >= least * either):
                        ways.append((x != y, -both / either, "\x1f".join(x), "\x1f".join(y), x, y))
        for near, o, _, _, x, y in sorted(ways):
            while a[x] and b[y]:
                out.add((by, a[x].pop(0), b[y].pop(0), "near" if near else "same", -o))
        out |= {(by, i, None, "left", None) for v in a.values() for i in v} | {(by, None, i, "right", None) for v in b.values() for i in v}
    return out


def test_pairs_equal_the_greedy_walk(spark):
    rng = random.Random(7)
    schema = "screen string, line int, ids array<string>, n int"
    some = lambda: rng.choice([None, [], [rng.choice("abcdefg") for _ in range(rng.randint(1, 5))], ["a", "b"], ["hot"]])
    left = [(rng.choice(["s", "t", None]), i, some()) for i in range(90)]
    right = [(rng.choice(["s", "t", None]), i, some()) for i in range(70)] + [("only", 1, ["a"])]
    df = lambda rows: spark.createDataFrame([(*r, 0) for r in rows], schema).repartition(3)
    for least in (None, 50, 30):
        got = [tuple(r) for r in pairing.pair(df(left), df(right), ["screen"], "ids", "line", least).collect()]
        assert len(got) == len(set(got)) and set(got) == greedy(left, right, least)
    assert pairing.pair(df([]), df([]), ["screen"], "ids", "line", 50).count() == 0
    assert {r["how"] for r in pairing.pair(df(left), df([]), ["screen"], "ids", "line").collect()} == {"left"}


def norm(spark, text):
    return spark.range(1).select(statements.normalised(statements.F.lit(text)).alias("t")).first()["t"]


def test_normalised(spark):
    assert norm(spark, "SELECT A -- x\n  FROM T /* y\n */ WHERE N = 'It''s OK'  <!-- z -->") == "select a from t where n = 'It''s OK'"
    assert norm(spark, "A = #{userId} AND <if test=\"X > 'A'\">B</if>") == "a = #{userId} and <if test=\"X > 'A'\">b</if>"
    assert norm(spark, "a < B AND $C # d '") == "a < b and $c # d '"
    assert norm(spark, "'" + "x" * 50000 + "' Y" + " Z" * 50000) == "'" + "x" * 50000 + "' y" + " z" * 50000


def test_changes():
    assert statements.changes("where use_yn = 'false' and id = #{a} and a != b", "where use_yn = 'true' and id = #{a} and a <> b") == ("- 'false' / + 'true' · - != / + <>", ["- 'false' / + 'true'", "- != / + <>"])
    assert statements.changes("select a from t", "SELECT a, b from t")[1] == ["+ , b"]
    long = statements.changes("x", "x " + " ".join(f"w{i}" for i in range(50)))
    assert long[0].endswith("… (+20)") and len(long[1][0].split()) == 51


def test_drift(spark):
    schema = "ns string, id int, sql string, status string"
    base = spark.createDataFrame([("a", 1, "SELECT 1", ""), ("a", 2, "SELECT a FROM t", ""), ("a", 3, "select 'X'", ""), ("a", 4, "select gone", ""), ("a", 5, "select MOVES", ""), (None, 6, None, ""), ("b", 7, "select 'X'", "")], schema)
    now = spark.createDataFrame([("a", 1, "SELECT 1", ""), ("a", 2, "select a\n  from t -- c", ""), ("a", 3, "select 'x'", ""), ("z", 5, "select moves", ""), (None, 6, "", ""), ("b", 7, "select 'x'", ""), ("new", 1, "x", "")], schema)
    got = {(r["ns"], r["id"]): (r["status"], r["changes"]) for r in statements.drift(base, now, ["ns", "id"], "sql").collect()}
    assert got == {
        ("a", 1): ("same", None), ("a", 2): ("format", None), ("a", 3): ("changed", ["- 'X' / + 'x'"]), ("a", 4): ("deleted", None), ("a", 5): ("moved", None),
        ("z", 5): ("added", None), (None, 6): ("same", None), ("b", 7): ("changed", ["- 'X' / + 'x'"]), ("new", 1): ("added", None),
    }
    assert statements.drift(base.limit(0), now.limit(0), ["ns", "id"], "sql").count() == 0
