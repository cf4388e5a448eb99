"""Hops with sources, canonical paths, names in bodies, recovered names, ordered rules, running values over ranges: against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import lineage, names, ordered


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def test_crud_with_sources(spark):
    rng = random.Random(3)
    start = [(f"screen{rng.randint(0, 5)}", f"svc{rng.randint(0, 9)}") for _ in range(30)] + [("screen0", "svc0")] * 5 + [("screen9", None)]
    first = [(f"svc{rng.randint(0, 9)}", f"m{rng.randint(0, 12)}") for _ in range(40)] + [("svc1", None), ("svc1", "m1"), ("svc1", "m1")]
    second = [(f"m{rng.randint(0, 12)}", f"sql{rng.randint(0, 15)}") for _ in range(60)]
    usage = [(f"sql{rng.randint(0, 15)}", rng.choice(["T_A", "t_a", "t_b", None]), rng.choice("CRUD")) for _ in range(40)]
    df = spark.createDataFrame(start, "row string, node string")
    used = spark.createDataFrame(usage, "node string, table string, op string")
    want = {}
    for row, svc in start:
        for s, m in first:
            for m2, q in second:
                for q2, t, op in usage:
                    if svc is not None and s == svc and m2 == m and q2 == q and t is not None:
                        want.setdefault((row, t.lower(), op), set()).add(f"{q} ({svc})")
    got = lineage.sourced_matrix(lineage.crud_usages(df, [edges(spark, first), edges(spark, second)], used, via=0)).collect()
    assert {(r["row"], r["table"], r["op"]): set(r["sources"]) for r in got} == want and all(r["n_sources"] == len(r["sources"]) and r["sources"] == sorted(r["sources"]) for r in got)
    direct = lineage.direct_usages(df, spark.createDataFrame([("svc0", "X", "D"), ("svc0", "x", "D"), ("zz", "y", "C")], used.schema), "model").collect()
    assert {tuple(r) for r in direct} == {(row, "x", "D", "model (svc0)") for row, n in start if n == "svc0"}
    assert lineage.sourced_matrix(lineage.crud_usages(df.limit(0), [edges(spark, first)], used)).count() == 0


def test_crud_compare(spark):
    schema = "row string, table string, op string"
    left = spark.createDataFrame([("s1", "a", "C"), ("s1", "a", "C"), ("s1", "b", "R"), ("s1", "c", "D"), ("s2", "a", "R"), ("s2", "d", "U"), ("s3", "e", "R")], schema)
    right = spark.createDataFrame([("s1", "a", "C"), ("s1", "z", "C")], schema)
    exempt = spark.createDataFrame([("s1", "b", "R"), (None, "c", None), ("s2", None, None), ("s1", "a", "C")], schema)
    got = {tuple(r)[:3]: r["status"] for r in lineage.crud_compare(left, right, exempt).collect()}
    assert got == {("s1", "a", "C"): "both", ("s1", "b", "R"): "exempt", ("s1", "c", "D"): "exempt", ("s2", "a", "R"): "exempt", ("s2", "d", "U"): "exempt", ("s3", "e", "R"): "lost", ("s1", "z", "C"): "added"}
    assert {r["status"] for r in lineage.crud_compare(left, right).collect()} == {"both", "lost", "added"}


def test_call_paths_are_a_breadth_first_walk(spark):
    rng = random.Random(8)
    calls = sorted({(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for _ in range(45)} | {("n1", "n1"), ("n2", "n3"), ("n3", "n2")})
    start = [("e1", "n2"), ("e1", "n7"), ("e2", "n1"), ("e3", "nowhere"), ("e1", "n2"), ("e4", None)]
    want = {}
    for root in {r for r, _ in start}:
        level = {n: [] for r, n in start if r == root and n}
        seen = dict(level)
        while level:
            new = {}
            for node in sorted(level):
                for s, d in calls:
                    if s == node and d not in seen and d not in new:
                        new[d] = [*seen[node], node]
            seen |= new
            level = new
        want |= {(root, n): p for n, p in seen.items()}
    reached = lineage.call_paths(edges(spark, calls), spark.createDataFrame(start, "root string, node string"))
    got = lineage.paths(reached).collect()
    assert {(r["root"], r["node"]): r["path"] for r in got} == want and all(r["depth"] == len(r["path"]) for r in got)
    assert lineage.reach(edges(spark, [("a", "b"), ("b", "c"), ("c", "a")]), spark.createDataFrame([("a",)], "node string"), 1).count() == 2
    with pytest.raises(ValueError, match="still found"):
        lineage.call_paths(edges(spark, calls), spark.createDataFrame(start, "root string, node string"), 1)


def test_names_in_bodies(spark, monkeypatch):
    monkeypatch.setattr(names, "PARTS", 4)  # common names go the other way
    rng = random.Random(2)
    words = ["emp", "EMP", "emp_add", "hr.emp", "hr", "f_calc", "F_Calc (", "ünit", "x", "select", ";", "("]
    bodies = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "(", ","]) for _ in range(rng.randint(0, 15)))) for i in range(120)] + [(500, None), (501, "emp " * 5000)]
    asked = ["emp", "Emp_Add", "hr.emp", "f_calc", "ünit", "absent", "select", None, "emp"]
    df, nm = spark.createDataFrame(bodies, "id int, body string"), spark.createDataFrame([(n,) for n in asked], "name string")
    for called in (False, True):
        tail = r"\s*\(" if called else ""
        want = {(i, n) for i, b in bodies if b for n in asked if n and re.search(rf"(?<!\w){re.escape(n.lower())}(?!\w){tail}", b.lower())}
        got = [tuple(r) for r in names.used_names(df, nm, "id", "body", "name", called).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert names.used_names(df.limit(0), nm, "id", "body", "name").count() == 0


def test_recovered_names(spark):
    known = spark.createDataFrame([("EmpOthersMapper", "sel"), ("EmpMapper", "sel"), ("jp.acme.biz.FooMapper", "sel"), ("jp.acme.pay.FooMapper", "upd"), ("PayMapper", "upd"), ("PayrollMapper", "upd"), ("PayMapper", "upd"), (None, "sel")], "cls string, id string")
    calls = [("k.c.E.sel", "/api/v1/emp-others/1"), ("k.c.E.sel", "/api/zzz"), ("k.c.E.sel", None), ("j.a.b.FooMapper.sel", "/x"), ("j.a.c.FooMapper.sel", "/x"), ("P.upd", "/payroll"), ("P.upd", "/pay"), ("nodots", "/x"), ("k.X.sel", "/x"), (None, "/x")]
    got = {(r["logger"], r["path"]): (r["name"], r["n_fit"]) for r in names.recover(spark.createDataFrame(calls + calls, "logger string, path string"), known, "logger", "path", "cls", "id").collect()}
    assert got == {
        ("k.c.E.sel", "/api/v1/emp-others/1"): ("EmpOthersMapper.sel", 2), ("k.c.E.sel", "/api/zzz"): ("k.c.E.sel", 2), ("k.c.E.sel", None): ("k.c.E.sel", 2), ("j.a.b.FooMapper.sel", "/x"): ("FooMapper.sel", 1),
        ("j.a.c.FooMapper.sel", "/x"): ("j.a.c.FooMapper.sel", 0), ("P.upd", "/payroll"): ("PayrollMapper.upd", 2), ("P.upd", "/pay"): ("P.upd", 2), ("nodots", "/x"): ("nodots", 0), ("k.X.sel", "/x"): ("k.X.sel", 0),
    }


def test_ordered_rules(spark):
    rng = random.Random(6)
    tables = [[(f"q{rng.randint(0, 8)}", f"c{rng.randint(0, 12)}", rng.randint(0, 3)) for _ in range(25)] for _ in range(4)]
    asked = [f"q{i}" for i in range(9)] + ["q1", None]
    seen = []

    def rule(rows):
        def run(left):
            seen.append({r["q"] for r in left.collect()})
            return spark.createDataFrame(rows, "q string, card string, rank int").join(left.select("q"), "q", "left_semi")

        return run

    got = names.ordered_match(spark.createDataFrame([(q,) for q in asked], "q string"), [rule(t) for t in tables], "q", 3).collect()
    want, open_ = {}, []
    cards = {q: [] for q in asked if q}
    for t in tables:
        open_.append({q for q, c in cards.items() if len(c) < 3})
        for q in open_[-1]:
            best = {}
            for x, c, r in t:
                if x == q:
                    best[c] = min(r, best.get(c, r))
            for r, c in sorted((r, c) for c, r in best.items()):
                if c not in cards[q] and len(cards[q]) < 3:
                    cards[q].append(c)
    want = {(q, i): c for q, cs in cards.items() for i, c in enumerate(cs, 1)}
    assert {(r["q"], r["place"]): r["card"] for r in got} == want and seen == open_


def test_running_values_over_ranges(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "long", i, rng.choice([None, None, i])) for i in range(600)]
    ranged = ordered.in_ranges(spark.createDataFrame(rows, "f string, n int, v int").repartition(5), ["f"], ["n"])
    assert ranged.select("_part").distinct().count() > 1
    got = ordered.running(ordered.running(ranged, ["f"], "total", F.coalesce("v", F.lit(0))), ["f"], "last", F.col("v"), "last").collect()
    for f in ("a", "b", None, "long"):
        total, last = 0, None
        for _, n, v in sorted((r for r in rows if r[0] == f), key=lambda r: r[1]):
            total, last = total + (v or 0), v if v is not None else last
            hit = [r for r in got if r["f"] == f and r["n"] == n]
            assert len(hit) == 1 and (hit[0]["total"], hit[0]["last"]) == (total, last)
    empty = ordered.in_ranges(spark.createDataFrame([], "f string, n int, v int"), ["f"], ["n"])
    assert ordered.running(empty, ["f"], "t", F.col("v")).count() == 0


def test_nearest_mark(spark):
    rng = random.Random(14)
    lines = {f: [rng.choice(["x();", "x();", "y", "", "// [E1] save", "// [E22] load", "const z = 1", "const w // [E3] both", None]) for _ in range(150)] for f in ("f", "g")}
    rows = [(f, i, t) for f, ts in lines.items() for i, t in enumerate(ts, 1)]
    mark, barrier = r"\[(E\d+)\]", r"^\s*$|^const "
    got = ordered.nearest_mark(spark.createDataFrame(rows, "file string, no long, line string").repartition(4), "file", "no", "line", mark, barrier, 5).collect()
    assert len(got) == len(rows)
    for r in got:
        want, n = None, r["no"]
        for i in range(n, max(0, n - 5), -1):
            t = lines[r["file"]][i - 1] or ""
            if m := re.search(mark, t):
                want = m[1]
                break
            if i < n and re.search(barrier, t):
                break
        assert r["mark"] == want, (r, lines[r["file"]][max(0, n - 6) : n])
