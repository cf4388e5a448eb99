"""Sources, sinks, gateway and operators on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline import queries
from ledgerline.functions import text
from ledgerline.operators import logs, ranking, retrieval, verdicts
from ledgerline.plans import gateway
from ledgerline.sources import files

LOG = """2024-05-01 10:00:00.000 [t1] [a] [u] [-] [main] WARN app.One - first
2024-05-01 10:00:01.500 [-] [SYSTEM] [-] [-] [main] ERROR app.Two -
\tat somewhere
Caused by: x
2024-05-01 10:00:02.000 [t2] [a] [u] [-] [main] INFO app.One - last
"""


def test_log_records(spark, tmp_path):
    (tmp_path / "a.log").write_text("no header yet\n" + LOG)
    rows = files.log_records(spark, str(tmp_path)).orderBy("record").collect()
    assert [(r["level"], r["trace"], r["tenant"], r["message"], list(r["extra"])) for r in rows] == [("WARN", "t1", "a", "first", []), ("ERROR", None, None, "", ["\tat somewhere", "Caused by: x"]), ("INFO", "t2", "a", "last", [])]
    assert logs.at_least(files.log_records(spark, str(tmp_path)), "level", "warn").count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<testsuites><testsuite name="s"><testcase name="a" time="0.5"/><testcase name="b" time="1"><failure>no</failure></testcase><testcase name="c" time="0"><skipped>x</skipped></testcase></testsuite></testsuites>')
    assert sorted((r["name"], r["status"]) for r in files.junit(spark, str(tmp_path / "r.xml")).collect()) == [("a", "passed"), ("b", "failed"), ("c", "skipped")]
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n2\t\\N\n")
    assert [tuple(r) for r in files.tsv(spark, str(tmp_path / "t.tsv"), "a int, b string").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "s.json").write_text('[{"name": "t",\n "columns": 3}]')
    assert [tuple(r) for r in files.snapshot(spark, str(tmp_path / "s.json"), "name string, columns int").collect()] == [("t", 3)]
    md = spark.createDataFrame([("f", i, x) for i, x in enumerate(["# t", "| a | b |", "|---|:-:|", r"| 1 | x \| y |"])], "file string, number int, line string")
    assert [list(r["cells"]) for r in files.markdown_rows(md, "file", "number", "line").orderBy("number").collect()] == [["a", "b"], ["1", r"x \| y"]]
    front = spark.createDataFrame([("---\ntitle: T\nkind: k\n---\nbody",), ("no",)], "t string").select(files.frontmatter(F.col("t"), "kind").alias("k"))
    assert [r["k"] for r in front.collect()] == ["k", None]


def test_dbml(spark):
    columns = spark.createDataFrame([("a", 1, "id", "int"), ("a", 2, "b_id", "int"), ("b", 1, "b_id", "int")], "table_name string, position int, column_name string, type string")
    refs = spark.createDataFrame([("a", "b_id", "b", "b_id")], "child string, child_column string, parent string, key_column string")
    got = {r["table_name"]: r["block"] for r in files.dbml(columns, refs).collect()}
    assert got == {"a": "Table a {\n  id int\n  b_id int\n}\nRef: a.b_id > b.b_id", "b": "Table b {\n  b_id int\n}"}


@pytest.mark.parametrize("statement", ["DELETE FROM t", "SELECT 1; DROP TABLE t", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "", "-- SELECT\nUPDATE t SET a = 1"])
def test_gateway_refuses(spark, statement):
    with pytest.raises(ValueError):
        gateway.check_read_only(spark, statement)


def test_gateway(spark):
    gateway.check_read_only(spark, "SELECT 'drop; it' AS x -- delete\n;")
    df = gateway.run(spark, "SELECT id FROM {t} WHERE id > :least", {"least": 6}, t=spark.range(10))
    assert [tuple(r) for r in gateway.preview(df.orderBy("id"), 2).collect()] == [(7, 3), (8, 3)]
    assert gateway.scalar(gateway.run(spark, "SELECT count(*) FROM {t}", t=spark.range(4))) == 4
    with pytest.raises(ValueError):
        gateway.scalar(spark.range(2))


def test_masks(spark):
    cases = {"id 900101-1234567 x": ("id ******-******* x", 1), "9001011234567": ("******-*******", 1), "900101-9234567": ("900101-9234567", 0), "a eyJab.cd-e.f_g b": ("a eyJ…(JWT) b", 1), "Using generated security password: abc-1 x": ("Using generated security password: **** x", 1)}
    masked, n = text.mask_sensitive(F.col("t"))
    assert {r["t"]: (r["m"], r["n"]) for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", masked.alias("m"), n.alias("n")).collect()} == cases


def test_budget_skips(spark):
    items = spark.sql("SELECT array(named_struct('name', 'a', 'size', 5L), named_struct('name', 'b', 'size', 9L), named_struct('name', 'c', 'size', 4L)) AS i")
    assert items.select(ranking.within_budget(F.col("i"), 10).alias("n")).first()["n"] == ["a", "c"]


def test_depth(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a")], "child string, parent string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    assert {tuple(r) for r in ranking.longest_depth(edges, nodes, "child", "parent", "node").collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 0)}
    with pytest.raises(ValueError):
        ranking.longest_depth(edges.union(spark.createDataFrame([("a", "c")], edges.schema)), nodes, "child", "parent", "node", 8)


def test_paths(spark):
    rows = spark.createDataFrame([("main > sales > items",), ("main > items > sales",), ("sales items",)], "p string")
    assert [r["p"] for r in rows.where(F.rlike("p", F.lit(verdicts.path_pattern("Sal > item")))).collect()] == ["main > sales > items"]


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rows = [(i, [float(i % 11), float(i % 7)]) for i in range(60)] + [(60, None), (61, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in retrieval.nearest(v, v.where("vec_id % 20 = 0"), 3).collect())
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(rows[a][1], rows[b][1], strict=True))
    want = sorted((q, j, d(q, j)) for q in (0, 20, 40) for j in sorted(range(60), key=lambda j: (d(q, j), j))[:3])
    assert got == want


def test_lookup_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rng = random.Random(3)
    rows = [(i, [round(rng.random(), 1) for _ in range(3)], rng.choice(["a", "b", "c", None])) for i in range(120)]
    odd = [(200, None, "a"), (220, [0.1, None, 0.2], "b"), (240, [0.5, 0.5], "c"), (260, [], "a"), (None, [0.1, 0.2, 0.3], "a")]
    twice = [(40, [0.9, 0.9, 0.9], "b"), (41, [0.1, 0.1, 0.1], "c")]

    def want(rows, queries):
        best = {}
        for i, v, a in rows:
            for q, w, b in queries:
                fits = v and w and len(v) == len(w) and None not in v and None not in w
                tier = 0 if a is not None and a == b else 1 if fits and round(sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), 6) <= 0.29 else None
                if tier is not None:
                    best[q, i] = min(tier, best.get((q, i), 1))
        return sorted(((q, i, t) for (q, i), t in best.items()), key=str)

    for data in (rows, rows + odd, rows + odd + twice):
        v = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string").repartition(5)
        got = retrieval.lookup(v, v.where("vec_id % 20 = 0"), 0.29)
        assert sorted(map(tuple, got.collect()), key=str) == want(data, [r for r in data if r[0] is not None and r[0] % 20 == 0])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert retrieval.lookup(empty, empty, 1.0).collect() == []


def test_lookup_shuffles_no_pairs(spark, tmp_path):
    spark.createDataFrame([(i, [i / 400, 0.5], i % 3) for i in range(400)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["hybrid_lookup"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan.split("Join")[0] and "Exchange" not in plan.split("Join")[0] and "Aggregate" not in plan  # above the join of blocks
    assert got.count() == 20 * 400


def test_grid_moves_least():
    for cells, v, q in ((8, 10**6, 5 * 10**4), (1000, 10**9, 5 * 10**7), (1000, 10**6, 10**6), (4, 10, 1), (200, 0, 0)):
        across, down = retrieval._grid(cells, v, q)
        assert across >= 1 and down >= 1 and across * down <= 2 * cells and (across * v + down * q <= 3 * (v + cells * q))
    assert retrieval._grid(1000, 10**9, 5 * 10**7) == (7, 143)


def test_budgets_equal_the_walk(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 0, 1, 3, 7, 20, 50, 101])) for i in range(300)]
    rows += [("hard", i, 1 if i % 2 == 0 else 100 - i // 2) for i in range(80)] + [("none", 0, 500)]
    df = spark.createDataFrame(rows, "g string, i int, n int").repartition(3)
    for rounds in (12, 2):
        monkeypatch.setattr(ranking, "ROUNDS", rounds)
        want, used = set(), {}
        for g, i, n in rows:
            if used.get(g, 0) + (n or 0) <= 100:
                used[g] = used.get(g, 0) + (n or 0)
                want.add((g, i))
        assert {(r["g"], r["i"]) for r in ranking.budgeted(df, "g", "i", "n", 100).collect()} == want
    assert ranking.budgeted(df.limit(0), "g", "i", "n", 100).count() == 0
