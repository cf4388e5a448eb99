"""Facts on small tables with nulls, ties, repeated rows and empty sides."""

from pyspark.sql import functions as F

from ledgerline.operators import facts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_filters(spark):
    df = spark.createDataFrame([(1, 1.5, True, "a"), (2, None, None, None), (3, 1.0, False, "B")], "i int, d double, b boolean, s string")
    ids = lambda c: [r["i"] for r in df.where(c).orderBy("i").collect()]
    assert ids(facts.matches({"i": "1", "d": "1.5"})) == [1] and ids(facts.matches({"s": None})) == [2] and ids(~facts.matches({"s": "a"})) == [2, 3] and ids(facts.matches({})) == [1, 2, 3]
    new = lambda column, value: [r[0] for r in df.orderBy("i").select(facts.coerced(df, column, F.lit(value))).collect()]
    assert new("i", "7") == [7, 7, 7] and new("i", "x") == [1, 2, 3] and new("d", "2.5") == [2.5] * 3 and new("b", "yes") == [True] * 3 and new("b", "maybe") == [True, None, False] and new("s", " NULL ") == [None] * 3
    assert ids(facts.not_ignored(F.col("s"), ["a"])) == [2, 3] and ids(facts.not_ignored(F.col("s"), [])) == [1, 2, 3] and ids(facts.of_domain(F.col("s"), "b")) == [3]
    calls = spark.createDataFrame([("get", "/app/x/y"), ("POST", "/x/y"), ("GET", "/app/z")], "m string, p string")
    assert rows(calls.where(facts.accessed(F.col("m"), F.col("p"), "GET", "/x", "/app"))) == [("get", "/app/x/y")]
    names = spark.createDataFrame([("hr.emp_a",), ("EMP_b",), ("sys_c",), ("dept",)], "t string")
    assert rows(facts.candidate_tables(names, "t", ["emp_", "d"], "^sys")) == [("EMP_b", 0), ("dept", 1), ("hr.emp_a", 0)]
    cols = spark.createDataFrame([("No. ", "INT"), ("Name", "text"), ("number", "int")], "label string, kind string")
    assert rows(facts.columns_where(cols, "label", "kind", ("int",), holds="NO")) == [("No. ", "INT")] and rows(facts.columns_where(cols, "label", "kind", pattern="^n", length=3)) == [("No. ", "INT")]


def test_pairs(spark):
    left = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "k int")
    tier = lambda *r: spark.createDataFrame(list(r), "k int, match int")
    got = facts.first_tier(left, "k", [(tier((1, 9), (1, 8), (1, None)), False), (tier((1, 1), (2, 5), (2, 5), (None, 3)), False), (tier((3, 1), (3, 2), (4, 7), (4, 7)), True)])
    assert rows(got) == sorted([(1, 1, 8), (2, 2, 5), (3, None, None), (4, 3, 7), (None, None, None)], key=str)
    scored = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 2), ("b", 1)], "k string, s int")
    assert rows(facts.best_scored(scored, "k", "s")) == [("a", "ambiguous", 2, 3), ("b", "certain", 1, 2)]
    base, own = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, None), (3, "z")], "k int, v string")
    assert rows(facts.overridden(base, own, "k", "v")) == [(1, "x", False), (2, None, True)]
    cited = spark.createDataFrame([(1, "r"), (2, "q"), (3, None)], "id int, ref string")
    assert rows(facts.grounded(cited, spark.createDataFrame([("r",), ("r",)], "known string"), "ref")) == [(1, "r", True), (2, "q", False), (3, None, False)]
    urls = spark.createDataFrame([("/a", "m1"), ("/a", "m2"), ("/b", "m3")], "url string, menu string")
    calls = spark.createDataFrame([("/a",), ("/a",), ("/b",), ("/c",)], "url string")
    assert rows(facts.authorised(calls, urls, spark.createDataFrame([("m2",)], "menu string"), "url", "menu")) == [("/a", 2, "granted"), ("/b", 1, "refused"), ("/c", 1, "open")]
    a = spark.createDataFrame([("s", " No ", "a"), ("s", "No", "b"), ("s", "X", "x"), ("s", " ", "q"), ("s", "Q", "q")], "screen string, label string, name string")
    b = spark.createDataFrame([("s", "No", "a"), ("s", "X", "y"), ("t", "Q", "q")], a.schema)
    assert rows(facts.compared_labels(a, b, "screen", "label", "name")) == [("s", "No", "a", "a", "same"), ("s", "Q", "q", None, "left"), ("s", "X", "x", "y", "renamed"), ("t", "Q", None, "q", "right")]
    labels = spark.createDataFrame([("Pay", "basePay"), ("Pay", "basePay"), ("Day", "nothing"), (None, "x")], "label string, field string")
    columns = spark.createDataFrame([(t, "emp01_base_pay") for t in "dcba"] + [("a", "emp01_other")], "t string, c string")
    assert rows(facts.labelled_columns(labels, columns, "field", "label", "t", "c")) == [("Day", "nothing", 0, []), ("Pay", "basePay", 4, ["a.emp01_base_pay", "b.emp01_base_pay", "c.emp01_base_pay"])]
    uses = spark.createDataFrame([("f", "s1"), ("f", "s2"), ("g", "s1"), ("g", "s1"), ("h", "s1"), ("common/x", "s1")], "file string, screen string")
    assert rows(facts.shared_files(uses, "file", "screen", spark.createDataFrame([("h",), ("h",)], "file string"), "^common/")) == [("common/x", 1, True), ("f", 2, True), ("g", 1, False), ("h", 1, True)]
    assert rows(facts.shared_files(uses, "file", "screen")) == [("common/x", 1, False), ("f", 2, True), ("g", 1, False), ("h", 1, False)]


def test_totals(spark):
    recs = spark.createDataFrame([("WARN", "t", 1), ("ERROR", "t", 2), ("INFO", "u", 3)], "level string, trace string, n int")
    assert rows(facts.request_summary(recs, "level", "trace", F.col("n") > 1, F.col("n") < 3)) == [(2, 1, 1, 1, 1)] and rows(facts.request_summary(recs.limit(0), "level", "trace", F.col("n") > 1)) == [(0, 0, 0, 0, 0)]
    d = lambda *r: spark.createDataFrame([(x,) for x in r], "d string")
    assert rows(facts.domain_counts(d("a", "b", "b", "c"), {"x": d("a", "a", "a", "z"), "y": d("a", "a", "b")}, "d", "y", ("x", "y"))) == [("a", 3, 2, 40), ("b", 0, 1, 100), ("c", 0, 0, None)]
    m = spark.createDataFrame([(1, "y", 5), (1, "x", 3), (1, None, 1), (1, None, 2), (2, "z", 1), (2, "w", 2), (2, "w", 3)], "g int, l string, o int")
    assert rows(facts.mode_label(m, "g", "l", "o")) == [(1, "x"), (2, "w")]
    texts = spark.createDataFrame([(["a", "a", "b"],), (["a"],), (None,)], "n array<string>")
    assert rows(facts.popularity(texts, F.col("n"))) == [("a", 2), ("b", 1)] and rows(facts.popularity(texts, F.col("n"), d("b"))) == [("b", 1)]
    assert [tuple(r) for r in facts.top(d("q", "p", "p", "q", "r"), "d", 2).collect()] == [("p", 2), ("q", 2)]
    s = spark.createDataFrame([(1, 2.5), (2, 1.0)], "n int, t double")
    assert rows(facts.totals(s, {"n": "tests", "t": "seconds"})) == [(2, 3, 3.5)] and rows(facts.totals(s.limit(0), {"n": "tests", "t": "seconds"})) == [(0, 0, 0.0)]
    a, b = spark.createDataFrame([(1, "x"), (1, "w")], "k int, v string"), spark.createDataFrame([(1, "q"), (2, "r")], "k int, v string")
    assert rows(facts.first_source([a, b], "k")) == [(1, "w"), (2, "r")]
    assert rows(facts.next_id(d("R-007", "R-x", "X-999", "R-12"), "d")) == [("R-013",)] and rows(facts.next_id(d("R-999"), "d")) == [("R-1000",)] and rows(facts.next_id(d("q").limit(0), "d")) == [("R-001",)]
