"""Parameter inference against a walk over statements one by one, and its sources on small tables."""

import random
import re

from pyspark.sql import functions as F

from ledgerline.operators import parameters

NAMED, VALUED, COMPARED, CALLED = "statement string, name string", "statement string, name string, value string", "statement string, name string, table_name string, column_name string", "statement string, key string, value string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def walk(params, given, compared, samples, constants, rules, company):
    """The rules read one parameter at a time; ``samples``: table -> (rows as dicts in order, own column)."""
    out = []
    known = {}
    for s, n in params:
        values = sorted(v for a, b, v in given if (a, b) == (s, n) and v is not None)
        if values:
            known[s, n] = (values[0], "given", None)
        elif n.lower() in ("companyid", "cid"):
            known[s, n] = (company, "company", None)
    for s, n in sorted(set(params)):
        if (s, n) in known:
            out.append((s, n, *known[s, n]))
            continue
        found = None
        for table, column in sorted({(t, c) for a, b, t, c in compared if (a, b) == (s, n)}):
            if table not in samples:
                continue
            data, own = samples[table]
            need = {(c, known[s, b][0]) for a, b, t, c in compared if a == s and t == table and (s, b) in known and (not data or c in data[0])}
            fit = next((r for r in data if all(r[c] is not None and str(r[c]) == v for c, v in need) and (own is None or str(r[own]) == company)), None)
            if fit is not None and fit.get(column) is not None:
                found = (str(fit[column]), "sample", f"{table}.{column}")
                break
        if found is None:
            fits = sorted((k, v) for a, k, v in constants if a == s and k and v and (n.lower() in k.lower() or k.lower() in n.lower() or v.lower() in n.lower()))
            rule = next((v for p, v in rules if re.search(p, n, re.I)), None)
            found = (fits[0][1], "constant", fits[0][0]) if fits else (rule, "rule", None) if rule is not None else ("?", "none", None)
        out.append((s, n, *found))
    return sorted(out, key=str)


def test_equals_walk(spark):
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        pick = lambda values: rng.choice(values)
        names = ["a", "b", "c", "companyId", "startDate", "mode", "x"]
        statements = [f"s{i}" for i in range(25)]
        params = [(pick(statements), pick(names)) for _ in range(120)]
        compared = [(s, n, pick(["t", "u", "w"]), pick(["k", "p", "q", "own", "no"])) for s, n in params if rng.random() < 0.8] + [("s1", "unasked", "t", "p")]
        given = [(s, n, pick(["1", "2", "3", None])) for s, n in params if rng.random() < 0.3]
        constants = [(pick(statements), pick(["MODE", "m", "b", ""]), pick(["v", "x", "", "w"])) for _ in range(20)]
        table = lambda n: [{"k": i, "p": pick([1, 2, 3, None]), "q": pick(["1", "2", None]), "own": pick([7, 7, 8, None])} for i in range(n)]
        t, u = table(30), table(5)
        frame = lambda data: spark.createDataFrame([tuple(r.values()) for r in data], "k int, p int, q string, own int").repartition(3)
        rules = [("^start_?date$", "2000-01-01"), ("date", "today")]
        got = parameters.inferred(spark.createDataFrame(params, NAMED), spark.createDataFrame(given, VALUED), spark.createDataFrame(compared, COMPARED), {"t": (frame(t), "k", None), "u": (frame(u), "k", "own")}, spark.createDataFrame(constants, CALLED), rules, "7")
        assert rows(got) == walk(params, given, compared, {"t": (t, None), "u": (u, "own")}, constants, rules, "7")


def test_edges(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    params = spark.createDataFrame([("s", "at"), ("s", "at"), ("s", "p"), ("s", "q"), (None, "p"), ("s", None)], NAMED)
    table = spark.createDataFrame([(None, "a", None), (2, "b", "2024-05-06 07:08:09")], "k int, p string, at string").withColumn("at", F.col("at").cast("timestamp"))
    compared = spark.createDataFrame([("s", "at", "t", "at"), ("s", "p", "t", "p"), ("s", "q", "t", "p")], COMPARED)
    sample = {"t": (table, "k", None)}
    given = spark.createDataFrame([("s", "p", "b")], VALUED)
    got = parameters.inferred(params, given, compared, sample, empty(CALLED), [])
    assert rows(got) == [("s", "at", "2024-05-06", "sample", "t.at"), ("s", "p", "b", "given", None), ("s", "q", "b", "sample", "t.p")]
    # two parameters that ask one column for different values fit no row
    got = parameters.inferred(params, spark.createDataFrame([("s", "p", "a"), ("s", "q", "b")], VALUED), compared, sample, empty(CALLED), [])
    assert ("s", "at", "?", "none", None) in rows(got)
    nothing = parameters.inferred(params, empty(VALUED), empty(COMPARED), {"t": (table.limit(0), "k", "p")}, empty(CALLED), [("^a", "v")], "7")
    assert rows(nothing) == [("s", "at", "v", "rule", None), ("s", "p", "?", "none", None), ("s", "q", "?", "none", None)]
    assert rows(parameters.inferred(empty(NAMED), given, compared, sample, empty(CALLED), [])) == [] and len(rows(parameters.inferred(params, given, compared, {}, empty(CALLED), []))) == 3


def test_statements_are_never_broadcast(spark):
    # exploded rows look few to Spark, so that a join would bring all statements to the driver
    made = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("statement"), "id")
    params = made.select("statement", F.explode(F.array(F.lit("k"), F.lit("p"), F.lit("mode"))).alias("name"))
    compared = made.select("statement", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.lit("t").alias("table_name"), F.lit(c).alias("column_name")) for c in ("k", "p")])))
    given = made.where("id % 2 = 0").select("statement", F.lit("k").alias("name"), (F.col("id") % 10).cast("string").alias("value"))
    constants = made.where("id % 3 = 0").select("statement", F.lit("MODE").alias("key"), F.lit("v").alias("value"))
    table = spark.range(8).select(F.col("id").alias("k"), (F.col("id") + 100).alias("p"))
    got = parameters.inferred(params, given, compared, {"t": (table, "k", None)}, constants, [])
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i in range(3000):
        k = str(i % 10) if i % 2 == 0 else "0"
        want[f"s{i}", "k"] = (k, "given", None) if i % 2 == 0 else ("0", "sample", "t.k")
        want[f"s{i}", "p"] = ("?", "none", None) if int(k) > 7 else (str(100 + int(k)), "sample", "t.p")
        want[f"s{i}", "mode"] = ("v", "constant", "MODE") if i % 3 == 0 else ("?", "none", None)
    assert {(r[0], r[1]): tuple(r[2:]) for r in got.collect()} == want and got.count() == len(want)
