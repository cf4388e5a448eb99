"""Catalog slices, catalog drift, changed units, ranges of time and the sources beside them, on small tables."""

import gzip
import random
from datetime import date, datetime
from zoneinfo import ZoneInfo

import pytest

from ledgerline.operators import intervals, ranges, schema, units
from ledgerline.sources import files

COLUMNS = "table_name string, position int, column_name string, type string"
KEYS = "child string, child_column string, parent string, key_column string"
PART = "kind string, table_name string, name string, definition string"
PLACE = "file string, unit string, lo int, hi int"
HUNK = "file string, old_lo int, old_hi int, new_lo int, new_hi int, added int, removed int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_slice(spark):
    columns = spark.createDataFrame([("emp", 1, "id", "int"), ("emp", 2, "dept_id", "mood"), ("dept", 1, "id", "int"), ("Log", 1, "at", "text")], COLUMNS)
    keys = spark.createDataFrame([("emp", "dept_id", "dept", "id"), ("emp", "dept_id", "dept", "id"), ("Log", "at", "emp", "id")], KEYS)
    enums = spark.createDataFrame([("mood", ["a", "b"]), ("other", ["c"])], "enum_name string, values array<string>")
    emp, dept, log = "Table emp {\n  id int\n  dept_id mood\n}", "Table dept {\n  id int\n}", "Table Log {\n  at text\n}"
    size = {"emp": len(emp) + len("\n// Ref: emp.dept_id > dept.id"), "dept": len(dept), "Log": len(log) + len("\n// Ref: Log.at > emp.id")}
    got = rows(schema.sliced(columns, keys, ["LOG", "x*", "e*", "*"], 10_000, enums))
    assert got == sorted([("LOG", "Log", "included", size["Log"], log + "\nRef: Log.at > emp.id"), ("x*", None, "missing", None, None), ("e*", "emp", "included", size["emp"], emp + "\nRef: emp.dept_id > dept.id"), ("*", "dept", "included", size["dept"], dept), (None, "mood", "enum", 21, "Enum mood {\n  a\n  b\n}")], key=str)
    # the second table does not fit, the third does; what leads out of the slice is a comment, and its enum goes
    got = {r[1]: (r[2], r[4]) for r in rows(schema.sliced(columns, keys, ["log", "emp", "dept"], size["Log"] + size["dept"], enums))}
    assert got == {"Log": ("included", log + "\n// Ref: Log.at > emp.id"), "emp": ("omitted", None), "dept": ("included", dept)}
    assert {r[2] for r in rows(schema.sliced(columns, keys, ["*"], 1))} == {"omitted"}
    assert rows(schema.sliced(columns.limit(0), keys.limit(0), ["*"], 100)) == [("*", None, "missing", None, None)] and rows(schema.sliced(columns, keys, [], 100)) == []


def test_slice_in_any_filter_order(spark):
    # Spark may evaluate what it infers from a join before the filter that keeps tables with a glob, so no table may fail there
    columns = spark.createDataFrame([("emp", 1, "id", "int"), ("dept", 1, "id", "int")], COLUMNS)
    got = schema.sliced(columns, spark.createDataFrame([], KEYS), ["e*"], 100)
    assert "element_at(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[:3] for r in got.collect()] == [("e*", "emp", "included")]


def test_drift(spark):
    before = spark.createDataFrame([("column", "t", "a", "int"), ("column", "t", "b", None), ("index", "t", "ix", "a"), ("index", "t", "ix", "a"), ("column", "gone", "a", "int"), ("routine", None, "f", "x"), ("routine", None, "g", "x")], PART)
    after = spark.createDataFrame([("column", "t", "a", "bigint"), ("column", "t", "b", ""), ("check", "t", "a", "a > 0"), ("column", "fresh", "a", "int"), ("index", "fresh", "ix", "a"), ("routine", None, "f", "x"), ("routine", None, "f", "y")], PART)
    uses = spark.createDataFrame([(f"s{i}", "T") for i in range(9)] * 2 + [("s1", "gone"), (None, "t"), ("s2", None)], "statement string, table_name string")
    many = (9, "s0, s1, s2, s3, s4, s5, s6, s7")
    want = [
        ("column", "t", "a", "int", "bigint", "changed", *many),
        ("index", "t", "ix", "a", None, "removed", *many),
        ("check", "t", "a", None, "a > 0", "added", *many),
        ("table", "gone", "gone", None, None, "removed", 1, "s1"),
        ("table", "fresh", "fresh", None, None, "added", 0, ""),
        ("routine", None, "f", "x", "x\ny", "changed", 0, ""),
        ("routine", None, "g", "x", None, "removed", 0, ""),
    ]
    assert rows(schema.drifted(before, after, uses)) == sorted(want, key=str)
    assert rows(schema.drifted(before, before, uses)) == [] and rows(schema.drifted(before.limit(0), before.limit(0), uses.limit(0))) == []


def test_changed_units(spark):
    before = spark.createDataFrame([("f", "a", 1, 10), ("f", "b", 11, 20), ("f", None, 1, 99), ("g", "a", 1, 9)], PLACE)
    after = spark.createDataFrame([("f", "a", 1, 10), ("f", "c", 11, 15), ("f", "c", 200, 900), (None, "z", 1, 9)], PLACE)
    hunks = [("f", 1, 2, 10, 11, 2, 2), ("f", 1, 2, 10, 11, 2, 2), ("f", 12, 13, 14, 13, 0, 2), ("f", 50, 50, 500, 500, 1, None), ("g", 50, 50, None, None, 1, 1), ("h", 1, 1, 1, 1, 4, 0), (None, 1, 1, 1, 1, 1, 1)]
    got = rows(units.changed_units(spark.createDataFrame(hunks, HUNK), before, after))
    assert got == sorted([("f", "a", "changed", 5, 6), ("f", "b", "removed", 5, 6), ("f", "c", "new", 5, 6), ("g", None, "common", 1, 1), ("h", None, "common", 4, 0)], key=str)
    assert rows(units.changed_units(spark.createDataFrame([], HUNK), before, after)) == []
    assert {r[2] for r in rows(units.changed_units(spark.createDataFrame(hunks, HUNK), before.limit(0), after.limit(0)))} == {"common"}


def test_screens(spark):
    changed = spark.createDataFrame([("f", "p.a"), ("f", "p.b"), ("f", None), ("g", "q.a"), ("g", "q.z"), ("f", "p.a"), ("h", "x")], "file string, unit string")
    links = spark.createDataFrame([("p.a", "s1"), ("p.a", "s1"), ("p.a", "s2"), ("r.b", "s3"), ("b", "s4"), ("q.z", None), (None, "s9")], "name string, screen string")
    by_file = spark.createDataFrame([("f", "s5"), ("g", "s6"), ("g", "s6"), ("h", None), (None, "s7")], "file string, screen string")
    want = [("f", "p.a", "s1", "name"), ("f", "p.a", "s2", "name"), ("f", "p.b", "s3", "bare name"), ("f", "p.b", "s4", "bare name"), ("f", None, "s5", "file"), ("g", "q.a", "s1", "bare name"), ("g", "q.a", "s2", "bare name"), ("g", "q.z", "s6", "file"), ("h", "x", None, None)]
    assert rows(units.screens_of(changed, links, by_file)) == sorted(want, key=str)
    assert rows(units.screens_of(changed.limit(0), links, by_file)) == []
    assert {r[2:] for r in rows(units.screens_of(changed, links.limit(0), by_file.limit(0)))} == {(None, None)}


def test_overlaps_within_groups(spark):
    rng = random.Random(5)
    make = lambda tag: [(rng.choice("xyz"), f"{tag}{i}", a := rng.randrange(300), a + rng.randrange(-2, 90)) for i in range(60)]
    a, b = make("a"), make("b")
    want = sorted((g, i, j) for g, i, lo, hi in a for h, j, lo2, hi2 in b if g == h and lo <= hi and lo2 <= hi2 and lo <= hi2 and lo2 <= hi)
    frame = lambda data, name: spark.createDataFrame(data, f"g string, {name} string, lo int, hi int")
    assert rows(intervals.overlaps(frame(a, "i"), frame(b, "j"), 16, ["g"]).select("g", "i", "j")) == want


def test_ranges(spark):
    now = datetime(2024, 3, 1, 8, 0, tzinfo=ZoneInfo("Asia/Seoul"))
    at = lambda *t: datetime(2024, *t)
    assert ranges.resolve(now, since="1.5h") == (at(2, 29, 21, 30), None) and ranges.resolve(now, default="2d", log_zone="Asia/Seoul") == (at(2, 28, 8, 0), None)
    assert ranges.resolve(now, start="07:59:30", end="09:00") == (at(2, 29, 22, 59, 30), at(2, 29, 0, 0)) and ranges.resolve(now) == (None, None)
    assert ranges.resolve(now, start="2024-02-01 10:00", end="2024-02-01T10:00:00Z") == (at(2, 1, 1, 0), at(2, 1, 10, 0))
    assert ranges.resolve(now, run=now, default="1h") == (at(2, 29, 23, 0), None) and ranges.resolve(now, deployed=at(1, 1), default="1h") == (at(1, 1), None)
    for bad in ({"since": "1h", "start": "10:00"}, {"since": "soon"}, {"since": ""}, {"start": "noon"}, {"start": "2024-02-01"}, {"end": "25:00"}, {"run": at(1, 1)}):
        with pytest.raises(ValueError):
            ranges.resolve(now, **bad)
    log = spark.createDataFrame([(at(1, 1), "Started App in 3 seconds"), (at(1, 2), "Started App in 2.5 seconds (x)"), (at(1, 3), "Started in time"), (None, "Started App in 1 seconds"), (at(1, 4), None)], "at timestamp_ntz, message string")
    assert ranges.last_start(log, "at", "message") == at(1, 2) and ranges.last_start(log.limit(0), "at", "message") is None
    days = lambda *ends: [r["at"] and r["at"].day for r in ranges.between(log, "at", *ends).orderBy("at").collect()]
    assert days(None, None) == [None, 1, 2, 3, 4] and days(at(1, 2), at(1, 3)) == [2, 3] and days(at(1, 3), None) == [3, 4] and days(None, at(1, 1)) == [1] and days(at(2, 1), at(1, 1)) == []


def test_archived_logs(spark, tmp_path):
    for name in ("2024-01/app-info-2024-01-31.0", "2024-02/app-info-2024-02-01.0", "2024-02/app-error-2024-02-01.1", "2024-02/app-info-2024-02-02.0", "2024-02/other-info-2024-02-01.0"):
        path = tmp_path / "archived" / f"{name}.log.gz"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(f"{name}\nmore\n".encode()))
    read = lambda *a: sorted(r["line"].split("/")[-1] for r in files.archived_lines(spark, str(tmp_path), "app", *a).collect() if r["line"] != "more")
    assert read(date(2024, 1, 31), date(2024, 2, 1)) == ["app-error-2024-02-01.1", "app-info-2024-01-31.0", "app-info-2024-02-01.0"]
    assert read(date(2024, 2, 1), date(2024, 2, 29), ("info",)) == ["app-info-2024-02-01.0", "app-info-2024-02-02.0"]
    assert read(date(2025, 1, 1), date(2025, 1, 2)) == [] and read(date(2024, 2, 2), date(2024, 2, 1)) == []


def test_json_and_jdbc(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 'a"b'), (2, "x\ty", "한글")], "i int, n string, s string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.orderBy("i").select(files.json_line(i=F.col("i"), n=F.col("n"), s=F.col("s"))).collect()] == ['{"i":1,"n":null,"s":"a\\"b"}', '{"i":2,"n":"x\\ty","s":"한글"}']
    files.write_json(df, f"{tmp_path}/out")
    assert rows(spark.read.schema(df.schema).json(f"{tmp_path}/out")) == rows(df)
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("CAST(id AS INT) AS k", "CAST(id % 7 AS INT) AS v").write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    whole = files.jdbc(spark, url, 'SELECT "k", "v" FROM t WHERE "v" < 3', driver="org.apache.derby.jdbc.EmbeddedDriver")
    parts = files.jdbc(spark, url, 'SELECT "k", "v" FROM t WHERE "v" < 3', key="k", ends=(20, 60), parts=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    want = sorted(((i, i % 7) for i in range(100) if i % 7 < 3), key=str)
    assert rows(whole) == want and rows(parts) == want and parts.rdd.getNumPartitions() == 4
    with pytest.raises(ValueError):
        files.jdbc(spark, url, "SELECT 1", key="k")
