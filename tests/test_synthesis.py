"""Made rows under keys, and catalogs that read what has changed."""

import os
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.synthesis import LEAST_KEY, Made, Maker, key_faults
from ledgerline.sources import snapshot


def test_seven_tables_without_orphans_or_repeats(spark):
    known = spark.createDataFrame([(5,), (1_000_000,), (None,), (5,)], "c_id long")
    maker = Maker(spark, seed=7)
    sizes = {"region": 5, "nation": 25, "supplier": 40, "customer": 301, "part": 128, "orders": 997, "lineitem": 2000}
    tables = {
        "region": maker.table("region", 5, [Made("id", "key"), Made("name", "unique_text", prefix="R", length=3)]),
        "nation": maker.table("nation", 25, [Made("id", "key"), Made("region", "parent", table="region", column="id")]),
        "supplier": maker.table("supplier", 40, [Made("id", "key"), Made("nation", "parent", table="nation", column="id"), Made("balance", "number", least=-10, most=10, digits=2)]),
        "customer": maker.table("customer", 301, [Made("id", "key", rows=known, column="c_id"), Made("nation", "parent", table="nation", column="id"), Made("old", "existing", rows=known, column="c_id", nulls=20)]),
        "part": maker.table("part", 128, [Made("code", "unique_text", prefix="T1_", length=8), Made("id", "key"), Made("kind", "code", values=("a", "b", "c"))]),
        "orders": maker.table("orders", 997, [Made("id", "key"), Made("customer", "parent", table="customer", column="id"), Made("day", "day", values=("2024-01-01",), most=28), Made("yes", "flag", values=("Y", "N"))]),
        "lineitem": maker.table("lineitem", 2000, [Made("id", "key"), Made("orders", "parent", table="orders", column="id"), Made("part", "parent", table="part", column="id", nulls=10), Made("note", "text", prefix="n", length=6), Made("who", "fixed", values=(3,))]),
    }
    refers = {"nation": {"region": "region"}, "supplier": {"nation": "nation"}, "customer": {"nation": "nation"}, "orders": {"customer": "customer"}, "lineitem": {"orders": "orders", "part": "part"}}
    for name, df in tables.items():
        parents = {c: tables[t].select("id") for c, t in refers.get(name, {}).items()} | ({"old": known} if name == "customer" else {})
        assert tuple(key_faults(df, ["id"], parents).first()) == (sizes[name], 0, 0)
        assert df.agg(F.min("id")).first()[0] > (1_000_000 if name == "customer" else LEAST_KEY)
        assert sorted(map(str, df.collect())) == sorted(map(str, df.repartition(3).collect()))
    assert tables["part"].select("code").distinct().count() == 128 and tables["part"].agg(F.max(F.length("code"))).first()[0] <= 8
    assert 0 < tables["lineitem"].where("part is null").count() < 400
    assert tables["orders"].select("day").distinct().count() == 28 and tables["orders"].select("customer").distinct().count() > 200
    assert tuple(key_faults(spark.createDataFrame([(1, 9), (1, 2), (2, None)], "id int, p int"), ["id"], {"p": spark.createDataFrame([(2,)], "k int")}).first()) == (3, 1, 1)


def test_refused(spark):
    with pytest.raises(ValueError, match="has not been made"):
        Maker(spark).table("x", 3, [Made("p", "parent", table="nowhere", column="id")])
    with pytest.raises(ValueError, match="don't hold"):
        Maker(spark).table("x", 37, [Made("u", "unique_text", length=1)])
    with pytest.raises(ValueError, match="no row"):
        Maker(spark).table("x", 3, [Made("p", "existing", rows=spark.range(0), column="id")])
    assert Maker(spark).table("x", 0, [Made("id", "key"), Made("u", "unique_text", length=1)]).count() == 0


def test_catalog_reads_changed_files_alone(spark, tmp_path):
    src, folder = tmp_path / "src", f"file://{tmp_path}/catalog"
    src.mkdir()
    for i in range(6):
        (src / f"f{i}.txt").write_text("line\n" * i or "x")
    (src / "other.md").write_text("x")
    read = []

    def parse(stale):
        read.append(sorted(os.path.basename(r["path"]) for r in stale.collect()))
        return snapshot.contents(spark, stale).select("path", (F.size(F.split("text", "\n")) - 1).alias("n_lines"))

    run = lambda: {os.path.basename(r["path"]): (r["n_lines"], r["read_in"]) for r in snapshot.refresh(snapshot.listing(spark, f"file://{src}", "*.txt"), parse, folder).collect()}
    assert run() == {f"f{i}.txt": (i, 1) for i in range(6)}
    assert run() == {f"f{i}.txt": (i, 1) for i in range(6)}  # nothing changed: no version, nothing read
    (src / "f1.txt").write_text("a\nb\nc\n")
    (src / "f2.txt").unlink()
    (src / "f9.txt").write_text("new\n")
    os.utime(src / "f3.txt", (time.time() + 100, time.time() + 100))
    assert run() == {"f0.txt": (0, 1), "f1.txt": (3, 2), "f3.txt": (3, 2), "f4.txt": (4, 1), "f5.txt": (5, 1), "f9.txt": (1, 2)}
    (src / "f0.txt").unlink()
    assert set(run()) == {"f1.txt", "f3.txt", "f4.txt", "f5.txt", "f9.txt"}
    assert read == [[f"f{i}.txt" for i in range(6)], ["f1.txt", "f3.txt", "f9.txt"], []]
    assert snapshot.current(spark, folder)[0] == 3
