"""Streams that stop and go on: two runs equal one, and what has been read is not read again."""

from ledgerline.operators import logs
from ledgerline.streaming import events

HEAD = "2024-01-02 03:04:05.{:03d} [t{}] [-] [SYSTEM] [-] [main] INFO app.x - message {}"


def lines(n, start=0):
    out = []
    for i in range(start, n):
        out.append(("app", i, HEAD.format(i % 1000, i % 7, i) if i % 3 == 0 else f"\tat line {i}"))
        out.append(("other", i, HEAD.format(i % 1000, i % 5, i)))
    return out


def deliver(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_folding_goes_on_after_a_stop(spark, tmp_path):
    schema = "file string, number long, line string"
    parts = [lines(20), lines(31, 20), lines(60, 31)]
    for i, p in enumerate(parts):
        deliver(spark, f"{tmp_path}/a", p, schema, f"p{i}")
        deliver(spark, f"{tmp_path}/b", p, schema, f"p{i}") if i < 2 else None
    run = lambda folder, name: sorted(map(str, logs.parsed(events.collected(events.records(read(spark, f"{tmp_path}/{folder}", schema), "file", "number", "line"), "append", f"file://{tmp_path}/out", name), "file").collect()))
    whole = run("a", None)
    first = run("b", "tail")
    assert len(first) < len(whole) and run("b", "tail") == first  # nothing new: nothing again
    deliver(spark, f"{tmp_path}/b", parts[2], schema, "p2")
    assert run("b", "tail") == whole
    # as folded at once, but for the record of each file that is still open
    at_once = logs.records(spark.createDataFrame(sum(parts, []), schema), "file", "number", "line").collect()
    last = {f: max(r["record"] for r in at_once if r["file"] == f) for f in ("app", "other")}
    assert whole == sorted(str(r) for r in at_once if r["record"] < last[r["file"]])


def test_a_batch_tried_again_writes_once(spark, tmp_path):
    schema = "file string, number long, line string"
    deliver(spark, f"{tmp_path}/a", lines(9), schema, "p0")
    run = lambda: events.collected(read(spark, f"{tmp_path}/a", schema), "append", f"file://{tmp_path}/out", "again")
    assert run().count() == 18
    (tmp_path / "out/streams/again/checkpoint/commits/0").unlink()  # as if the run had stopped before it was noted
    for crc in (tmp_path / "out/streams/again/checkpoint/commits").glob(".0*"):
        crc.unlink()
    assert run().count() == 18


def test_upserts_touch_their_buckets_alone(spark, tmp_path):
    schema = "k long, n long, v string"
    rows = [[(i % 50, i, f"v{i}") for i in range(300)], [(7, 1000, "new"), (7, 3, "old"), (60, 1, "first")]]
    stream = lambda: read(spark, f"{tmp_path}/in", schema)
    got = []
    for i, part in enumerate(rows):
        deliver(spark, f"{tmp_path}/in", part, schema, f"p{i}")
        got = {r["k"]: (r["n"], r["v"]) for r in events.upsert(stream(), "k", "n", f"file://{tmp_path}/out", "state").collect()}
    want = {}
    for k, n, v in sum(rows, []):
        want[k] = max(want.get(k, (-1, "")), (n, v))
    assert got == want
    assert len(list((tmp_path / "out/streams/state/state/batch=1").glob("bucket=*"))) <= 2
