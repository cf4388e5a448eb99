"""Dropping copies: one Python evaluation a row and task, since each evaluation of a task keeps a worker and its memory."""

from ledgerline.llm import dedup


def test_copies_are_dropped_in_one_python_pass(spark, capsys):
    texts = [(1, "a b"), (2, "A B"), (None, "a b"), (None, None), (None, ""), (-1, "q"), (-1, "Q"), (-5, "q"), (7, "é"), (8, "É"), (9, "only")]
    out = dedup.drop_copies(spark.createDataFrame(texts, "doc_id long, text string"))
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 2  # of rows that are alone and of others, which are different tasks
    got = [(r["doc_id"], dedup.normalise(r["text"]).decode()) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(2, "a b"), (None, ""), (-1, "q"), (7, "é"), (8, "É"), (9, "only")], key=str)
