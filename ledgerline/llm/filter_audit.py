"""Filter interaction audits: what each filter removes in every order, from a relational word pipeline.

Texts are split into rows of words, counted by (doc_id, word) and then by doc_id for totals and distinct words; the flags of
the other filters are outer-joined to that (a text without words has no row there), and each part's documents are counted
in a column for each of the 2**n sets of filters that may fail (32 for five filters).  All orders of the filters follow
from these counts alone: a filter removes the documents that fail it and none before it.

Whole texts shuffle once, by (doc_id, hash of the text), where repeated rows collapse before the shuffle; words are counted
where their text lies, so no word row shuffles.  Equal texts are found by SHA-256, with pre-aggregated minima.  Parts are
summed before they shuffle.

Cases: a null text counts as empty (no words: fails ``A``, passes ``B`` and ``C``); a null source is the part of the empty
string; a null doc_id is neither smaller nor larger than another, so it never fails ``E``, and has no label; rows alike in
doc_id and text don't fail ``E`` against each other, and each counts as a document; of repeated labels any 1 counts; without
documents the result is empty; extra columns are passed over.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, hot_join

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  #: percent of words
MOST_CAPITALS = 2  #: percent of code points
SIGNS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def word_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, key, words, distinct_words) for each distinct (doc_id, text) with a word; key: the text's hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).groupBy("doc_id", "key").agg(F.any_value("text").alias("text"))
    words = texts.select("doc_id", "key", F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
    pairs = words.groupBy("doc_id", "key", "word").agg(F.count("*").alias("times"))
    return pairs.groupBy("doc_id", "key").agg(F.sum("times").alias("words"), F.count("*").alias("distinct_words"))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, n, failing): ``n`` documents alike, with bit i of ``failing`` set if they fail filter i of ``FILTERS``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), capitals.alias("c"), F.rlike(text, F.lit(SIGNS)).alias("d"),
    )
    rows = cut(rows.groupBy("doc_id", "key", "part", "digest", "c", "d").agg(F.count("*").alias("n")))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
    rows = hot_join(rows, least, "digest").withColumn("e", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    stats = word_stats(docs).alias("s")
    met = rows.alias("r").join(stats, F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.key") == F.col("s.key")), "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    failing = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, F.col("c"), F.col("d"), F.col("e")]
    return met.select("r.doc_id", "part", "n", mask(failing).alias("failing"))


def mask(failing: list[Column]) -> Column:
    """An int with bit i set where condition i holds."""
    bits = F.lit(0)
    for i, f in enumerate(failing):
        bits = bits + F.when(f, 1 << i).otherwise(0)
    return bits


def tagged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with booleans ``good`` and ``toxic`` from the labels of their doc_id."""
    tags = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").eqNullSafe(1).alias("good"), F.col("toxic").eqNullSafe(1).alias("toxic"))
    tags = tags.where("doc_id is not null and (good or toxic)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    no = [F.lit(False).alias("good"), F.lit(False).alias("toxic")]
    met = rows.where("doc_id is not null").join(tags, "doc_id", "left")
    return met.na.fill(False, ["good", "toxic"]).select(*rows.columns, "good", "toxic").unionByName(rows.where("doc_id is null").select("*", *no))


def patterns(rows: DataFrame, n_filters: int, kinds: dict[str, str]) -> DataFrame:
    """A row per part with, for each kind (a name and a condition), an array of document counts by set of failing filters (place: the set's bits)."""
    counts = [F.expr(f"coalesce(sum(if({which} AND failing = {m}, n, 0L)), 0L) AS {kind}_{m}") for kind, which in kinds.items() for m in range(1 << n_filters)]
    arrays = [F.expr(f"array({', '.join(f'{kind}_{m}' for m in range(1 << n_filters))}) AS {kind}") for kind in kinds]
    return rows.groupBy("part").agg(*counts).select("part", *arrays)


def every_order(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of ``filters`` and step, from ``patterns`` of kinds all_docs, good and toxic."""
    structs = []
    for order in permutations(range(len(filters))):
        for step, i in enumerate(order):
            structs.append(f"struct('{''.join(filters[j] for j in order)}' AS filter_order, {step + 1} AS step, {1 << i} AS own, {sum(1 << j for j in order[:step])} AS prior)")
    steps = counts.select("*", F.expr(f"inline(array({', '.join(structs)}))"))  # a fixed list of n! * n structs
    sets, n_orders = range(1, 1 << len(filters)), factorial(len(filters))

    def total(kind: str, test: str, weight=lambda m: 1) -> Column:
        """Documents of the sets m of failing filters for which ``test`` holds."""
        return F.expr(" + ".join(f"if({test.replace('m', str(m))}, {kind}[{m}] * {weight(m)}L, 0L)" for m in sets))

    fails, removed = "(m & own) <> 0", "(m & own) <> 0 AND (m & prior) = 0"
    return steps.select(
        "part", "filter_order", "step",
        (F.col("all_docs")[0] + total("all_docs", "(m & (own | prior)) = 0")).alias("kept"), total("all_docs", removed).alias("removed"),
        total("all_docs", f"{fails} AND (m & prior) <> 0").alias("redundant"), total("all_docs", "m = own").alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        # of the orders, one in |m| has this filter before the others of a set m
        total("all_docs", fails, lambda m: n_orders // m.bit_count()).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of ``FILTERS`` over ``docs`` by source, one row per part, order and step."""
    rows = tagged(failures(docs), labels)
    return every_order(cut(patterns(rows, len(FILTERS), {"all_docs": "true", "good": "good", "toxic": "toxic"})))
