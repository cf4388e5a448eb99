"""License scans by ordered signature rules, in DataFrame operations only.

Rules (``license_rules.py``) are regular expressions over a text's words (lower case, joined by single spaces): names,
identifiers, headers and sentences of licenses.  A rule is tried only on texts that hold its keyword.  Where detections overlap,
one that lies within another is suppressed; of equal places the rule of higher priority stays.

Cases: words are runs of bytes 0-9, a-z (after lower-casing A-Z) and everything beyond ASCII; a null text counts as
empty: no words, no labels (empty strings), score 0; repeated rows get equal results; an empty table gives an empty
result; extra columns of any name are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import cut
from ledgerline.llm.license_rules import rule_rows

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: words or parts of them of which a text, lower-cased, holds one if any rule or base phrase can match it, whatever separates
#: its words; or "cc" and "by", next to each other
GATE = ("licen", "reserved", "permission", "redistribution", "domain", "warrant", "copyright", "spdx", "acknowledg")
GATE_CC = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def _rules(spark: SparkSession) -> DataFrame:
    rows = [f"({i}, '{label}', '{p}', '{key}', {sure}D, {rank})".replace("\\", "\\\\") for i, label, p, key, sure, rank in rule_rows()]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS r(rule, label, pattern, keyword, sure, rank)")


def _places(norm: Column, pattern: Column) -> Column:
    """Array of (start, end) in words of the matches of a pattern in words joined by single spaces."""
    match = F.call_function("regexp_extract_all", norm, pattern, F.lit(0))
    gaps = F.call_function("split", norm, pattern)
    words = lambda s: F.size(F.filter(F.split(s, " "), lambda w: w != ""))
    sizes = F.transform(F.arrays_zip(gaps.alias("g"), match.alias("m")), lambda z: F.struct(words(z["g"]).alias("g"), F.when(z["m"].isNull(), 0).otherwise(words(z["m"])).alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("all"))
    step = lambda acc, z: F.struct((acc["at"] + z["g"] + z["m"]).alias("at"), F.when(z["m"] > 0, F.concat(acc["all"], F.array(F.struct((acc["at"] + z["g"]).alias("first"), (acc["at"] + z["g"] + z["m"]).alias("last"))))).otherwise(acc["all"]).alias("all"))
    return F.aggregate(sizes, start, step, lambda acc: acc["all"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections) for each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(text)
    gate = F.lit(False)
    for g in GATE:
        gate = gate | F.contains(low, F.lit(g))
    gate = gate | (F.contains(low, F.lit("cc")) & F.rlike(low, F.lit(GATE_CC)))
    exact = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = F.when(gate, F.array_join(F.regexp_extract_all(exact, F.lit(WORD), F.lit(0)), " "))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(ANY_WORD)).cast("long").alias("n_words"), F.xxhash64(text).alias("key"), norm.alias("norm")))

    # base phrases: words of a phrase that stand consecutively
    places = F.concat(*[F.transform(_places(F.col("norm"), F.lit(rf"(?<![^ ]){p}(?![^ ])")), lambda z: z["first"]) for p, _ in BASE])
    held = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.concat(F.lit(" "), F.col("norm"), F.lit(" ")).contains(f" {p} "), F.lit(label)) for p, label in BASE]), lambda x: x.isNotNull())))
    some = rows.where("norm is not null").select("doc_id", "n_words", "key", "norm", places.alias("places"), held.alias("base"))

    # method: rules whose keyword the text holds
    rules = F.broadcast(_rules(docs.sparkSession)).alias("r")  # a few hundred rows
    texts = rows.where("norm is not null").select("doc_id", "key", "norm")
    words = sorted({r[3] for r in rule_rows()})
    held_words = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("norm"), w))
    tried = texts.withColumn("keyword", F.explode(held_words)).join(rules, "keyword")
    tried = tried.where(F.call_function("rlike", F.col("norm"), F.col("pattern")))
    found = tried.select("doc_id", "key", "label", "sure", "rank", "rule", F.explode(_places(F.col("norm"), F.col("pattern"))).alias("p")).select("*", "p.first", "p.last").drop("p").distinct()  # repeated rows find the same places; the texts themselves never shuffle
    before = Window.partitionBy("doc_id", "key").orderBy("first", F.desc("last"), F.desc("rank"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    kept = found.withColumn("reach", F.max("last").over(before)).where("reach is null or reach < last")
    by_text = kept.groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max("sure").alias("sure"), F.count("*").alias("n_detections"))

    joined = some.alias("s").join(by_text.alias("b"), F.col("s.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("s.key") == F.col("b.key")), "left")
    labels = F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>"))))), ",")
    base_score = F.when(F.size("places") > 0, 0.8).otherwise(0.0)
    n = F.size("places").cast("long")
    yes = joined.select("s.doc_id", "n_words", n.alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), F.array_join("base", ",").alias("base_labels"), labels.alias("labels"), F.greatest(base_score, F.coalesce("sure", F.lit(0.0))).alias("score"), F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"))
    none = F.lit(None).cast("long")
    no = rows.where("norm is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_detections"))
    return yes.union(no)
