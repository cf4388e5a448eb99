"""Cited places of texts: whether a cited excerpt still stands, has moved, was changed or is gone.

Texts are compared as words: white space of any kind and blank lines don't count, so re-indented and re-wrapped lines are
equal.  An excerpt may stand at any run of whole lines.  Runs are found by rolling hashes of 64 bits over the
hashes of a text's words, one pass for each length that is asked for, and met with the excerpts by an equi-join; of
several places the nearest to the cited line is found by a merge in line order, never by pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: fixed value: what ends a line
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_ENDS = re.compile(LINE_END)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
PLACES = "_path string, _n long, _hash long, first long, last long, before long, after long"


def collapsed(text: Column) -> Column:
    """A text's words, joined by single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def lines_of(text: Column) -> Column:
    """An array of a text's lines; an end of line at its end begins no other."""
    found = F.split(text, LINE_END)
    return F.when(F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)


def cite(files: DataFrame, places: DataFrame, path: str, text: str, line: str, line_end: str) -> DataFrame:
    """``places`` with the collapsed excerpt of their lines; null if a line is beyond the text, the range is upside down or blank."""
    met = places.join(files.select(path, F.col(text).alias("_text")), path, "left").withColumn("_lines", lines_of(F.col("_text")))
    a, b = F.col(line), F.coalesce(F.col(line_end), F.col(line))
    whole = F.when(F.col(line).isNull(), collapsed(F.col("_text")))
    inside = F.when((a >= 1) & (b >= a) & (b <= F.size("_lines")), collapsed(F.array_join(F.slice("_lines", a.cast("int"), (b - a + 1).cast("int")), "\n")))
    return met.select(*places.columns, F.nullif(F.coalesce(whole, inside), F.lit("")).alias("excerpt"))


class _Runs:
    """Hashes of runs of a text's words."""

    def __init__(self, words: list[str]):
        with np.errstate(over="ignore"):
            n = len(words)
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _INVERSE, np.uint64))])
            up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), _BASE, np.uint64))])[:n]
            hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=True) if n else np.zeros(0, np.uint64)
            self.total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up, dtype=np.uint64)])

    def of(self, start: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((self.total[start + n] - self.total[start]) * self.down[start]).view(np.int64)


def _hash(excerpt: pd.Series) -> pd.Series:
    return pd.Series([int(_Runs(x.split(" ")).of(np.zeros(1, np.int64), x.count(" ") + 1)[0]) for x in excerpt], dtype="int64")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of whole lines with a length that is asked for: hash, first and last line, and the lines with words around them."""
    for batch in batches:
        for path, text, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = [(i, words) for i, x in enumerate(_ENDS.split(text), 1) if (words := x.split())]
            number = np.array([-1, *[i for i, _ in lines], 1 << 62], np.int64)  # padded at both ends
            ends = np.cumsum([0, *[len(w) for _, w in lines]])
            runs = _Runs([w for _, words in lines for w in words])
            for n in lengths:
                to = np.searchsorted(ends, ends[:-1] + n)
                fits = np.flatnonzero((to < len(ends)) & (ends[np.minimum(to, len(ends) - 1)] == ends[:-1] + n))
                if len(fits):
                    last = to[fits]
                    columns = [runs.of(ends[fits], n), number[fits + 1], number[last], number[fits], number[last + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(fits)), pa.array([n] * len(fits), pa.int64()), *map(pa.array, columns)], ["_path", "_n", "_hash", "first", "last", "before", "after"])


def check(files: DataFrame, evidence: DataFrame, path: str, text: str, line: str, line_end: str, excerpt: str) -> DataFrame:
    """``evidence`` with status, new_line and new_end.

    OK: the cited lines (all of the text if ``line`` is null) hold the excerpt and no other word.  MOVED: it stands elsewhere, at
    new_line to new_end; of several places the nearest to ``line``, then the upper one.  MISSING: no such text, or
    the line is beyond its end.  STALE: anything else.  An excerpt that is null or blank counts as changed.  Rows alike get
    equal results; of texts with one path any may be read.
    """
    rows = evidence.select(F.col(path).cast("string").alias("_path"), F.col(line).cast("long").alias("_a"), F.coalesce(F.col(line_end), F.col(line)).cast("long").alias("_b"), collapsed(F.col(excerpt)).alias("_excerpt")).distinct()
    rows = rows.withColumn("_n", F.size(F.split("_excerpt", " ")).cast("long")).withColumn("_hash", F.pandas_udf(_hash, "long")("_excerpt"))
    texts = files.select(F.col(path).cast("string").alias("_path"), F.coalesce(F.col(text), F.lit("")).alias("_text")).where("_path IS NOT NULL").groupBy("_path").agg(F.any_value("_text").alias("_text"))
    asked = rows.where("_a IS NOT NULL AND _excerpt <> ''").groupBy("_path").agg(F.collect_set("_n").alias("_lengths"))  # lengths, not excerpts
    found = texts.join(asked, "_path").mapInArrow(_places, PLACES)

    # places and citations of one excerpt in line order; a place comes before a citation of its line
    key = ["_path", "_n", "_hash"]
    place = F.struct("first", "last", "before", "after").alias("_place")
    cited = rows.where("_a IS NOT NULL").select(*key, F.col("_a").alias("_at"), "_b")
    kind = "struct<first:bigint,last:bigint,before:bigint,after:bigint>"
    merged = found.select(*key, F.col("first").alias("_at"), F.lit(None).cast("long").alias("_b"), place).unionByName(cited.distinct().withColumn("_place", F.lit(None).cast(kind)))
    order = Window.partitionBy(*key).orderBy("_at", F.col("_place").isNull())
    above = F.last("_place", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("_place", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = merged.withColumn("_above", above).withColumn("_below", below).where("_place IS NULL").select(*key, F.col("_at").alias("_a"), "_b", "_above", "_below")

    sizes = texts.select("_path", F.size(lines_of(F.col("_text"))).alias("_lines"), F.sha2(collapsed(F.col("_text")), 256).alias("_whole"))
    met = rows.join(sizes, "_path", "left").join(near, [*key, "_a", "_b"], "left")
    here = F.when(F.col("_above.first") == F.col("_a"), F.col("_above")).otherwise(F.col("_below"))  # the first place from the cited line on
    stands = (here["before"] < F.col("_a")) & (here["last"] <= F.col("_b")) & (F.col("_b") < here["after"])
    up, down = F.col("_a") - F.col("_above.first"), F.col("_below.first") - F.col("_a")
    moved = F.when(down.isNull() | (up <= down), F.col("_above")).otherwise(F.col("_below"))
    status = (
        F.when(F.col("_lines").isNull(), "MISSING")
        .when(F.col("_a").isNull(), F.when(F.col("_whole") == F.sha2("_excerpt", 256), "OK").otherwise("STALE"))
        .when(F.coalesce(stands, F.lit(False)), "OK")
        .when(moved.isNotNull(), "MOVED")
        .when(F.col("_a") > F.col("_lines"), "MISSING")
        .otherwise("STALE")
    )
    done = met.select("_path", "_a", F.col("_b").alias("_to"), F.col("_excerpt").alias("_collapsed"), status.alias("status"), moved["first"].alias("_first"), moved["last"].alias("_last"))
    moved_only = lambda c: F.when(F.col("status") == "MOVED", F.col(c))
    same = F.col(path).cast("string").eqNullSafe(F.col("_path")) & F.col(line).cast("long").eqNullSafe(F.col("_a")) & F.coalesce(F.col(line_end), F.col(line)).cast("long").eqNullSafe(F.col("_to")) & (collapsed(F.col(excerpt)) == F.col("_collapsed"))
    return evidence.join(done, same, "left").select(*[evidence[c] for c in evidence.columns], "status", moved_only("_first").alias("new_line"), moved_only("_last").alias("new_end"))


SEVERITY = ("OK", "MOVED", "STALE", "MISSING")  #: fixed values, from light to grave


def verify(rules: DataFrame, checked: DataFrame, rule: str) -> DataFrame:
    """(rule, status, n_evidence): the gravest status of each rule's evidence; a rule without any is MISSING."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status"))
    worst = checked.groupBy(rule).agg(F.max(rank).alias("_worst"), F.count("*").alias("n_evidence"))
    name = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.coalesce("_worst", F.lit(len(SEVERITY))).cast("int"))
    return rules.select(rule).distinct().join(worst, rule, "left").select(rule, name.alias("status"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))
