"""One-to-one pairing of elements by their sets of identifiers.

Elements with equal sets are one class, and classes are paired, not their members: first classes with equal sets, then, in rounds,
those that overlap most.  Of a pair of classes as many members meet as both have left, in order; none is used twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import ordered
from ledgerline.operators.lineage import kept

SEP = "\x1f"


def _members(df: DataFrame, by: list[str], tokens: str, order: str) -> DataFrame:
    """(by, order, set, rank): rank in the order of the class, from 1; elements without identifiers have a null set."""
    known = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(tokens), F.array().cast("array<string>")))))
    rows = df.select(*by, order, F.when(F.size(known) > 0, F.array_join(known, SEP)).alias("set"))
    return kept(ordered.ranked(rows, [*by, "set"], [order]))


def _same(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _candidates(left: DataFrame, right: DataFrame, by: list[str], least: int) -> DataFrame:
    """(by, l, r, overlap) of classes whose sets overlap by ``least`` percent; only their rarest identifiers meet."""
    sets = left.select(*by, "set").union(right.select(*by, "set")).distinct()
    words = lambda df: df.select(*by, "set", F.explode(F.split("set", SEP)).alias("word"))
    often = words(sets).groupBy(*by, "word").agg(F.count("*").alias("c"))

    def prefixes(df: DataFrame) -> DataFrame:
        """The words of which two sets that overlap enough share one: all but ceil(least * n / 100) - 1, rarest first."""
        met = words(df).alias("w").join(often.alias("o"), _same("w", "o", [*by, "word"])).select("w.*", "o.c")
        ranked = met.groupBy(*by, "set").agg(F.array_sort(F.collect_list(F.struct("c", "word"))).alias("ws"))  # a set's own words
        n = F.size("ws")
        return ranked.select(*by, "set", F.explode(F.slice("ws", F.lit(1), (n - F.ceil(n * least / 100) + 1).cast("int"))).alias("x")).select(*by, "set", "x.word")

    met = prefixes(left).alias("a").join(prefixes(right).alias("b"), _same("a", "b", [*by, "word"]))
    met = met.select(*[f"a.{b}" for b in by], F.col("a.set").alias("l"), F.col("b.set").alias("r")).distinct()
    a, b = F.split("l", SEP), F.split("r", SEP)
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return met.withColumn("overlap", both / either).where(100 * both >= least * either)


def pair(left: DataFrame, right: DataFrame, by: list[str], tokens: str, order: str, least: int | None = None) -> DataFrame:
    """(by, left, right, how, overlap): pairs of elements of the same ``by``, and those of either side alone.

    Elements are known by ``order``, unique within ``by``.  how: same (equal sets, in order), near (``least`` percent of
    overlap or more: the largest overlap first, then the least sets), left or right (alone).  Without ``least`` only equal sets
    pair.  An element without identifiers stays alone.  Null values of ``by`` are a group.
    """
    l, r = _members(left, by, tokens, order), _members(right, by, tokens, order)
    classes = lambda m: m.where("set IS NOT NULL").groupBy(*by, "set").agg(F.count("*").alias("n"))
    lc, rc = classes(l), classes(r)
    met = lc.alias("a").join(rc.alias("b"), _same("a", "b", [*by, "set"])).select(*[f"a.{b}" for b in by], F.col("a.set").alias("l"), F.col("b.set").alias("r"), F.lit(0).cast("long").alias("from_l"), F.lit(0).cast("long").alias("from_r"), F.least("a.n", "b.n").alias("m"), F.lit(1.0).alias("overlap"))
    met = kept(met)
    if least is not None:
        left_over = lambda c, side: c.alias("c").join(met.alias("m"), _same("c", "m", by) & (F.col("c.set") == F.col(f"m.{side}")), "left").select("c.*", F.coalesce("m.m", F.lit(0)).alias("used")).where("n > used")
        a, b = kept(left_over(lc, "l")), kept(left_over(rc, "r"))
        pairs = kept(_candidates(a, b, by, least))
        used = lambda side, n: [F.col(f"{side}.n").alias(f"n_{n}"), F.col(f"{side}.used").alias(f"from_{n}")]
        while not pairs.isEmpty():
            first = F.min(F.struct((-F.col("overlap")).alias("o"), "l", "r")).alias("best")
            best = [pairs.groupBy(*by, side).agg(first).select(*by, "best.l", "best.r") for side in "lr"]
            chosen = best[0].alias("x").join(best[1].alias("y"), _same("x", "y", [*by, "l", "r"])).select("x.*").alias("x")
            chosen = chosen.join(a.alias("a"), _same("x", "a", by) & (F.col("x.l") == F.col("a.set"))).join(b.alias("b"), _same("x", "b", by) & (F.col("x.r") == F.col("b.set")))
            chosen = chosen.select("x.*", *used("a", "l"), *used("b", "r")).withColumn("m", F.least(F.col("n_l") - F.col("from_l"), F.col("n_r") - F.col("from_r")))
            chosen = kept(chosen.alias("x").join(pairs.alias("p"), _same("x", "p", [*by, "l", "r"])).select("x.*", "p.overlap"))
            met = met.unionByName(chosen.select(met.columns))
            spend = lambda c, side: kept(c.alias("c").join(chosen.alias("x"), _same("c", "x", by) & (F.col("c.set") == F.col(f"x.{side}")), "left").select(*[f"c.{k}" for k in by], "c.set", "c.n", (F.col("c.used") + F.coalesce("x.m", F.lit(0))).alias("used")).where("n > used"))  # noqa: E731, B023
            a, b = spend(a, "l"), spend(b, "r")
            open_ = pairs.alias("p").join(a.alias("a"), _same("p", "a", by) & (F.col("p.l") == F.col("a.set")), "left_semi").alias("p").join(b.alias("b"), _same("p", "b", by) & (F.col("p.r") == F.col("b.set")), "left_semi")
            pairs = kept(open_)
    # members by their place in the class
    m = kept(met).alias("m")
    of = l.alias("e").join(m, _same("e", "m", by) & (F.col("e.set") == F.col("m.l")) & (F.col("e.rank") > F.col("m.from_l")) & (F.col("e.rank") <= F.col("m.from_l") + F.col("m.m")))
    of = of.select(*[f"e.{b}" for b in by], F.col(f"e.{order}").alias("left"), F.col("m.r").alias("set"), (F.col("e.rank") - F.col("m.from_l") + F.col("m.from_r")).alias("rank"), F.when(F.col("m.l") == F.col("m.r"), "same").otherwise("near").alias("how"), "m.overlap").alias("f")
    pairs = kept(of.join(r.alias("e"), _same("f", "e", [*by, "set", "rank"])).select(*[f"f.{b}" for b in by], "f.left", F.col(f"e.{order}").alias("right"), "f.how", "f.overlap"))
    none = F.lit(None).cast("double").alias("overlap")
    alone = lambda side, name: side.alias("e").join(pairs.alias("p"), _same("e", "p", by) & F.col(f"e.{order}").eqNullSafe(F.col(f"p.{name}")), "left_anti")
    nothing = lambda side: F.lit(None).cast(side.schema[order].dataType)
    return pairs.unionByName(alone(l, "left").select(*by, F.col(order).alias("left"), nothing(right).alias("right"), F.lit("left").alias("how"), none)).unionByName(alone(r, "right").select(*by, nothing(left).alias("left"), F.col(order).alias("right"), F.lit("right").alias("how"), none))
