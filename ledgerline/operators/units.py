"""Changed parts of files: which statements or methods the hunks of a diff touch, and the screens that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import intervals

CELL = 64  #: lines of a cell of the interval join


def changed_units(hunks: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, unit, status, added, removed): what the hunks of each file touch.

    ``hunks`` are (file, old_lo, old_hi, new_lo, new_hi, added, removed), ``before`` and ``after`` the places (file, unit, lo, hi)
    of units, lines from 1, ends included; a range with ``lo > hi`` or a null end is empty.  A hunk touches the units of the new
    file that its new lines overlap, and only if there are none those of the old file that its old lines overlap.  A unit that
    only one state of the file knows is new or removed, else changed.  A file none of whose hunks touches a unit is one row
    without a unit, common.  Counts are the whole file's.  Units of one name in a file are one unit; null names are no units.
    """
    places = lambda df: df.where("file IS NOT NULL AND unit IS NOT NULL").select("file", "unit", "lo", "hi")
    named = hunks.where("file IS NOT NULL").select("file", "old_lo", "old_hi", "new_lo", "new_hi").distinct()
    new = intervals.overlaps(named.withColumns({"lo": F.col("new_lo"), "hi": F.col("new_hi")}), places(after), CELL, ["file"])
    hit = new.select(*named.columns).distinct()
    same = F.lit(True)
    for c in named.columns:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}"))
    rest = named.alias("n").join(hit.alias("h"), same, "left_anti")
    old = intervals.overlaps(rest.withColumns({"lo": F.col("old_lo"), "hi": F.col("old_hi")}), places(before), CELL, ["file"])
    touched = new.select("file", "unit").union(old.select("file", "unit")).distinct()
    was, now = (places(df).select("file", "unit").distinct().withColumn(label, F.lit(True)) for df, label in ((before, "was"), (after, "now")))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").otherwise("changed")
    units = touched.join(was, ["file", "unit"], "left").join(now, ["file", "unit"], "left").select("file", "unit", status.alias("status"))
    sums = hunks.where("file IS NOT NULL").groupBy("file").agg(F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))
    return sums.join(units, "file", "left").select("file", "unit", F.coalesce("status", F.lit("common")).alias("status"), "added", "removed")


def screens_of(units: DataFrame, unit_links: DataFrame, file_links: DataFrame) -> DataFrame:
    """(file, unit, screen, by) of changed units: their screens by full name, else by bare name, else by file.

    ``unit_links`` (name, screen) and ``file_links`` (file, screen) may hold repeats.  A link counts under its name and under the
    bare name, what follows the last dot; a unit is looked up by its full name first and by its bare name only if that gives no
    screen.  A unit no link knows has one row, screen and ``by`` null.
    """
    bare = lambda c: F.substring_index(c, ".", -1)
    rows = units.select("file", "unit").distinct()
    known = unit_links.where("screen IS NOT NULL").select("name", "screen")
    known = known.union(known.select(bare(F.col("name")), "screen")).distinct()
    by_name = rows.join(known, F.col("unit") == F.col("name")).select("file", "unit", "screen", F.lit(1).alias("tier"))
    by_bare = rows.join(known, bare(F.col("unit")) == F.col("name")).select("file", "unit", "screen", F.lit(2).alias("tier"))
    by_file = rows.join(file_links.where("screen IS NOT NULL").select("file", "screen").distinct(), "file").select("file", "unit", "screen", F.lit(3).alias("tier"))
    found = by_name.union(by_bare).union(by_file)
    best = found.groupBy("file", "unit").agg(F.min("tier").alias("best"))
    key = F.col("r.file").eqNullSafe(F.col("b.file")) & F.col("r.unit").eqNullSafe(F.col("b.unit"))
    ranked = rows.alias("r").join(best.alias("b"), key, "left").select("r.file", "r.unit", "best")
    hit = F.col("k.file").eqNullSafe(F.col("f.file")) & F.col("k.unit").eqNullSafe(F.col("f.unit")) & (F.col("k.best") == F.col("f.tier"))
    by = F.element_at(F.array(F.lit("name"), F.lit("bare name"), F.lit("file")), F.col("best"))
    return ranked.alias("k").join(found.alias("f"), hit, "left").select("k.file", "k.unit", "screen", F.when(F.col("best").isNotNull(), by).alias("by"))
