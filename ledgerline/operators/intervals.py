"""Joins of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(left: DataFrame, right: DataFrame, width: int, by: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose closed intervals (``lo``, ``hi``: integers) overlap, each once; columns but ``by``, which are equal in
    a pair, must differ by name.

    Intervals are listed in cells of ``width``, so that the join is on equal cells; a pair counts in the first cell that
    both share.  An interval makes a row for each cell it covers: pick ``width`` near the intervals' usual length.
    """
    cells = lambda df, p: df.withColumnsRenamed({"lo": f"{p}lo", "hi": f"{p}hi"}).where(F.col(f"{p}lo") <= F.col(f"{p}hi")).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(f"{p}lo") / width), F.floor(F.col(f"{p}hi") / width))))
    met = cells(left, "_l").join(cells(right, "_r"), ["_cell", *(by or [])]).where("_llo <= _rhi AND _rlo <= _lhi")
    return met.where(F.col("_cell") == F.floor(F.greatest("_llo", "_rlo") / width)).drop("_cell", "_llo", "_lhi", "_rlo", "_rhi")
