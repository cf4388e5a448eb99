"""Order, limits and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators import ordered
from ledgerline.operators.lineage import kept


def capped(df: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, with how many of the group were left out."""
    w = Window.partitionBy(by)
    first = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= most)
    return first.join(df.groupBy(by).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("n_omitted")), by)


def within_budget(items: Column, budget: int) -> Column:
    """Names of ordered (name, size) items that fit a budget: one that does not fit is skipped, later ones may fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("names"))
    fits = lambda acc, x: acc["used"] + x["size"] <= budget
    step = lambda acc, x: F.struct(F.when(fits(acc, x), acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"), F.when(fits(acc, x), F.concat(acc["names"], F.array(x["name"]))).otherwise(acc["names"]).alias("names"))
    return F.aggregate(items, start, step, lambda acc: acc["names"])


ROUNDS = 12


def budgeted(df: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """The rows of each group, in order, that fit a budget: one that does not fit is skipped, later ones may fit.

    Items larger than what is left drop out first, so of the rest the longest run that fits is taken at once, by a running sum over
    ranges; each round takes a row at least from every open group, and the first that does not fit is too large from
    then on.  What is still open after ``ROUNDS`` is walked item by item; only its keys and sizes meet in a row.  Sizes are not
    negative, a null size is 0, and ``order`` is unique in a group.  Null groups are a group.
    """
    weight = F.coalesce(F.col(size).cast("long"), F.lit(0))
    left = kept(df.select(by, order, weight.alias("_size"), F.lit(0).cast("long").alias("_used")).where(F.col("_size") <= budget))
    taken = None
    for _ in range(ROUNDS):
        run = kept(ordered.running(ordered.in_ranges(left, [by], [order]), [by], "_run", F.col("_size")).select(*left.columns, "_run"))
        fits = run.where(F.col("_used") + F.col("_run") <= budget)
        taken = fits.select(by, order) if taken is None else taken.union(fits.select(by, order))
        more = fits.groupBy(by).agg(F.max("_run").alias("_more")).alias("m")
        rest = run.where(F.col("_used") + F.col("_run") > budget).alias("r").join(more, F.col(f"r.{by}").eqNullSafe(F.col(f"m.{by}")))
        rest = rest.select(F.col(f"r.{by}").alias(by), F.col(f"r.{order}").alias(order), "_size", (F.col("_used") + F.col("_more")).alias("_used"))
        left = kept(rest.where(F.col("_used") + F.col("_size") <= budget))
        if left.isEmpty():
            break
    else:
        names = left.groupBy(by, "_used").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("name"), F.col("_size").alias("size")))).alias("items"))
        start = F.struct(F.col("_used").alias("used"), F.array().cast(left.select(F.array(order).alias("a")).schema["a"].dataType).alias("names"))
        fits = lambda acc, x: acc["used"] + x["size"] <= budget
        step = lambda acc, x: F.when(fits(acc, x), F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["names"], F.array(x["name"])).alias("names"))).otherwise(acc)
        taken = taken.union(names.select(by, F.explode(F.aggregate("items", start, step, lambda acc: acc["names"])).alias(order)))
    same = F.col(f"d.{by}").eqNullSafe(F.col(f"t.{by}")) & (F.col(f"d.{order}") == F.col(f"t.{order}"))
    return df.alias("d").join(taken.alias("t"), same, "left_semi")


def longest_depth(edges: DataFrame, nodes: DataFrame, child: str, parent: str, node: str, most: int = 100) -> DataFrame:
    """(node, depth): the longest chain of parents over each node, so that parents sort before children.

    Depths are raised by joins until none changes; a cycle would raise them for ever and ends in an error.
    """
    depth = nodes.select(node, F.lit(0).alias("depth")).distinct()
    total = 0
    for _ in range(most):
        up = edges.join(depth, F.col(parent) == F.col(node)).groupBy(child).agg((F.max("depth") + 1).alias("up"))
        depth = kept(depth.join(up, F.col(node) == F.col(child), "left").select(node, F.greatest("depth", F.coalesce("up", F.lit(0))).alias("depth")))
        new = depth.agg(F.sum("depth")).first()[0] or 0
        if new == total:
            return depth
        total = new
    raise ValueError(f"edges hold a cycle or a chain of over {most}")


def next_keys(df: DataFrame, key: str, new: DataFrame, order: str, least: int = 900_000) -> DataFrame:
    """``new`` (a small batch) with keys that follow the largest in use, from ``least`` on."""
    base = df.agg(F.greatest(F.coalesce(F.max(key), F.lit(0)), F.lit(least)).alias("_base"))
    return new.crossJoin(F.broadcast(base)).withColumn("new_key", F.col("_base") + F.row_number().over(Window.orderBy(order))).drop("_base")


def lines_of(text: Column, first: int, last: int) -> Column:
    """Lines ``first`` to ``last`` of a text, from 1; negative ones count from its end."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    at = lambda k: F.lit(k) if k > 0 else F.greatest(n + 1 + k, F.lit(1))
    return F.slice(lines, at(first), F.greatest(at(last) - at(first) + 1, F.lit(0)))


def natural(column: Column) -> Column:
    """Order of menu numbers: as integers, others last."""
    return F.coalesce(column.try_cast("int"), F.lit(999_999))
