"""CRUD matrices, gaps and reachability over edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.shared import shared_dir

OPS = ("C", "R", "U", "D")


def crud_matrix(usage: DataFrame, row: str, op: str) -> DataFrame:
    """Usages per row and operation, a column for each operation."""
    counts = [F.sum(F.when(F.col(op) == o, 1).otherwise(0)).cast("long").alias(f"n_{o.lower()}") for o in OPS]
    return usage.groupBy(row).agg(*counts)


def crud_diff(left: DataFrame, right: DataFrame, row: str, op: str) -> DataFrame:
    """Operations of each row that only one side has."""
    a, b = left.select(row, op).distinct(), right.select(row, op).distinct()
    return a.join(b, [row, op], "left_anti").withColumn("change", F.lit("lost")).unionByName(b.join(a, [row, op], "left_anti").withColumn("change", F.lit("added")))


def reach(edges: DataFrame, start: DataFrame, most_hops: int) -> DataFrame:
    """(node, depth): nodes within some hops of the start nodes, at their least depth."""
    return _walk(edges, start, None, most_hops)


def closure(edges: DataFrame, start: DataFrame, stop: DataFrame | None = None, most_hops: int = 1000) -> DataFrame:
    """(node, depth): all nodes that can be reached, at their least depth; ``stop`` nodes are reached but not left.

    edges: (src, dst); start and stop: (node).  Each hop joins the frontier with the edges, and nodes seen before drop out,
    so cycles end; hops go on until the frontier is empty.  Every hop is cut from its lineage in the shared folder.
    """
    return _walk(edges, start, stop, None, most_hops)


def _walk(edges: DataFrame, start: DataFrame, stop: DataFrame | None, hops: int | None, most_hops: int = 1000) -> DataFrame:
    """``hops``: where the walk ends; without it, it goes on until nothing is found and fails after ``most_hops``."""
    frontier = kept(start.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for hop in range(1, (most_hops if hops is None else hops) + 1):
        left = frontier if stop is None else frontier.join(stop.select("node"), "node", "left_anti")
        step = left.select("node").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = kept(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
    if hops is None:
        raise ValueError(f"nodes are still found after {most_hops} hops")
    return seen


def levels(start: DataFrame, hops: list[DataFrame]) -> list[DataFrame]:
    """(row, node) after each hop, the start first: what each row reaches along one edge table (src, dst) after the other.

    Pairs that meet again are merged before each hop, so what shuffles is bounded by rows times nodes of one level, not by
    paths.  Nulls lead nowhere.
    """
    now = start.select("row", "node").where("node IS NOT NULL").distinct()
    out = [now]
    for edges in hops:
        now = now.join(edges.select("src", "dst").where("dst IS NOT NULL").distinct(), F.col("node") == F.col("src")).select("row", F.col("dst").alias("node")).distinct()
        out.append(now)
    return out


def expand(start: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """(row, node): what each row of ``start`` (row, node) reaches after all hops."""
    return levels(start, hops)[-1]


def crud_usages(start: DataFrame, hops: list[DataFrame], usage: DataFrame, via: int = 1) -> DataFrame:
    """(row, table, op, source), each once: what a screen does to tables, and through what.

    start: (row, node); hops: edge tables (src, dst) that lead to statements; usage: (node, table, op).  source names the
    statement and, in parentheses, the node after ``via`` hops (a service, a function) that led there: ``sql (service)``.  Only
    (row, that node, node) travels, merged before each hop.
    """
    begun = expand(start, hops[:via])
    on = begun.select(F.struct("row", F.col("node").alias("via")).alias("row"), "node")
    met = expand(on, hops[via:]).join(usage.select("node", F.lower("table").alias("table"), "op").where("table IS NOT NULL AND op IS NOT NULL").distinct(), "node")
    return met.select("row.row", "table", "op", F.concat(F.col("node"), F.lit(" ("), F.col("row.via"), F.lit(")")).alias("source")).distinct()


def direct_usages(start: DataFrame, usage: DataFrame, label: str) -> DataFrame:
    """(row, table, op, source) of nodes that write without a statement; source: ``label (node)``."""
    used = usage.select("node", F.lower("table").alias("table"), "op").where("table IS NOT NULL AND op IS NOT NULL").distinct()
    return start.select("row", "node").distinct().join(used, "node").select("row", "table", "op", F.concat(F.lit(f"{label} ("), F.col("node"), F.lit(")")).alias("source")).distinct()


def sourced_matrix(usages: DataFrame) -> DataFrame:
    """(row, table, op, n_sources, sources): the sources of each operation of a row on a table, sorted."""
    return usages.groupBy("row", "table", "op").agg(F.count("*").alias("n_sources"), F.array_sort(F.collect_list("source")).alias("sources"))


def crud_compare(left: DataFrame, right: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """(row, table, op, status) of both sides' usages (row, table, op): both, lost (left only), exempt or added.

    exempt: (row, table, op) that the left side can't reach any more; a null row, table or op exempts any.
    """
    keys = ["row", "table", "op"]
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    met = a.join(b, keys, "full_outer").withColumn("status", F.when(F.col("_r").isNull(), "lost").when(F.col("_l").isNull(), "added").otherwise("both"))
    if exempt is None:
        return met.select(*keys, "status")
    rules = exempt.select(*keys).distinct()
    freed = met.where("status = 'lost'").select(*keys)
    for pattern in range(8):  # each set of columns that a rule leaves open is a join of its own
        given = [k for i, k in enumerate(keys) if not pattern >> i & 1]
        part = rules
        for k in keys:
            part = part.where(F.col(k).isNotNull() if k in given else F.col(k).isNull())
        hit = freed.join(part.select(*given).distinct(), given, "left_semi") if given else (freed if not part.isEmpty() else freed.limit(0))
        met = met.join(hit.select(*keys, F.lit(True).alias(f"_e{pattern}")), keys, "left")
    free = F.coalesce(*[F.col(f"_e{p}") for p in range(8)])
    return met.select(*keys, F.when(free, "exempt").otherwise(F.col("status")).alias("status"))


def call_paths(edges: DataFrame, start: DataFrame, most_hops: int = 1000) -> DataFrame:
    """(root, node, depth, parent): what each root reaches, by its canonical path: least depth, then the least caller.

    start: (root, node), the nodes that a root calls itself (depth 0, no parent); edges: (src, dst).  A node's caller is a
    minimum that is aggregated before it shuffles; no list of callers is carried, and nodes seen before drop out, so cycles
    end.  ``paths`` spells the paths out.
    """
    frontier = kept(start.select("root", "node").where("node IS NOT NULL").distinct().withColumns({"depth": F.lit(0), "parent": F.lit(None).cast(start.schema["node"].dataType)}))
    seen = frontier
    calls = edges.select("src", "dst").where("dst IS NOT NULL").distinct()
    for hop in range(1, most_hops + 1):
        step = frontier.select("root", "node").join(calls, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        new = step.alias("s").join(seen.alias("o"), F.col("s.root").eqNullSafe(F.col("o.root")) & (F.col("s.node") == F.col("o.node")), "left_anti")
        frontier = kept(new.select("root", "node", F.lit(hop).alias("depth"), "parent"))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
    raise ValueError(f"nodes are still found after {most_hops} hops")


def paths(reached: DataFrame) -> DataFrame:
    """``call_paths`` with ``path``, the callers between the root and each node, nearest to the root first."""
    nodes = kept(reached)
    done = now = nodes.where("depth = 0").select("root", "node", "depth", "parent", F.array().cast("array<string>").alias("path"))
    for depth in range(1, (nodes.agg(F.max("depth")).first()[0] or 0) + 1):
        above = now.select(F.col("root").alias("_root"), F.col("node").alias("_node"), F.col("path").alias("_path"))
        met = nodes.where(F.col("depth") == depth).join(above, F.col("root").eqNullSafe(F.col("_root")) & (F.col("parent") == F.col("_node")))
        now = kept(met.select("root", "node", "depth", "parent", F.concat("_path", F.array(F.col("parent").cast("string"))).alias("path")))
        done = done.union(now)
    return done


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
