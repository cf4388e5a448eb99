"""Slices of a catalog within a budget, and what has changed between two states of a catalog with the statements it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions import text
from ledgerline.operators import ranking
from ledgerline.sources import files

MOST_NAMED = 8


def sliced(columns: DataFrame, keys: DataFrame, patterns: list[str], budget: int, enums: DataFrame | None = None) -> DataFrame:
    """(pattern, name, status, size, block): the tables that globs ask for, in the globs' order, as far as ``budget`` characters go.

    ``columns`` is a catalog's (table_name, position, column_name, type), ``keys`` its (child, child_column, parent, key_column).
    A table belongs to the first glob that it matches, whatever the case, and comes after those of earlier globs, then by name.
    Status: included; omitted if it does not fit into what is left (later, smaller ones may); missing for a glob without any
    table (no name); enum for those of ``enums`` (enum_name, values) that are the type of an included column, not counted in the
    budget.  A block is DBML with the references that leave the table, as comments where they lead out of the slice; sizes count
    them as comments.  Without patterns, or on an empty catalog, no table is included.
    """
    spark = columns.sparkSession
    asked = spark.createDataFrame(list(enumerate(patterns)), "place int, pattern string")
    hits = F.array_compact(F.array(*[F.when(F.rlike("table_name", F.lit(text.glob_pattern(p))), F.lit(i)) for i, p in enumerate(patterns)], F.lit(None).cast("int")))
    bodies = files.dbml(columns, keys.limit(0)).withColumn("places", hits).where("size(places) > 0")
    line = F.concat(F.lit("Ref: "), "child", F.lit("."), "child_column", F.lit(" > "), "parent", F.lit("."), "key_column")
    refs = keys.select(F.col("child").alias("table_name"), "parent", line.alias("line")).distinct()
    longest = refs.groupBy("table_name").agg(F.sum(F.length("line") + 4).alias("extra"))  # a line end and a comment's mark
    sized = bodies.join(longest, "table_name", "left").select("table_name", "places", F.get("places", F.lit(0)).alias("place"), "block", (F.length("block") + F.coalesce("extra", F.lit(0))).cast("long").alias("size"))
    sized = sized.withColumn("at", F.concat(F.lpad(F.col("place").cast("string"), 6, "0"), F.lit(" "), "table_name")).withColumn("all", F.lit(0))
    taken = ranking.budgeted(sized.select("all", "at", "size"), "all", "at", "size", budget).select("at", F.lit(True).alias("fits"))
    tables = sized.join(taken, "at", "left").select("table_name", "place", "size", "block", F.col("fits").isNotNull().alias("fits"))
    within = tables.where("fits").select(F.col("table_name").alias("parent"), F.lit(True).alias("inside"))
    marked = refs.join(within, "parent", "left").select("table_name", F.concat(F.when(F.col("inside").isNull(), "// ").otherwise(""), "line").alias("line"))
    tails = marked.groupBy("table_name").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("tail"))  # a table's own references
    shown = tables.join(tails, "table_name", "left").join(asked, "place")
    out = shown.select("pattern", F.col("table_name").alias("name"), F.when(F.col("fits"), "included").otherwise("omitted").alias("status"), "size", F.when(F.col("fits"), F.concat_ws("\n", "block", "tail")).alias("block"))
    none = F.lit(None).cast("string")
    lost = asked.join(bodies.select(F.explode("places").alias("place")).distinct(), "place", "left_anti")
    out = out.union(lost.select("pattern", none, F.lit("missing"), F.lit(None).cast("long"), none))
    if enums is not None:
        used = columns.join(tables.where("fits").select("table_name"), "table_name", "left_semi").select(F.col("type").alias("enum_name")).distinct()
        block = F.concat(F.lit("Enum "), "enum_name", F.lit(" {\n  "), F.array_join("values", "\n  "), F.lit("\n}"))
        out = out.union(enums.join(used, "enum_name", "left_semi").select(none, "enum_name", F.lit("enum"), F.length(block).cast("long"), block))
    return out


def drifted(before: DataFrame, after: DataFrame, uses: DataFrame) -> DataFrame:
    """(kind, table_name, name, before, after, status, n_statements, statements) of what differs between two states of a catalog.

    Both states are rows (kind, table_name, name, definition) of any kinds: columns, keys, indexes, constraints, routines (those
    have no table).  A table that only one state knows is one row of kind ``table``, added or removed, and its parts are not
    listed; else a part is added, removed or changed.  Several definitions of one part count as one, in order, a null one as
    empty.  ``uses`` (statement, table_name) tells which statements a change reaches, names compared whatever the case:
    how many, and the first few.  Equal states, empty ones included, give no rows.
    """
    part = ["kind", "table_name", "name"]

    def state(df: DataFrame, label: str) -> DataFrame:
        body = F.array_join(F.array_sort(F.collect_set(F.coalesce("definition", F.lit("")))), "\n")
        return df.groupBy(*part).agg(body.alias(label))

    def tables(df: DataFrame) -> DataFrame:
        return df.where("table_name IS NOT NULL").select(F.lit("table").alias("kind"), "table_name", F.col("table_name").alias("name")).distinct()

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.withColumn("_a", F.lit(True)).alias("a"), b.withColumn("_b", F.lit(True)).alias("b")
        same = F.lit(True)
        for c in part:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
        return a.join(b, same, "full_outer").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in part], "before", "after", status.alias("status")).where("status IS NOT NULL")

    whole = met(tables(before).withColumn("before", F.lit("")), tables(after).withColumn("after", F.lit("")))
    one_sided = whole.select("table_name")
    parts = met(state(before, "before"), state(after, "after")).join(one_sided, "table_name", "left_anti")
    changes = whole.withColumn("before", F.lit(None).cast("string")).withColumn("after", F.lit(None).cast("string")).unionByName(parts)
    reached = uses.where("statement IS NOT NULL").select("statement", F.lower("table_name").alias("_table")).distinct()
    counts = reached.groupBy("_table").agg(F.count("*").alias("n_statements"))
    first = reached.withColumn("_rank", F.row_number().over(Window.partitionBy("_table").orderBy("statement"))).where(F.col("_rank") <= MOST_NAMED)
    named = first.groupBy("_table").agg(F.array_join(F.array_sort(F.collect_list("statement")), ", ").alias("statements"))  # the first few alone
    impact = counts.join(named, "_table")
    found = changes.join(impact, F.lower("table_name") == F.col("_table"), "left")
    return found.select(*part, "before", "after", "status", F.coalesce("n_statements", F.lit(0)).alias("n_statements"), F.coalesce("statements", F.lit("")).alias("statements"))
