"""Names found in texts, abbreviated names recovered, questions matched by ordered rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators.lineage import kept

PARTS = 1000
WORD = r"(?U)\w+"


def split_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``table``, one row per key, where one key may hold a third of ``rows``.

    Keys with over 1/``PARTS`` of the rows, fewer than ``PARTS`` of them, meet their row by broadcast; the rest shuffles.
    """
    count = rows.groupBy(key).agg(F.count("*").alias("_c")).where(F.col(key).isNotNull())
    hot = kept(count.where(F.col("_c") * PARTS > rows.count()).select(key))
    found = kept(table.join(F.broadcast(hot), key))
    return rows.join(F.broadcast(found), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


def used_names(bodies: DataFrame, names: DataFrame, body: str, text: str, name: str, called: bool = False) -> DataFrame:
    """(body, name), each once: names that stand as whole words, whatever their case, in a body's text.

    ``called``: only where an opening parenthesis follows.  Bodies become their distinct words once, and names meet their first
    word by an equi-join; names of several words (``a.b``) are then looked for in the texts of those candidates.
    A body that bears the name itself counts too; null names and texts are left out.
    """
    low = F.lower(F.col(text))
    words = F.transform(F.regexp_extract_all(low, F.lit(r"(?U)(\w+)(?=\s*\()" if called else r"(?U)(\w+)"), F.lit(1)), lambda w: w)
    tokens = bodies.where(F.col(text).isNotNull()).select(F.col(body).alias("_body"), F.explode(F.array_distinct(words)).alias("_word"))
    asked = names.select(F.col(name).alias("_name"), F.lower(F.col(name)).alias("_low")).where("_name IS NOT NULL").distinct()
    found = F.regexp_extract_all("_low", F.lit(WORD), F.lit(0))
    asked = asked.withColumn("_word", F.element_at(found, -1) if called else F.get(found, F.lit(0))).withColumn("_single", F.rlike("_low", F.lit(r"(?U)^\w+$"))).where("_word IS NOT NULL")
    by_word = asked.groupBy("_word").agg(F.collect_list(F.struct("_name", "_low", "_single")).alias("_names"))  # names that share a word, not hits
    met = split_join(tokens, by_word, "_word").select("_body", F.explode("_names").alias("_n")).select("_body", "_n.*")
    sure = met.where("_single").select("_body", "_name")
    more = kept(met.where("NOT _single"))
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("_low"), F.lit(r"\E(?!\w)" + (r"\s*\(" if called else "")))
    texts = bodies.select(F.col(body).alias("_body"), low.alias("_text"))
    more = more.join(texts, "_body").where(F.call_function("rlike", F.col("_text"), quoted)).select("_body", "_name")
    return sure.union(more).distinct().select(F.col("_body").alias(body), F.col("_name").alias(name))


def _initials_fit(short: Column, full: Column) -> Column:
    """Whether each segment of an abbreviated package begins the full one's in the same place; without a package any fits."""
    return (F.size(full) == 0) | (F.size(short) == 0) | ((F.size(short) == F.size(full)) & F.forall(F.zip_with(short, full, lambda a, b: F.coalesce(F.startswith(b, a), F.lit(False))), lambda x: x))


def recover(calls: DataFrame, known: DataFrame, logger: str, path: str, cls: str, statement: str) -> DataFrame:
    """(logger, path, name, n_fit) of the distinct calls: the full name of an abbreviated logger, or the logger itself.

    ``a.b.F.sel`` fits classes whose name begins with F and that have a statement ``sel``; where both give a package, its
    segments must begin alike.  Of several, the one whose name holds most letters of the request's path words wins, if
    it is alone; n_fit says how many fit.  Calls are made distinct first, and meet classes by statement and first letter.
    """
    asked = kept(calls.select(F.col(logger).alias("_logger"), F.col(path).alias("_path")).where("_logger IS NOT NULL").distinct())
    parts = F.split("_logger", r"\.")
    split = asked.where(F.size(parts) >= 2).withColumn("_id", F.element_at(parts, -1)).withColumn("_cls", F.element_at(parts, -2)).withColumn("_package", F.slice(parts, F.lit(1), F.size(parts) - 2)).withColumn("_first", F.substring("_cls", 1, 1))
    full = F.split(F.col(cls), r"\.")
    classes = known.where(F.col(cls).isNotNull()).select(F.element_at(full, -1).alias("_full"), F.slice(full, F.lit(1), F.size(full) - 1).alias("_in"), F.col(statement).alias("_id")).distinct().withColumn("_first", F.substring("_full", 1, 1))
    met = split.join(classes, ["_id", "_first"]).where(F.startswith(F.col("_full"), F.col("_cls")) & _initials_fit(F.col("_package"), F.col("_in")))
    words = F.filter(F.split(F.lower(F.coalesce("_path", F.lit(""))), r"[/_\-.]"), lambda w: (w != "") & ~w.isin("api", "v1", "v2"))
    score = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.when(F.contains(F.lower(F.col("_full")), w), F.length(w)).otherwise(0))
    best = met.withColumn("_score", score).groupBy("_logger", "_path", "_full", "_id").agg(F.max("_score").alias("_score"))
    fits = best.groupBy("_logger", "_path").agg(F.count("*").alias("n_fit"), F.max("_score").alias("_top"), F.max_by("_full", "_score").alias("_one"), F.first("_id").alias("_id"))
    tops = best.groupBy("_logger", "_path", "_score").agg(F.count("*").alias("_n"))
    tops = tops.groupBy("_logger", "_path").agg(F.max_by("_n", "_score").alias("_n_top"))
    same = lambda a, b: F.col(f"{a}._logger").eqNullSafe(F.col(f"{b}._logger")) & F.col(f"{a}._path").eqNullSafe(F.col(f"{b}._path"))
    out = asked.alias("a").join(fits.alias("f"), same("a", "f"), "left").join(tops.alias("t"), same("a", "t"), "left")
    sure = (F.col("n_fit") == 1) | ((F.col("_top") > 0) & (F.col("_n_top") == 1))
    return out.select(F.col("a._logger").alias(logger), F.col("a._path").alias(path), F.when(sure, F.concat_ws(".", "_one", "_id")).otherwise(F.col("a._logger")).alias("name"), F.coalesce("n_fit", F.lit(0)).alias("n_fit"))


Rule = Callable[[DataFrame], DataFrame]


def ordered_match(queries: DataFrame, rules: list[Rule], query: str, most: int) -> DataFrame:
    """(query, place, card, rule): up to ``most`` cards of each query, found by rules that run in turn.

    A rule takes the queries that aren't filled yet and gives (query, card, rank), its cards in order of rank, then of
    name; a card counts once, by the first rule that finds it.  Filled queries are not asked again, so a later and
    broader rule works on what is left alone.
    """
    left = queries.where(F.col(query).isNotNull()).dropDuplicates([query]).withColumn("_filled", F.lit(0))
    found = None
    for number, rule in enumerate(rules, 1):
        left = kept(left.where(F.col("_filled") < most))
        got = rule(left.drop("_filled")).groupBy(query, "card").agg(F.min("rank").alias("rank"))
        if found is not None:
            got = got.join(found.select(query, "card"), [query, "card"], "left_anti")
        w = Window.partitionBy(query).orderBy("rank", "card")
        new = got.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).join(left.select(query, "_filled"), query)
        new = kept(new.withColumn("place", F.col("_filled") + F.col("_n")).where(F.col("place") <= most).select(query, "place", "card", F.lit(number).alias("rule")))
        found = new if found is None else found.unionByName(new)
        filled = new.groupBy(query).agg(F.count("*").cast("int").alias("_new"))
        left = left.join(filled, query, "left").withColumn("_filled", F.col("_filled") + F.coalesce("_new", F.lit(0))).drop("_new")
    return found
