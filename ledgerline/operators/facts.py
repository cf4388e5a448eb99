"""Facts of screens, tables, tests and requests: filters with arguments, pairs by priority, labels, overrides and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions import text

MOST_NAMED = 3


# -- filters


def matches(conditions: dict[str, str | None]) -> Column:
    """``name=value`` conditions, compared as text; None asks for a null."""
    out = F.lit(True)
    for name, value in conditions.items():
        out = out & (F.col(name).isNull() if value is None else F.coalesce(F.col(name).cast("string") == value, F.lit(False)))
    return out


def coerced(df: DataFrame, column: str, new: Column) -> Column:
    """A text as a value of the column's own type; one that can't be read as such leaves the old value; ``null`` clears it."""
    kind = df.schema[column].dataType.simpleString()
    value = F.when(F.lower(F.trim(new)).isin("true", "1", "y", "yes"), True).when(F.lower(F.trim(new)).isin("false", "0", "n", "no"), False) if kind == "boolean" else new.try_cast(kind)
    return F.when(F.lower(F.trim(new)) == "null", F.lit(None).cast(kind)).otherwise(F.coalesce(value, F.col(column)))


def not_ignored(logger: Column, ignored: list[str]) -> Column:
    """True unless a logger's name holds one of some texts."""
    return ~reduce(lambda a, b: a | b, [F.contains(F.coalesce(logger, F.lit("")), F.lit(i)) for i in ignored], F.lit(False))


def accessed(method: Column, path: Column, want_method: str | None = None, want_path: str | None = None, context: str = "") -> Column:
    """Requests of a method, whatever its case, whose path holds a text once the context (a pattern at its start) is cut off."""
    out = F.lit(True)
    if want_method:
        out = out & (F.upper(method) == want_method.upper())
    if want_path:
        out = out & F.contains(F.regexp_replace(path, f"^(?:{context})", "") if context else path, F.lit(want_path))
    return out


def columns_where(df: DataFrame, label: str, kind: str, kinds: tuple[str, ...] = (), holds: str | None = None, pattern: str | None = None, length: int | None = None) -> DataFrame:
    """Columns of some types whose label holds a text or matches a pattern, whatever the case, or has a length."""
    out = df
    if kinds:
        out = out.where(F.lower(kind).isin(*[k.lower() for k in kinds]))
    if holds is not None:
        out = out.where(F.contains(F.lower(label), F.lit(holds.lower())))
    if pattern is not None:
        out = out.where(F.rlike(label, F.lit(f"(?i){pattern}")))
    return out if length is None else out.where(F.length(F.trim(label)) == length)


def of_domain(code: Column, domain: str) -> Column:
    """Whether a code is a domain's own or begins with it."""
    return (F.lower(code) == domain.lower()) | F.startswith(F.lower(code), F.lit(domain.lower()))


def candidate_tables(df: DataFrame, name: str, prefixes: list[str], excluded: str = "$^") -> DataFrame:
    """Tables that don't match a pattern, with ``priority``: the place of the first prefix they begin with, else their number."""
    bare = F.lower(F.element_at(F.split(F.col(name), r"\."), -1))
    rank = F.lit(len(prefixes))
    for i, p in reversed(list(enumerate(prefixes))):
        rank = F.when(F.startswith(bare, F.lit(p.lower())), i).otherwise(rank)
    return df.where(~F.rlike(bare, F.lit(f"(?i){excluded}"))).withColumn("priority", rank)


# -- pairs


def first_tier(left: DataFrame, key: str, tiers: list[tuple[DataFrame, bool]]) -> DataFrame:
    """(key, tier, match): the match of the first tier, from 1, that knows the key; without any, both are null.

    Tiers are (key, match); of several matches the least is taken, or, in a tier marked so, only one that is alone.
    """
    found = []
    for i, (tier, alone) in enumerate(tiers, 1):
        best = tier.where(F.col(key).isNotNull() & F.col("match").isNotNull()).distinct().groupBy(key).agg(F.min("match").alias("match"), F.count("*").alias("n"))
        found.append((best.where("n = 1") if alone else best).select(key, F.lit(i).alias("tier"), "match"))
    first = reduce(DataFrame.unionByName, found).groupBy(key).agg(F.min_by(F.struct("tier", "match"), "tier").alias("f"))
    return left.select(key).join(first, key, "left").select(key, "f.tier", "f.match")


def best_scored(candidates: DataFrame, key: str, score: str) -> DataFrame:
    """(key, verdict, n_top, score): certain if one candidate alone has the largest score, else ambiguous; ties are counted before they meet."""
    by = candidates.groupBy(key, score).agg(F.count("*").alias("n"))
    top = by.groupBy(key).agg(F.max(F.struct(score, "n")).alias("t"))
    return top.select(key, F.when(F.col("t.n") == 1, "certain").otherwise("ambiguous").alias("verdict"), F.col("t.n").alias("n_top"), F.col(f"t.{score}").alias(score))


def overridden(base: DataFrame, own: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, overridden): a key's own value (own: one row a key) before the common one."""
    met = base.select(key, F.col(value).alias("_common")).join(own.select(key, F.col(value).alias("_own"), F.lit(True).alias("_is")), key, "left")
    return met.select(key, F.when(F.col("_is"), F.col("_own")).otherwise(F.col("_common")).alias(value), F.coalesce("_is", F.lit(False)).alias("overridden"))


def grounded(cited: DataFrame, known: DataFrame, ref: str) -> DataFrame:
    """``cited`` with ``grounded``: whether its reference is known; a null one is not."""
    have = known.select(F.col(known.columns[0]).alias("_known")).distinct()
    return cited.join(have, F.col(ref) == F.col("_known"), "left").select(*[cited[c] for c in cited.columns], F.col("_known").isNotNull().alias("grounded"))


def authorised(calls: DataFrame, url_menus: DataFrame, granted: DataFrame, url: str, menu: str) -> DataFrame:
    """(url, n, verdict) of calls: open if no menu leads to the url, granted if one of them is granted, else refused."""
    mine = granted.select(menu).distinct().withColumn("_mine", F.lit(1))
    menus = url_menus.select(url, menu).distinct().join(mine, menu, "left").groupBy(url).agg(F.max("_mine").alias("_mine"), F.lit(1).alias("_some"))
    met = calls.groupBy(url).agg(F.count("*").alias("n")).join(menus, url, "left")
    return met.select(url, "n", F.when(F.col("_some").isNull(), "open").when(F.col("_mine") == 1, "granted").otherwise("refused").alias("verdict"))


def compared_labels(left: DataFrame, right: DataFrame, screen: str, label: str, name: str) -> DataFrame:
    """(screen, label, left_name, right_name, status) of both sides' fields by trimmed label: same, renamed, left or right.

    Of several fields with one label the least name stands for them; blank labels are left out.
    """
    side = lambda df, to: df.select(screen, F.trim(label).alias(label), F.col(name).alias("_n")).where(f"{label} <> ''").groupBy(screen, label).agg(F.min("_n").alias(to))
    met = side(left, "left_name").withColumn("_l", F.lit(1)).join(side(right, "right_name").withColumn("_r", F.lit(1)), [screen, label], "full_outer")
    status = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").when(F.col("left_name").eqNullSafe(F.col("right_name")), "same").otherwise("renamed")
    return met.select(screen, label, "left_name", "right_name", status.alias("status"))


def labelled_columns(labels: DataFrame, columns: DataFrame, field: str, label: str, table: str, column: str, most: int = MOST_NAMED) -> DataFrame:
    """(label, field, n_columns, columns): the columns whose property a labelled field bears, the first few named ``table.column``."""
    fields = labels.select(F.col(label).alias("_label"), F.col(field).alias("_field")).where("_label IS NOT NULL AND _field IS NOT NULL").distinct()
    known = columns.select(text.property_name(F.col(column)).alias("_field"), F.concat(F.col(table), F.lit("."), F.col(column)).alias("_c")).distinct()
    w = Window.partitionBy("_field").orderBy("_c")
    named = known.withColumn("_r", F.row_number().over(w)).groupBy("_field").agg(F.count("*").alias("n_columns"), F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.col("_c")))).alias("columns"))
    return fields.join(named, "_field", "left").select(F.col("_label").alias(label), F.col("_field").alias(field), F.coalesce("n_columns", F.lit(0)).alias("n_columns"), F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))


def shared_files(uses: DataFrame, file: str, screen: str, linked: DataFrame | None = None, common: str = "$^") -> DataFrame:
    """(file, n_screens, shared): shared if several screens use it, it is linked, or its path matches a pattern of common places."""
    n = uses.groupBy(file).agg(F.count_distinct(screen).alias("n_screens"))
    n = n.join(linked.select(file).distinct().withColumn("_linked", F.lit(True)), file, "left") if linked is not None else n.withColumn("_linked", F.lit(None).cast("boolean"))
    return n.select(file, "n_screens", ((F.col("n_screens") > 1) | F.coalesce("_linked", F.lit(False)) | F.rlike(file, F.lit(common))).alias("shared"))


def child_tables(keys: DataFrame, parent: str) -> DataFrame:
    """(child, child_column) of foreign keys (child, child_column, parent, ...) that refer to a table, whatever the case."""
    return keys.where(F.lower("parent") == parent.lower()).select("child", "child_column").distinct()


# -- totals


def request_summary(df: DataFrame, level: str, trace: str, is_statement: Column, since: Column | None = None) -> DataFrame:
    """(n_requests, n_sql, n_warn, n_error, n_traces), one row, of the records that ``since`` lets through."""
    rows = df if since is None else df.where(since)
    of = lambda x: F.count_if(F.col(level) == x)
    return rows.agg(F.count("*").alias("n_requests"), F.count_if(is_statement).alias("n_sql"), of("WARN").alias("n_warn"), of("ERROR").alias("n_error"), F.count_distinct(trace).alias("n_traces"))


def domain_counts(domains: DataFrame, facts: dict[str, DataFrame], domain: str, part: str | None = None, whole: tuple[str, ...] = ()) -> DataFrame:
    """(domain, a count per fact, percent): rows of each fact by domain; percent of ``part`` in ``whole``, cut to whole numbers, null without any."""
    out = domains.select(domain).distinct()
    for name, rows in facts.items():
        out = out.join(rows.groupBy(domain).agg(F.count("*").alias(name)), domain, "left").fillna(0, [name])
    if part is None:
        return out
    total = reduce(lambda a, b: a + b, [F.col(w) for w in whole])
    return out.withColumn("percent", F.when(total > 0, F.floor(F.col(part) * 100 / total).cast("long")))


def mode_label(df: DataFrame, by: str, label: str, order: str) -> DataFrame:
    """(by, label): the most frequent label of each group, of equal ones the first seen; null labels don't count."""
    n = df.where(F.col(label).isNotNull()).groupBy(by, label).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    n = n.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "_first", label)))
    return n.where("_rank = 1").select(by, F.col(label).alias("label"))


def popularity(df: DataFrame, names: Column, known: DataFrame | None = None, name: str = "name") -> DataFrame:
    """(name, n_statements): in how many rows each name stands, once a row; with ``known``, those names alone."""
    rows = df.select(F.explode(F.array_distinct(names)).alias(name))
    rows = rows if known is None else rows.join(known.select(F.col(known.columns[0]).alias(name)).distinct(), name, "left_semi")
    return rows.groupBy(name).agg(F.count("*").alias("n_statements"))


def top(df: DataFrame, by: str, most: int) -> DataFrame:
    """(by, n): the values with the most rows, of equal ones the least value."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(most)


def menu_rollup(paths: DataFrame, path: str, flags: dict[str, Column], sep: str = " > ") -> DataFrame:
    """(top_menu, n_menus, a count per flag) by the first step of a path."""
    return paths.groupBy(F.element_at(F.split(path, sep), 1).alias("top_menu")).agg(F.count("*").alias("n_menus"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def totals(suites: DataFrame, sums: dict[str, str], n: str = "n_suites", digits: int = 2) -> DataFrame:
    """One row: how many suites, and the sum of each column under a new name; without suites sums are 0."""
    kinds = dict(suites.dtypes)
    add = lambda c: F.round(F.sum(c), digits) if kinds[c] in ("double", "float") else F.sum(c)
    return suites.agg(F.count("*").alias(n), *[F.coalesce(add(c), F.lit(0)).alias(to) for c, to in sums.items()])


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """One row a key from sources with equal columns: that of the first source that has it; of its rows there the least."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("_from", F.lit(i)) for i, s in enumerate(sources)])
    rest = [c for c in sources[0].columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct("_from", *rest)).alias("m")).select(key, *[f"m.{c}" for c in rest])


def next_id(used: DataFrame, column: str, prefix: str = "R-", digits: int = 3) -> DataFrame:
    """One row, ``next_id``: the number after the largest behind the prefix; others don't count, and without any it is 1."""
    number = F.regexp_extract(column, f"^{prefix}([0-9]+)$", 1).try_cast("long")
    n = F.coalesce(F.max(number), F.lit(0)) + 1
    return used.agg(F.concat(F.lit(prefix), F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(digits)), F.lit("0"))).alias("next_id"))


def run_summary(code: Column, seconds: Column, command: Column) -> Column:
    """What a run came to, in a line."""
    return F.when(code == 0, F.concat(F.lit("done in "), F.round(seconds).cast("long"), F.lit(" s"))).otherwise(F.concat(F.lit("exit "), code, F.lit(": "), command))
