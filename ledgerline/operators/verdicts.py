"""Decision rules as column expressions, and the joins that feed them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: endings of names that mean the same
SYNONYMS = (("Name", "Nm"), ("Nm", "Name"), ("FullName", "FNm"), ("FNm", "FullName"), ("Code", "Cd"), ("Cd", "Code"), ("Address", "Addr"), ("Addr", "Address"))


def field_covered(expected: Column, fields: Column) -> Column:
    """True if the fields hold the expected name, one of its synonyms, or one of those without a prefix of 3 or 4 letters."""
    bare = F.regexp_replace(expected, "^[a-z]{3,4}", "")
    bare = F.when(bare != "", F.concat(F.lower(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 30))).otherwise(expected)
    names = [n for x in (expected, bare) for n in (x, *[F.regexp_replace(x, f"{a}$", b) for a, b in SYNONYMS])]
    return F.arrays_overlap(F.array(*names), fields)


def batch_verdict(expected: Column, actual: Column, failed: Column, missing: Column) -> Column:
    """An error or a missing column fails; two empty sides are skipped; equal counts are ok."""
    return F.when(failed | missing, "fail").when((expected == 0) & (actual == 0), "skip").when(expected == actual, "ok").otherwise("fail")


def row_match(paged: Column, has_total: Column, rows_equal: Column, total_equal: Column, scalar_equal: Column, total: Column, sql_rows: Column) -> Column:
    """Whether an answer matches its statement: a page with a total statement needs both, others one of a list of equalities."""
    plain = scalar_equal | rows_equal
    return F.when(paged & has_total, rows_equal & total_equal).when(paged, plain | (total == sql_rows)).otherwise(plain)


def drift_files(base: DataFrame, now: DataFrame, acknowledged: DataFrame, path: str, text: str, says: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, status) of each path of either side.

    A path that is gone has moved if its content stands elsewhere, else it was deleted; acknowledged changes are excluded;
    equal content is the same, and so is content that differs in line ends alone (eol), or, where ``says`` gives what a text
    says (``statements.normalised``), in form alone (format).
    """
    said = (lambda c: F.sha2(says(c), 256)) if says else (lambda c: F.lit(None).cast("string"))
    h = lambda d, n: d.select(path, F.sha2(F.col(text), 256).alias(n), F.sha2(F.regexp_replace(text, "\r\n", "\n"), 256).alias(f"{n}_eol"), said(F.col(text)).alias(f"{n}_said"))
    elsewhere = h(now, "hash").select(F.col("hash").alias("old"), F.lit(True).alias("elsewhere")).distinct()
    met = h(base, "old").join(h(now, "new"), path, "full_outer").join(elsewhere, "old", "left").join(acknowledged.select(path, F.lit(True).alias("known")).distinct(), path, "left")
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), F.when(F.col("elsewhere"), "moved").otherwise("deleted"))
        .when(F.col("known"), "excluded")
        .when(F.col("old") == F.col("new"), "same")
        .when(F.col("old_eol") == F.col("new_eol"), "eol")
        .when(F.col("old_said") == F.col("new_said"), "format")
        .otherwise("changed")
    )
    return met.select(path, status.alias("status"))


def drift_screen(deleted: Column, changed: Column, moved: Column) -> Column:
    """A screen's status from counts of its files': changes first, then deletions, then moves."""
    return F.when(changed > 0, "changed").when(deleted > 0, "deleted").when(moved > 0, "moved").otherwise("same")


SEVERITY = ("OK", "MOVED", "STALE", "MISSING")  #: fixed values, from light to grave


def evidence_status(lines: Column, line: Column, excerpt: Column) -> Column:
    """OK if the excerpt stands at its line, MOVED if elsewhere, MISSING if the line lies beyond the end, else STALE."""
    return F.when(F.get(lines, line - 1) == excerpt, "OK").when(F.array_contains(lines, excerpt), "MOVED").when(line > F.size(lines), "MISSING").otherwise("STALE")


def worst(status: Column) -> Column:
    """Aggregate: the gravest of some evidence's statuses."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), status)
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.max(rank).cast("int"))


def access_verdict(code: Column, own: Column, common: Column, rows: Column, menus: Column, granted: Column) -> Column:
    """What a read request's answer says of its authorization."""
    refused = F.when(code == 403, "blocked").when(code == 404, "undecidable").otherwise("error")
    some = F.size(menus) > 0
    allowed = F.when(own, "own").when(common, "common").when(rows == 0, "undecidable").when(some & ~F.arrays_overlap(menus, granted), "warning").when(some, "ok").otherwise("unknown")
    return F.when(code >= 400, refused).otherwise(allowed)


#: fixed values: error conditions of Spark by what they mean for a statement
ERROR_CLASSES = {"missing": ("TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_COLUMN", "UNRESOLVED_ROUTINE"), "type": ("DATATYPE_MISMATCH", "CAST_INVALID_INPUT"), "syntax": ("PARSE_SYNTAX_ERROR",)}


def error_class(condition: Column) -> Column:
    """missing, type, syntax or other, in this order."""
    out = F
    for name, starts in ERROR_CLASSES.items():
        hit = F.lit(False)
        for s in starts:
            hit = hit | condition.startswith(s)
        out = out.when(hit, name)
    return out.otherwise("other")


def resolve(targets: DataFrame, names: DataFrame, target: str, number: str, name: str) -> DataFrame:
    """(target, verdict, name): by number, by name whatever its case, by a prefix that only one name has.

    Prefixes of names are listed (a name of n letters has n), so that the prefix search is an equi-join.
    """
    key = F.lower(F.trim(target))
    asked = targets.select(target).distinct().withColumn("_key", key)
    low = names.select(F.col(number).cast("string").alias("_no"), F.col(name).alias("_name"), F.lower(name).alias("_low"))
    by_no = low.select(F.concat(F.lit("#"), "_no").alias("_key"), F.col("_name").alias("by_number"))
    exact = low.groupBy(F.col("_low").alias("_key")).agg(F.count("*").alias("n_exact"), F.min("_name").alias("exact"))
    prefix = low.select("_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("_low")), lambda i: F.substring(F.col("_low"), F.lit(1), i))).alias("_key")).groupBy("_key").agg(F.count("*").alias("n_prefix"), F.min("_name").alias("prefix"))
    met = asked.join(by_no, "_key", "left").join(exact, "_key", "left").join(prefix, "_key", "left")
    verdict = F.when(F.col("by_number").isNotNull(), "number").when(F.col("n_exact") == 1, "exact").when(F.col("n_exact").isNull() & (F.col("n_prefix") == 1), "prefix").when(F.coalesce("n_exact", "n_prefix") > 1, "ambiguous").otherwise("not found")
    found = F.when(verdict == "number", F.col("by_number")).when(verdict == "exact", F.col("exact")).when(verdict == "prefix", F.col("prefix"))
    return met.select(target, verdict.alias("verdict"), found.alias("name"))


def file_kind(path: Column) -> Column:
    """DB, SQL, MODEL, UI, LOGIC or ETC, by extension and folders; the first rule that holds."""
    low = F.lower(path)
    parts = F.split(low, "/")
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    java = F.when(F.array_contains(parts, "model") | F.rlike(stem, F.lit("(Model|Properties)$")), "MODEL").when(F.array_contains(parts, "client"), "UI").otherwise("LOGIC")
    return F.when(low.endswith(".sql") | F.arrays_overlap(parts, F.array(F.lit("dbsource"), F.lit("db_source"))), "DB").when(low.endswith(".xml") | F.array_contains(parts, "mapper"), "SQL").when(low.endswith(".java"), java).otherwise("ETC")


def usage_kind(line: Column, suffix: Column) -> Column:
    """How a line uses a code: literal of a statement, choice list, comparison, other."""
    return F.when(suffix == ".xml", "literal").when(F.rlike(line, F.lit(r"Combo|combo|Select\b|options")), "choices").when(F.rlike(line, F.lit("==|!=|equals")), "comparison").otherwise("other")


def path_pattern(query: str) -> str:
    """Pieces of a menu path, in order, each in a later step than the one before, as a regular expression over lower-case paths."""
    quoted = ["".join(c if c.isalnum() or c == " " else "\\" + c for c in p.strip().lower()) for p in query.split(">") if p.strip()]
    return "^(?:[^>]*>)*?[^>]*" + "[^>]*>(?:[^>]*>)*?[^>]*".join(quoted)


def deltas(left: Column, right: Column) -> tuple[Column, Column]:
    """Sorted items that only the left array has, and those that only the right one has."""
    return F.array_sort(F.array_except(left, right)), F.array_sort(F.array_except(right, left))
