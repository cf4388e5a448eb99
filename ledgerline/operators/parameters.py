"""Values for the parameters of statements: given ones, the company's, those of a fitting row, constants of callers, rules by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.lineage import kept

SHAPES = 64  #: sets of condition columns that one pass over a table serves; more sets take more passes

COPIES = 64  #: of a found row, among which the statements that share its conditions are spread


def _text(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    return F.date_format(column, "yyyy-MM-dd") if kind == "date" or kind.startswith("timestamp") else F.col(column).cast("string")


def _sampled(asked: DataFrame, columns: list[str], rows: DataFrame, key: str, own: str | None, company: str | None) -> DataFrame | None:
    """(statement, name, column_name, value): per statement the columns of the first row, by ``key``, that agrees with what is known.

    ``asked`` (statement, name, column_name, known) holds the comparisons of one table, all with ``columns`` of it.  Rows are reduced
    to one per set of conditions before they meet statements, so a value that most rows hold costs no more than a rare one.
    """
    pair = lambda c: F.struct("column_name", F.col(c))
    sought = asked.groupBy("statement").agg(  # a statement's own
        F.array_sort(F.collect_set(F.when(F.col("known").isNotNull(), pair("known")))).alias("_c"),
        F.collect_set(F.when(F.col("known").isNull(), pair("name"))).alias("_open"),
    )
    sought = kept(sought.where("size(_open) > 0").select("statement", F.col("_c.column_name").alias("_shape"), F.col("_c.known").alias("_values"), "_open"))
    shapes = [r[0] for r in sought.select("_shape").distinct().collect()]  # sets of columns, not values
    shapes = [s for s in shapes if len(set(s)) == len(s)]  # one column can't equal two values
    if own is not None and company is not None:
        rows = rows.where(_text(rows, own) == company)
    found = sought.select("_shape", "_values", F.lit(True).alias("_asked")).distinct()
    for i in range(0, len(shapes), SHAPES):
        asked_of = F.array(*[F.struct(F.array(*map(F.lit, s)).cast("array<string>").alias("_shape"), F.array(*[_text(rows, c) for c in s]).cast("array<string>").alias("_values")) for s in shapes[i : i + SHAPES]])
        values = F.struct(*[_text(rows, c).alias(c) for c in columns])
        cells = rows.select(asked_of.alias("_all"), F.col(key).alias("_key"), values.alias("_row")).select(F.explode("_all").alias("_a"), "_key", "_row")
        fit = cells.where(~F.exists("_a._values", lambda v: v.isNull())).select("_a._shape", "_a._values", F.struct("_key", "_row").alias("_least"))
        found = found.unionByName(fit, allowMissingColumns=True)
    if not shapes:
        return None
    found = found.groupBy("_shape", "_values").agg(F.bool_or("_asked").alias("_asked"), F.min("_least").alias("_least")).where("_asked AND _least IS NOT NULL")
    # most statements may share one set of conditions: its one row is copied, and they meet the copies
    found = found.select("_shape", "_values", "_least", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("_copy"))
    met = sought.withColumn("_copy", F.pmod(F.hash("statement"), F.lit(COPIES))).join(found.hint("merge"), ["_shape", "_values", "_copy"])
    value = F.coalesce(*[F.when(F.col("column_name") == c, F.col(f"_row.{c}")) for c in columns])
    return met.select("statement", F.col("_least._row").alias("_row"), F.inline("_open")).select("statement", "name", "column_name", value.alias("value")).where("value IS NOT NULL")


def inferred(
    params: DataFrame,
    given: DataFrame,
    compared: DataFrame,
    samples: dict[str, tuple[DataFrame, str, str | None]],
    constants: DataFrame,
    rules: list[tuple[str, str]],
    company: str | None = None,
    company_names: tuple[str, ...] = ("companyid", "cid"),
) -> DataFrame:
    """(statement, name, value, source, origin) of ``params`` (statement, name), each once: the first source that has a value.

    - given: ``given`` (statement, name, value), the least value of several.
    - company: ``company``, for names in ``company_names``, whatever the case.
    - sample: ``compared`` (statement, name, table_name, column_name) says which columns parameters are compared with, ``samples``
      holds tables with the column of their order and that of their company, if they have one.  All of a statement's columns of one
      table come from one row: the first that is the company's and equals the parameters known by then.  Of several columns
      the first by table and name that has a value counts; tables don't wait for each other.  Tables and columns that
      aren't there count for nothing.
    - constant: ``constants`` (statement, key, value) of callers, if the key holds the name, or the name holds the key or the value,
      whatever the case; the first by key and value.  Empty keys and values fit no name.
    - rule: ``rules`` (pattern, value), the first whose pattern is found in the name, whatever the case.
    - none: the value is ``?``.

    ``origin`` is the column of a sample or the key of a constant.  Values are texts, dates as YYYY-MM-DD; null values are none.
    Rows without statement or name are left out.
    """
    key = ["statement", "name"]
    params = params.where("statement IS NOT NULL AND name IS NOT NULL").select(*key, F.lit(True).alias("asked"))
    none = F.lit(None).cast("string")
    is_company = F.lower("name").isin(*company_names) if company is not None else F.lit(False)
    # sides meet by grouping: Spark takes exploded rows for few, and a join would send them to the driver for a broadcast
    sides = params.unionByName(given.select(*key, F.col("value").alias("given")), allowMissingColumns=True)
    sides = sides.unionByName(compared.where("table_name IS NOT NULL AND column_name IS NOT NULL").select(*key, F.struct("table_name", "column_name").alias("place")), allowMissingColumns=True)
    first = sides.groupBy(*key).agg(F.bool_or("asked").alias("asked"), F.min("given").alias("given"), F.collect_set("place").alias("places")).where("asked")
    first = kept(first.select(*key, "given", F.when(F.col("given").isNull() & is_company, F.lit(company)).cast("string").alias("company"), "places"))

    asked = first.select(*key, F.coalesce("given", "company").alias("known"), F.inline("places"))
    places = asked.where(F.col("table_name").isin(*samples)).select("table_name", "column_name").distinct().collect() if samples else []  # names, as many as tables have at most
    sources = first.select(*key, "given", "company", F.lit(None).cast("struct<table_name:string,column_name:string,value:string>").alias("hit"), F.lit(None).cast("struct<key:string,value:string>").alias("c"))
    for table, (rows, order, column) in samples.items():
        columns = [c for c in rows.columns if (table, c) in {tuple(p) for p in places}]
        if columns:
            of_table = asked.where((F.col("table_name") == table) & F.col("column_name").isin(*columns))
            got = _sampled(of_table.select(*key, "column_name", "known"), columns, rows, order, column, company)
            if got is not None:
                sources = sources.unionByName(got.select(*key, F.struct(F.lit(table).alias("table_name"), "column_name", "value").alias("hit")), allowMissingColumns=True)

    low = lambda c: F.lower(F.col(c))
    fits = F.contains(low("key"), low("name")) | F.contains(low("name"), low("key")) | F.contains(low("name"), low("value"))
    of_callers = constants.where("key <> '' AND value <> ''").select("statement", "key", "value")
    chosen = first.select(*key).join(of_callers.hint("merge"), "statement").where(fits).select(*key, F.struct("key", "value").alias("c"))
    sources = sources.unionByName(chosen, allowMissingColumns=True)
    first = sources.groupBy(*key).agg(*[F.min(c).alias(c) for c in ("given", "company", "hit", "c")])
    first = first.withColumns({"sample": F.col("hit.value"), "column": F.concat_ws(".", "hit.table_name", "hit.column_name")})
    by_name = F.coalesce(*[F.when(F.rlike("name", F.lit(f"(?i){p}")), F.lit(v)) for p, v in rules], none)

    found = {"given": F.col("given"), "company": F.col("company"), "sample": F.col("sample"), "constant": F.col("c.value"), "rule": by_name}
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(s)) for s, v in found.items()], F.lit("none"))
    out = first.select(*key, F.coalesce(*found.values(), F.lit("?")).alias("value"), source.alias("source"), "column", F.col("c.key").alias("constant"))
    return out.select(*key, "value", "source", F.when(F.col("source") == "sample", F.col("column")).when(F.col("source") == "constant", F.col("constant")).alias("origin"))
