"""Log analytics over event records: grouping, rollups, islands, masking, retention of whole traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions import text
from ledgerline.operators import ordered

EMAIL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def normalised(message: Column, width: int = 80) -> Column:
    """A message's group: digits become #, cut at ``width``."""
    return F.substring(F.regexp_replace(message, "[0-9]+", "#"), 1, width)


def group_errors(df: DataFrame, message: str, order: str) -> DataFrame:
    """Count, first and last order value and first message per normalised message."""
    return df.groupBy(normalised(F.col(message)).alias("pattern")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"), F.max(order).alias("last_seen"), F.min_by(message, order).alias("sample"))


def mask(column: Column) -> tuple[Column, Column]:
    """The text with e-mail addresses masked, and how many were."""
    return F.regexp_replace(column, EMAIL, "***"), F.regexp_count(column, F.lit(EMAIL)).cast("long")


def keep_traces(df: DataFrame, trace: str, hit: Column) -> DataFrame:
    """All records of traces of which any record is a hit: a semi-join with the pre-aggregated hit traces."""
    return df.join(df.where(hit).select(trace).distinct(), trace, "left_semi")


def islands(df: DataFrame, trace: str, order: str, label: str) -> DataFrame:
    """Runs of equal labels in a trace's order: label, length, first and last order value."""
    w = Window.partitionBy(trace).orderBy(order)
    edge = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    runs = df.withColumn("_edge", edge).withColumn("run", F.sum("_edge").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(trace, "run", label).agg(F.count("*").alias("n"), F.min(order).alias("first_at"), F.max(order).alias("last_at"))


def newest(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The ``n`` first rows of each group in the order given."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def error_report(df: DataFrame, level: str, logger: str, message: str, at: str, trace: str, order: str, least: str = "TRACE") -> DataFrame:
    """Errors grouped by level, logger and the key of their message: count, first and last time, traces, first record."""
    key = text.error_key(F.col(message))
    return at_least(df, level, least).groupBy(level, logger, key.alias("key")).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count_distinct(trace).alias("n_traces"), F.min(order).alias("sample_id"))


LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR")  #: fixed values, from light to grave


def at_least(df: DataFrame, level: str, least: str) -> DataFrame:
    """Records of a level or a graver one."""
    return df.where(F.col(level).isin(*LEVELS[LEVELS.index(least.upper()) :]))


#: fixed value, the format of a log line: ts [trace] [tenant] [user] [ip] [thread] LEVEL logger - message; any level of capitals
#: and any number of spaces are let in, so that a level of another name begins a record too
HEADER = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) \[([^\]]*)\] \[([^\]]*)\] \[([^\]]*)\] \[([^\]]*)\] \[([^\]]*)\] +([A-Z]+) +(\S+) +- ?(.*)$"


def records(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """Log records from numbered lines: a line without a header continues the record before it in its file.

    A running count of headers over ranges of lines numbers the records, so a file of any size is read by as many tasks as
    it has ranges; only the lines of one record meet.  Lines before a file's first header are left out; a null line continues
    a record as an empty one.
    """
    text_of = F.coalesce(F.col(line), F.lit("")).alias(line)
    rows = ordered.in_ranges(lines.select(file, number, text_of).withColumn("_head", F.rlike(F.col(line), F.lit(HEADER))), [file], [number])
    part = ordered.running(rows, [file], "record", F.when(F.col("_head"), 1).otherwise(0)).where("record > 0")
    folded = part.groupBy(file, "record").agg(F.max(F.when(F.col("_head"), F.col(line))).alias("first"), F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct(F.col(number).alias("n"), F.col(line).alias("l"))))).alias("rest"))
    return parsed(folded.withColumn("rest", F.transform("rest", lambda x: x["l"])), file)


def parsed(folded: DataFrame, file: str) -> DataFrame:
    """Columns of log records from their header line ``first`` and the lines ``rest`` that follow; ``-`` and ``SYSTEM`` mean none."""
    got = lambda i: F.nullif(F.nullif(F.regexp_extract("first", HEADER, i), F.lit("-")), F.lit("SYSTEM"))
    names = {2: "trace", 3: "tenant", 4: "user", 5: "ip", 6: "thread"}
    return folded.select(file, "record", F.regexp_extract("first", HEADER, 1).cast("timestamp_ntz").alias("ts"), *[got(i).alias(n) for i, n in names.items()], F.regexp_extract("first", HEADER, 7).alias("level"), F.regexp_extract("first", HEADER, 8).alias("logger"), F.regexp_extract("first", HEADER, 9).alias("message"), F.col("rest").alias("extra"))


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first of records alike in ``key``: pre-aggregated, whole rows only travel once."""
    best = df.groupBy(*key).agg(F.min(order).alias(order))
    return df.join(best, [*key, order], "left_semi")


def pair_statements(df: DataFrame, trace: str, order: str, kind: str) -> DataFrame:
    """Statement, parameters and result records of one call: each prepare opens a call, which the next one of its trace ends.

    Calls are numbered by a running count over ranges, so no trace is gathered in a task.
    """
    rows = ordered.in_ranges(df.select(trace, order, kind), [trace], [order])
    calls = ordered.running(rows, [trace], "call", F.when(F.col(kind) == "prepare", 1).otherwise(0)).where("call > 0")
    first = lambda k: F.min(F.when(F.col(kind) == k, F.col(order)))
    return calls.groupBy(trace, "call").agg(first("prepare").alias("prepared_at"), first("parameters").alias("parameters_at"), first("total").alias("total_at"), F.count("*").alias("n_records"))


def grep_context(df: DataFrame, key: str, column: str, needle: str, around: int) -> DataFrame:
    """(key, line_no, line, hit) of lines that hold ``needle`` and of ``around`` lines before and after, each once.

    Lines are marked in their array, so that only marked ones become rows.
    """
    lines = F.split(F.col(column), "\n")
    marked = df.where(F.col(column).contains(needle)).select(key, lines.alias("_lines"))
    marked = marked.withColumn("_hits", F.filter(F.transform("_lines", lambda x, i: F.when(x.contains(needle), i)), lambda i: i.isNotNull()))
    near = F.array_distinct(F.flatten(F.transform("_hits", lambda i: F.sequence(F.greatest(i - around, F.lit(0)), F.least(i + around, F.size("_lines") - 1)))))
    rows = marked.select(key, F.explode(F.transform(near, lambda i: F.struct((i + 1).cast("long").alias("line_no"), F.get("_lines", i).alias("line")))).alias("_l"))
    return rows.select(key, "_l.line_no", "_l.line", F.col("_l.line").contains(needle).alias("hit"))
