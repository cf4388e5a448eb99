"""Readers of logs, snapshots, tables of text and test reports, and lines for the same formats."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import logs


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line) of text or gzip logs; numbers rise along each file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("number"), F.col("value").alias("line"))
    return lines


def archive_glob(root: str, app: str, first: date, last: date, kinds: tuple[str, ...] = ("info", "error")) -> str:
    """The path of an application's archived logs of some days, ends included, so that no other day's files are listed or read."""
    days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
    months = dict.fromkeys(f"{d:%Y-%m}" for d in days)
    some = lambda values: "{" + ",".join(values) + "}"
    return f"{root}/archived/{some(months)}/{app}-{some(kinds)}-{some(f'{d:%Y-%m-%d}' for d in days)}.*.log.gz"  # fixed value: where logs are archived


def archived_lines(spark: SparkSession, root: str, app: str, first: date, last: date, kinds: tuple[str, ...] = ("info", "error")) -> DataFrame:
    """(file, number, line) of archived logs of some days, ends included; no rows if the days have no files or end before they begin."""
    try:
        if first <= last:
            return log_lines(spark, archive_glob(root, app, first, last, kinds))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], "file string, number long, line string")


def log_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of text or gzip logs, continued lines folded into the record before."""
    return logs.records(log_lines(spark, path), "file", "number", "line")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header line; ``\\N`` is null."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="\\N", escape="\\")


def snapshot(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of a JSON snapshot, one document over any number of lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def junit(spark: SparkSession, path: str) -> DataFrame:
    """(suite, name, status, seconds) of the test cases of JUnit reports."""
    case = "STRUCT<_name STRING, _classname STRING, _time DOUBLE, failure STRING, error STRING, skipped STRING>"
    suites = spark.read.format("xml").option("rowTag", "testsuite").schema(f"_name STRING, testcase ARRAY<{case}>").load(path)
    c = suites.select(F.col("_name").alias("suite"), F.explode("testcase").alias("c"))
    status = F.when(F.col("c.error").isNotNull(), "error").when(F.col("c.failure").isNotNull(), "failed").when(F.col("c.skipped").isNotNull(), "skipped").otherwise("passed")
    return c.select("suite", F.col("c._name").alias("name"), status.alias("status"), F.col("c._time").alias("seconds"))


def markdown_rows(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """(file, number, cells) of the rows of Markdown tables; rules between head and body are left out."""
    cell = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c))
    is_row = F.rlike(F.col(line), F.lit(r"^\s*\|.*\|\s*$")) & ~F.rlike(F.col(line), F.lit(r"^\s*\|[\s:|-]+\|\s*$"))
    return lines.where(is_row).select(file, number, cell.alias("cells"))


def frontmatter(text: Column, key: str) -> Column:
    """A value of the block between ``---`` lines that begins a text."""
    block = F.regexp_extract(text, r"^---\n([\s\S]*?)\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*)$", 1)), F.lit(""))


def copy_line(*columns: Column) -> Column:
    """A line of COPY text: tabs between fields, ``\\N`` for null, backslash escapes."""
    one = lambda c: F.coalesce(F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\\N"))
    return F.concat_ws("\t", *[one(c) for c in columns])


def csv_line(*columns: Column) -> Column:
    """A line of RFC 4180: quotes where a field needs them, doubled inside; null is empty."""

    def one(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(F.rlike(s, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(",", *[one(c) for c in columns])


def json_line(**columns: Column) -> Column:
    """An element of a JSON array: every named column, nulls too."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in columns.items()]), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    """A table as folder of JSON lines, nulls written; an older folder of that name goes."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, ends: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A query of a database through Spark's JDBC source; with an integer key and its ends it is read in that many ranges at once.

    Rows outside the ends come with the first and last range.  The database's driver must be on Spark's class path.
    """
    reader = spark.read.format("jdbc").options(url=url, fetchsize="10000", **options).option("dbtable", f"({query}) AS asked")
    if key is not None:
        if ends is None:
            raise ValueError("a key needs its ends")
        reader = reader.options(partitionColumn=key, lowerBound=ends[0], upperBound=ends[1], numPartitions=parts)
    return reader.load()


def markdown_line(*columns: Column) -> Column:
    """A row of a Markdown table: bars escaped, line ends as spaces."""
    one = lambda c: F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[one(c) for c in columns]), F.lit(" |"))


def dbml(columns: DataFrame, references: DataFrame) -> DataFrame:
    """(table_name, block): each table of a catalog in DBML, with the references that leave it."""
    body = columns.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("  "), "column_name", F.lit(" "), "type").alias("l")))).alias("c"))
    refs = references.groupBy(F.col("child").alias("table_name")).agg(F.array_sort(F.collect_list(F.concat(F.lit("Ref: "), "child", F.lit("."), "child_column", F.lit(" > "), "parent", F.lit("."), "key_column"))).alias("r"))
    lines = F.array_join(F.transform("c", lambda x: x["l"]), "\n")
    tail = F.when(F.size("r") > 0, F.concat(F.lit("\n"), F.array_join("r", "\n"))).otherwise("")
    return body.join(refs, "table_name", "left").select("table_name", F.concat(F.lit("Table "), "table_name", F.lit(" {\n"), lines, F.lit("\n}"), F.coalesce(tail, F.lit(""))).alias("block"))
