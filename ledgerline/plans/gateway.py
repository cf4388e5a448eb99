"""A guarded way to run read-only statements: named arguments, a preview with its total, a single value."""

from __future__ import annotations

import re
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: first words of queries, and of statements that only describe
QUERIES = ("select", "with", "values", "table")
DESCRIBES = ("show", "describe", "desc", "explain")
#: fixed values: functions that call anything by name, and the clause that makes names from text; refused wherever they stand
REFUSED = re.compile(r"\b(reflect|try_reflect|java_method)\b|\bidentifier\b[\s`]*\(", re.I)
#: fixed values: plan nodes that run programs
RUNS_PROGRAMS = re.compile(r"^[\s:|+\-]*'?ScriptTransformation\b", re.M)
_FILES = "spark.sql.runSQLOnFiles"


def _first_word(statement: str) -> str:
    """The first word, lower case, behind white space, comments and parentheses."""
    text = re.sub(r"^(?:\s|\(|--[^\n]*(?:\n|$)|/\*.*?\*/)*", "", statement, flags=re.S)
    return (re.match(r"[A-Za-z_]*", text) or [""])[0].lower()


def check_read_only(spark: SparkSession, statement: str, args: dict[str, Any] | None = None, **tables: DataFrame) -> None:
    """Raise ``ValueError`` unless the text is one statement that only reads.  Nothing runs.

    A statement is read by Spark's own parser, as the subquery of another, where no grammar lets it write: no reading of
    quotes and comments here decides.  Files as tables are refused, and so are functions and clauses that run any code by its name.
    """
    plain = statement.strip().rstrip(";").rstrip()
    if found := REFUSED.search(plain):
        raise ValueError(f"a statement that reads may not hold {found[0].strip('( `')}")
    if re.match(rf"({'|'.join(DESCRIBES)})\b", plain, re.I):
        if ";" in plain:
            raise ValueError("more than one statement, or a semicolon within one that describes")
        return
    if _first_word(plain) not in QUERIES:
        raise ValueError("not a statement that reads")
    before = spark.conf.get(_FILES)
    spark.conf.set(_FILES, "false")
    try:
        analysed = spark.sql(f"SELECT * FROM (\n{plain}\n)", args=args or {}, **tables)._jdf.queryExecution().analyzed().toString()
    except ParseException as e:
        raise ValueError(f"not one statement that reads: {str(e).splitlines()[0][:200]}") from e
    finally:
        spark.conf.set(_FILES, before)
    if RUNS_PROGRAMS.search(analysed):
        raise ValueError("a statement that reads may not run a program")


def run(spark: SparkSession, statement: str, args: dict[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """The result of a read-only statement; ``:name`` takes arguments as literals, ``{table}`` names DataFrames."""
    check_read_only(spark, statement, args, **tables)
    return spark.sql(statement.strip().rstrip(";"), args=args or {}, **tables)


def preview(df: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, each with the number of all rows."""
    return df.limit(most).crossJoin(F.broadcast(df.agg(F.count("*").alias("total_rows"))))


def scalar(df: DataFrame) -> Any:
    """The one value of a result of one row and one column."""
    rows = df.limit(2).collect()
    if len(rows) != 1 or len(df.columns) != 1:
        raise ValueError(f"a single value is asked for, not {len(df.columns)} columns and {'more than one row' if len(rows) > 1 else f'{len(rows)} rows'}")
    return rows[0][0]
