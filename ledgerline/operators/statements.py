"""Statements compared by what they say: comments, white space and the case of words don't count; literals, parameters and tags do."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.lineage import kept

#: fixed values: what keeps its case (literals, parameters, tags), and what else is a token
LITERAL = r"'[^']*(?:''[^']*)*'"
PARAMETER = r"[#$]\{[^}]+\}"
TAG = r"</?[a-zA-Z0-9_]+(?:[^>'\"]|'[^']*'|\"[^\"]*\"|\")*>"
OPERATORS = r"!=|<=|>=|<>|==|\|\||::"
COMMENTS = (r"(?s)<!--.*?-->", r"(?s)/\*.*?\*/", r"--[^\n]*")
KEPT = f"{LITERAL}|{PARAMETER}|{TAG}"
_TOKEN = re.compile(rf"{KEPT}|{OPERATORS}|\w+|[^\w\s]")
_CASED = ("'", "#{", "${", "<")
#: fixed values: how much of a change a summary shows
MOST_TOKENS, MOST_CHARS, MOST_CHANGES, MOST_SUMMARY = 30, 200, 3, 400


def cleaned(text: Column) -> Column:
    """Without comments, white space as single spaces."""
    for c in COMMENTS:
        text = F.regexp_replace(text, c, "")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised(text: Column) -> Column:
    """``cleaned``, in lower case but for literals, parameters and tags."""
    pieces = F.regexp_extract_all(cleaned(text), F.lit(rf"(?s){KEPT}|[^'#$<]+|."), F.lit(0))
    own = F.lit(rf"(?s)^(?:{KEPT})$")
    return F.array_join(F.transform(pieces, lambda p: F.when(F.rlike(p, own), p).otherwise(F.lower(p))), "")


def _shown(words: list[str]) -> str:
    taken, size = [], 0
    for w in words[:MOST_TOKENS]:
        if taken and size + len(w) + 1 > MOST_CHARS:
            break
        size += len(w) + bool(taken)
        taken.append(w)
    text = " ".join(taken)[:MOST_CHARS].rstrip() if size > MOST_CHARS else " ".join(taken)
    return text + (f" … (+{len(words) - len(taken)})" if len(words) > len(taken) else "")


def changes(old: str, new: str) -> tuple[str, list[str]]:
    """A short summary and all changes between two cleaned statements: ``- old``, ``+ new`` or both, token by token."""
    a, b = _TOKEN.findall(old), _TOKEN.findall(new)
    key = lambda w: w if w.startswith(_CASED) else w.lower()
    short, full = [], []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, [key(w) for w in a], [key(w) for w in b]).get_opcodes():
        if kind != "equal":
            gone, come = a[i:j], b[k:m]
            for to, show in ((short, _shown), (full, " ".join)):
                to.append(" / ".join(s for s in (f"- {show(gone)}" if gone else "", f"+ {show(come)}" if come else "") if s))
    summary = " · ".join(short[:MOST_CHANGES]) + (f" · +{len(short) - MOST_CHANGES}" if len(short) > MOST_CHANGES else "")
    return (summary if len(summary) <= MOST_SUMMARY else summary[:MOST_SUMMARY].rstrip() + " …"), full


def drift(base: DataFrame, now: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, status, summary, changes) of the statements of both sides; ``key`` is unique on each.

    status: added, moved (gone, but its normalised text stands under another key), deleted, same, format (only comments, white space
    or case differ) or changed.  Texts are compared by hash; only changed ones are read token by token, equal pairs of texts
    once.  A null text is empty.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        t = F.coalesce(F.col(text).cast("string"), F.lit(""))
        return df.select(*key, F.sha2(t, 256).alias(f"{name}_sha"), F.sha2(normalised(t), 256).alias(f"{name}_norm"), cleaned(t).alias(f"{name}_text"))

    a, b = side(base, "old"), side(now, "new")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    met = a.drop("old_text").alias("a").join(b.drop("new_text").alias("b"), same, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], "old_sha", "old_norm", "new_sha", "new_norm")
    elsewhere = b.select(F.col("new_norm").alias("old_norm"), F.lit(True).alias("elsewhere")).distinct()
    met = met.join(elsewhere, "old_norm", "left")
    status = (
        F.when(F.col("old_sha").isNull(), "added")
        .when(F.col("new_sha").isNull(), F.when(F.col("elsewhere"), "moved").otherwise("deleted"))
        .when(F.col("old_sha") == F.col("new_sha"), "same")
        .when(F.col("old_norm") == F.col("new_norm"), "format")
        .otherwise("changed")
    )
    met = kept(met.select(*key, "old_norm", "new_norm", status.alias("status")))
    pairs = met.where("status = 'changed'").select("old_norm", "new_norm").distinct()
    texts = lambda df, name: df.groupBy(f"{name}_norm").agg(F.any_value(f"{name}_text").alias(f"{name}_text"))
    pairs = pairs.join(texts(a, "old"), "old_norm").join(texts(b, "new"), "new_norm")

    def read(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([changes(x, y) for x, y in zip(old, new, strict=True)], columns=["summary", "changes"])

    found = pairs.select("old_norm", "new_norm", F.pandas_udf(read, "summary string, changes array<string>")("old_text", "new_text").alias("d"))
    out = met.where("status = 'changed'").join(found, ["old_norm", "new_norm"]).select(*key, "status", "d.summary", "d.changes")
    return out.unionByName(met.where("status <> 'changed'").select(*key, "status", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("array<string>").alias("changes")))
