"""Scalar text functions as column expressions: names, URLs, masks, messages, hashes.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: patterns of what is masked and what replaces it
ID_NUMBER, ID_MASK = r"\b\d{6}-?[1-8]\d{6}\b", "******-*******"
TOKEN, TOKEN_MASK = r"eyJ[\w-]+\.[\w-]+\.[\w-]+", "eyJ…(JWT)"
START_PASSWORD, PASSWORD_MASK = r"(Using generated security password:\s*)\S+", "$1****"
#: fixed values: what a message's group leaves out, in this order
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
HEX = r"\b[0-9a-fA-F]{8,}\b"
INTEGER = r"\b\d+\b"
#: fixed values: words of conditions that are no names
KEYWORDS = ("null", "true", "false", "and", "or", "not", "test", "in", "is", "size", "length", "empty", "equals", "eq", "ne")
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
MOST_SHOWN = 12


def camel(name: Column) -> Column:
    """under_score to camelCase."""
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30)))
    return F.concat(F.element_at(parts, 1), F.when(F.size(parts) > 1, F.array_join(rest, "")).otherwise(""))


def snake(name: Column) -> Column:
    """camelCase to under_score."""
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def plural(word: Column) -> Column:
    """English plural: y after a consonant to ies, es after s, sh, ch, x and z, else s."""
    return F.when(F.rlike(word, F.lit("(^|[^aeiou])y$")), F.regexp_replace(word, "y$", "ies")).when(F.rlike(word, F.lit("(s|sh|ch|x|z)$")), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def strip_prefix(name: Column) -> Column:
    """A column's name without the prefix of letters and digits that names its table."""
    return F.regexp_replace(name, "^[a-zA-Z]+[0-9]+_", "")


def property_name(column: Column) -> Column:
    """A column's property: prefix stripped, camelCase."""
    return camel(F.lower(strip_prefix(column)))


def norm_name(name: Column) -> Column:
    """A name for comparison: lower case, letters and digits only, without a leading ``is``."""
    n = F.regexp_replace(F.lower(name), "[^0-9a-z]", "")
    return F.when(n.startswith("is") & (F.length(n) > 4), F.substring(n, 3, 1 << 30)).otherwise(n)


def identifier_tokens(text: Column) -> Column:
    """The sorted distinct normalised names in a condition, without its keywords."""
    words = F.filter(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), lambda w: ~F.lower(w).isin(*KEYWORDS))
    return F.array_sort(F.array_distinct(F.transform(words, norm_name)))


def normal_url(url: Column) -> Column:
    """A path template: query cut, ``{id}`` and ``${id}`` unified, under ``/api``."""
    path = F.element_at(F.split(url, r"\?"), 1)
    path = F.regexp_replace(F.regexp_replace(path, r"\$\{[^}]*\}", "{}"), r"\{[^}/]*\}", "{}")
    path = F.concat(F.lit("/"), F.regexp_replace(path, "^/+|/+$", ""))
    return F.when(path.startswith("/api/"), path).otherwise(F.concat(F.lit("/api"), path))


def redact_url(url: Column) -> Column:
    """A connection URL without its password."""
    user = F.regexp_extract(url, r"^[^@]*?://([^:@]*)", 1)
    scheme, host = F.regexp_extract(url, "^(.*?)://", 1), F.regexp_extract(url, r"^.*?://[^@]*@(.*)$", 1)
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("(not set)")).when(F.rlike(url, F.lit("://[^@]*@")), F.concat(scheme, F.lit("://"), user, F.lit(":***@"), host)).otherwise(url)


def mask_sensitive(text: Column) -> tuple[Column, Column]:
    """Text with id numbers, JWTs and generated passwords masked, and how many were."""
    n = F.lit(0)
    for pattern, mask in ((ID_NUMBER, ID_MASK), (TOKEN, TOKEN_MASK), (START_PASSWORD, PASSWORD_MASK)):
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, mask)
    return text, n.cast("long")


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; null if there is none."""
    return F.get(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))


def error_key(message: Column) -> Column:
    """What groups an error message: its first line with UUIDs, hex ids and integers as ``#``, cut at 80 characters."""
    line = first_line(message)
    for pattern in (UUID, HEX, INTEGER):
        line = F.regexp_replace(line, pattern, "#")
    return F.substring(line, 1, 80)


def last_cause(lines: Column) -> Column:
    """The last line that names a cause: ``Caused by:``, else ``### Cause:``, else a database error."""
    last = lambda f: F.trim(F.get(F.reverse(F.filter(lines, f)), F.lit(0)))
    return F.coalesce(last(lambda x: x.contains("Caused by:")), last(lambda x: x.contains("### Cause:")), last(lambda x: x.contains("PSQLException") | x.contains("ERROR:")))


def param_values(text: Column, width: int = 60) -> Column:
    """Values of a logged parameter list ``a(Type), b(Type)``: types stripped, cut at ``width``."""
    return F.transform(F.split(text, ", "), lambda x: F.substring(F.regexp_replace(x, r"\([A-Za-z]+\)$", ""), 1, width))


def truncated(text: Column, most: int) -> Column:
    """Text of at most ``most`` characters, the last an ellipsis where it was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def listing(items: Column, most: int = MOST_SHOWN) -> Column:
    """Sorted items joined by commas, with the number of those left out."""
    n = F.size(items)
    return F.concat(F.array_join(F.slice(F.array_sort(items), 1, most), ", "), F.when(n > most, F.concat(F.lit(" … +"), (n - most).cast("string"))).otherwise(""))


def blob_sha1(text: Column) -> Column:
    """The hash under which git stores the text: SHA-1 of ``blob <bytes>\\0`` and the bytes."""
    raw = F.encode(text, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.length(raw).cast("string")), "UTF-8"), F.unhex(F.lit("00")), raw))


def record_hash(*columns: Column) -> Column:
    """A record's content hash: SHA-256 of its fields, nulls apart from empty ones."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def version_key(version: Column) -> Column:
    """A version as an array of integers, which sorts 0.1.10 after 0.1.9; parts that are no number count 0."""
    return F.transform(F.split(F.regexp_replace(F.trim(version), "^v+", ""), r"\."), lambda p: F.coalesce(F.when(F.rlike(p, F.lit("^[0-9]+$")), p.cast("int")), F.lit(0)))


def duration_seconds(text: Column) -> Column:
    """Seconds of 30s, 10m, 1h or 2d; null for anything else."""
    t = F.trim(text)
    unit = F.when(t.endswith("s"), 1).when(t.endswith("m"), 60).when(t.endswith("h"), 3600).when(t.endswith("d"), 86400)
    return F.when(F.rlike(t, F.lit(r"^[0-9]+(\.[0-9]+)?[smhd]$")), F.regexp_extract(t, r"^([0-9.]+)", 1).try_cast("double") * unit)


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression for whole names, whatever their case."""
    out = "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in glob)
    return f"(?i)^{out}$"


def row_json(text: Column, *paths: str) -> Column:
    """The first of some JSON paths that the text holds."""
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])
