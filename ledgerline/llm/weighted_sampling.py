"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text's terms are its words, weighted by their counts.  For each of ``SAMPLES`` places a term draws r and c from Gamma(2, 1)
and b from the unit interval, by hash; a weight w is read on the term's own grid as t = floor(ln w / r + b), and
the term with the least ln a = ln c - r * (t - b + 1) is the sample (Ioffe, 2010).  Two texts hold the same term and t at a place
with a probability of their generalised Jaccard similarity, sum(min) / sum(max) of weights.  As a depends on the
term and t alone, the least value stands for them: a place keeps 32 bits of its hash.

The least a of n words exceeds ``REACH`` / n with a probability of exp(-``REACH``).  So a term is drawn, which takes three
logarithms, only if a bound without any, from -ln x >= 2 (1 - x) / (1 + x) and means of powers, leaves its a below that.  A document
with a place whose least drawn a is not below it is sampled again with every term drawn, so that each place has its least value.

Texts shuffle once by (doc_id, hash of the text), where repeated rows collapse before the shuffle; what a neighbour's text lends
to an edited one shuffles besides.  Words are counted and sampled where their text lies: those before the change are read once for
both texts, and a word that weighs the same in both draws once.  The order of documents is found by ranges of ids and their ends, never in one task.

Cases: a null text counts as empty; a null doc_id comes first; documents that share a doc_id follow each other by the hash of
their texts; rows alike in doc_id and text are one document, returned once a row; texts without words are alike (all places 0)
and unlike any other; a single document is its own next; an empty table gives an empty result; extra columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import cut

SAMPLES = 64
REACH = 24.0  #: a second look is due once in 10**8 documents
SPACE = r"[\x20\x09-\x0D]+"
FIRST = -(1 << 63)  #: stands for a null doc_id


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, key, text): id without nulls; key: hash of the text, another one for null ids."""
    given = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(given, F.lit(FIRST)).alias("id"), F.xxhash64(_text(), given.isNull()).alias("key"), given.alias("doc_id"), _text().alias("text"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(id, key, doc_id, n_chars, n, next_id, next_key) of each document; the last one's next is the first."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(docs).groupBy("id", "key", "doc_id").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("n"))
    rows = cut(rows.repartitionByRange(n, "id", "key").withColumn("part", F.spark_partition_id()))
    firsts = rows.groupBy("part").agg(F.min(F.struct("id", "key")).alias("first"))  # a row per range
    after = Window.orderBy("part").rowsBetween(1, 1)
    start = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = firsts.select("part", F.coalesce(F.first("first").over(after), F.min("first").over(start)).alias("beyond"))
    inside = Window.partitionBy("part").orderBy("id", "key")
    found = F.coalesce(F.lead(F.struct("id", "key")).over(inside), F.col("beyond"))
    return rows.join(ends, "part").withColumn("next", found).select("id", "key", "doc_id", "n_chars", "n", F.col("next.id").alias("next_id"), F.col("next.key").alias("next_key"))


def edited(docs: DataFrame, order: DataFrame, part: int = 4) -> DataFrame:
    """(id, key, text, edited, shared): the last floor(n_chars / part) code points replaced by the next document's first ones.

    shared: how many code points both have in common up to the last white space before the change, so that no word crosses it.
    """
    texts = _keyed(docs).groupBy("id", "key").agg(F.any_value("text").alias("text"))
    taken = F.floor(F.col("n_chars") / part).cast("int")
    lent = order.select(F.col("next_id").alias("id"), F.col("next_key").alias("key"), F.col("id").alias("to_id"), F.col("key").alias("to_key"), taken.alias("taken"))
    pieces = texts.join(lent, ["id", "key"]).select(F.col("to_id").alias("id"), F.col("to_key").alias("key"), F.expr("substring(text, 1, taken)").alias("piece"))
    left = F.expr(f"substring(text, 1, length(text) - cast(floor(length(text) / {part}) AS int))")
    shared = F.length(F.regexp_extract(left, r"(?s)^.*[\x20\x09-\x0D]", 0))
    return texts.join(pieces, ["id", "key"]).select("id", "key", "text", F.concat(left, F.col("piece")).alias("edited"), shared.alias("shared"))


def _uniforms(place: int) -> tuple[str, str, str]:
    """SQL of exp(-r), exp(-c) and b of the column ``term`` at a place."""
    one, two = (f"xxhash64(term ^ {(2 * place + i) * 0x9E3779B97F4A7C15 % (1 << 63)}L)" for i in (1, 2))
    unit = lambda h, shift, bits: f"((shiftrightunsigned({h}, {shift}) & {(1 << bits) - 1}L) + 0.5D) * {2.0 ** -bits!r}D"
    return f"({unit(one, 0, 21)} * {unit(one, 21, 21)})", f"({unit(two, 0, 32)} * {unit(two, 32, 32)})", f"({unit(one, 42, 22)})"


def draws(place: int) -> tuple[str, str, str]:
    """SQL of r, ln c and b of the column ``term`` at a place."""
    y, z, b = _uniforms(place)
    return f"(-ln{y})", f"ln(-ln{z})", b


def within(place: int) -> str:
    """SQL of a test without logarithms that holds wherever a < ``far``: c is at least 2 (1 - z) / (1 + z), and
    y^(t - b + 1) at least y / weight, for t = 0 the harmonic mean of 1 and y too."""
    y, z, b = _uniforms(place)
    return f"2D * (1D - {z}) < far * (1D + {z}) * if(weight = 1, {b} + (1D - {b}) / {y}, weight / {y})"


def sampled(terms: DataFrame, by: list[str], samples: int = SAMPLES, pruned: bool = True) -> DataFrame:
    """``by`` and the least ln a of each place, p0, p1 ...; terms: rows of ``by``, a long ``term``, its ``weight`` and ``far``.

    pruned: a place holds its least value only if that is below ln ``far``, else it may be null or a greater one.
    """
    logs = terms.select(*by, "term", "weight", "far", F.ln("weight").alias("log_w"))
    least = []
    for k in range(samples):
        r, log_c, b = draws(k)
        value = f"{log_c} - {r} * (floor(log_w / {r} + {b}) - {b} + 1D)"
        least.append(F.expr(f"min({f'if({within(k)}, {value}, NULL)' if pruned else value}) AS p{k}"))
    return logs.groupBy(*by).agg(*least)


def places(least: list[str]) -> Column:
    """An array of 32 bits a place from the columns of least values; all 0 without terms."""
    return F.expr("array(" + ", ".join(f"if({p} IS NULL, 0, cast(shiftright(xxhash64({p}), 32) AS int))" for p in least) + ")")


def likeness(a: str, b: str) -> Column:
    """The share of places at which two arrays of samples agree."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x) / cast(size({a}) AS double)")


def written(samples: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a place."""
    return F.array_join(F.transform(samples, lambda x: F.lower(F.right(F.lpad(F.hex(x.cast("long")), F.lit(16), F.lit("0")), F.lit(8)))), "")


def printed(texts: DataFrame, samples: int, reach: float | None) -> DataFrame:
    """(id, key, fingerprint, edited_fingerprint, sure) of the texts that have words; sure: no place lacks its least value."""
    pieces = {"both": "substring(text, 1, shared)", "own": "substring(text, shared + 1)", "new": "substring(edited, shared + 1)"}
    split = texts.select("id", "key", *[F.split(F.expr(of), SPACE).alias(name) for name, of in pieces.items()])
    # a split has two empty pieces at most, so that a text has n - 4 words at least
    n = F.size("both") + F.least(F.size("own"), F.size("new"))
    far = F.lit(reach or 0.0) / F.greatest(n - 4, F.lit(1))
    words = split.select("id", "key", far.alias("far"), F.size("both").alias("n_both"), (F.size("both") + F.size("own")).alias("n_own"), F.posexplode(F.concat(*pieces)).alias("at", "word")).where("word <> ''")
    at = F.col("at")
    words = words.select("id", "key", "far", F.xxhash64("word").alias("term"), (at < F.col("n_own")).cast("int").alias("own"), ((at < F.col("n_both")) | (at >= F.col("n_own"))).cast("int").alias("new"))
    terms = words.groupBy("id", "key", "far", "term").agg(F.sum("own").alias("own"), F.sum("new").alias("new"))
    # a term that weighs the same in both texts is sampled once, one that a text lacks is not sampled for it
    own, new = "struct(1 AS side, own AS weight)", "struct(2 AS side, new AS weight)"
    sides = f"CASE WHEN own = new THEN array(struct(0 AS side, own AS weight)) WHEN new = 0 THEN array({own}) WHEN own = 0 THEN array({new}) ELSE array({own}, {new}) END"
    least = sampled(terms.select("id", "key", "far", "term", F.expr(f"inline({sides})")), ["id", "key", "far", "side"], samples, reach is not None)
    names = {"a": 2, "b": 1}  # the side that is not theirs
    values = [F.min(F.when(F.col("side") != other, F.col(f"p{k}"))).alias(f"{name}{k}") for name, other in names.items() for k in range(samples)]
    each = least.groupBy("id", "key", "far").agg(*values, *[F.bool_or(F.col("side") != other).alias(f"has_{name}") for name, other in names.items()])
    # with a little room for rounding
    lacks = [f"(has_{name} AND exists(array({', '.join(f'{name}{k}' for k in range(samples))}), x -> x IS NULL OR x > ln(far) - 1e-9D))" for name in names] if reach is not None else ["false"]
    return each.select("id", "key", *[places([f"{name}{k}" for k in range(samples)]).alias(to) for name, to in (("a", "fingerprint"), ("b", "edited_fingerprint"))], F.expr(f"NOT ({' OR '.join(lacks)})").alias("sure"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, reach: float = REACH) -> DataFrame:
    """A row per row of ``docs``: fingerprints of its text and of its edited text, and their likenesses."""
    order = cut(neighbours(docs))
    texts = edited(docs, order)
    none = F.expr(f"array_repeat(0, {samples})")
    prints = [F.coalesce(c, none).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    whole = texts.select("id", "key", F.sha2("edited", 256).alias("edited_sha256"))
    found = cut(whole.join(printed(texts, samples, reach), ["id", "key"], "left").select("id", "key", "edited_sha256", *prints, F.coalesce("sure", F.lit(True)).alias("sure")))
    unsure = found.where("NOT sure").select("id", "key", "edited_sha256")
    if not unsure.isEmpty():
        again = unsure.join(printed(texts.join(unsure, ["id", "key"], "left_semi"), samples, None), ["id", "key"])
        found = cut(found.where("sure").unionByName(again.select(*found.columns)))
    after = found.select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("fingerprint").alias("next_fingerprint"))
    rows = order.join(found, ["id", "key"]).join(after, ["next_id", "next_key"]).withColumn("copy", F.explode(F.expr("sequence(1L, n)")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("fingerprint")).alias("fingerprint"), written(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
