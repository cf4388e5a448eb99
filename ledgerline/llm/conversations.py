"""Conversation structure repair by a min-plus matrix scan.

A conversation is whole when its role initials match ``(s?(ua)+)?``.  The states are what has been written so far: nothing, a
system turn, a user turn, an assistant turn.  Each turn is a 4x4 matrix whose entry (i, j) is the cheapest edit of the turn that
leads from state i to state j, after the closure over inserted turns; entries are (cost, audit), sums concatenate audits
and minima take the lesser audit of equal costs.  Both orders agree with concatenation: audits of equal cost over the same
turns are never prefixes of one another, since what follows the last turn's letter are inserts, which cost.  The product
is therefore associative: runs of a conversation's turns are multiplied where they lie, and their products in a tree of
groups of ``FAN``, so that no conversation, however long, meets in one task.

A conversation's own digest is sequential: its turns stream through one task in order, in batches, and nothing of them is held.

Cases: null roles and texts (and ids and turns where they are hashed) count as one space; a null conv_id is a conversation,
null turns come first; rows of one turn are in order of role, text and copy; rows alike are copies, all but the first
duplicates; an unknown role can't be kept; an empty table gives an empty result; extra columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, hot_join, lean

RUN = 1024  #: turns that are multiplied in one go
FAN = 32  #: products that meet in one group of the tree
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  #: costs
WORD = r"[^\x20\x09-\x0D]"

Entry = tuple[int, str] | None  # None: no way
Matrix = list[list[Entry]]

START, SYSTEM, USER, ASSISTANT = range(4)
#: where a turn of a role leads from each state
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


def least(a: Entry, b: Entry) -> Entry:
    return b if a is None else a if b is None else min(a, b)


def times(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product: the cheapest way through ``x``, then ``y``."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for row, into in zip(x, out, strict=True):
        for k, first in enumerate(row):
            if first is not None:
                for j, then in enumerate(y[k]):
                    if then is not None:
                        into[j] = least(into[j], (first[0] + then[0], first[1] + then[1]))
    return out


def _identity() -> Matrix:
    return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def closure() -> Matrix:
    """Any number of inserted user and assistant turns; more than three only go in circles."""
    once = _identity()
    for moves in (MOVES["u"], MOVES["a"]):
        for i, j in moves.items():
            once[i][j] = least(once[i][j], (INSERT, "I"))
    return times(times(once, once), once)


def turn_matrix(initial: str, must_go: bool, truncated: bool) -> Matrix:
    """The closure, then one turn's edits."""
    one: Matrix = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if not must_go:
        more = TRUNCATED if truncated else 0
        for i, j in MOVES.get(initial, {}).items():
            one[i][j] = least(one[i][j], (KEEP + more, "K"))
        for role in "ua":
            for i, j in MOVES[role].items():
                one[i][j] = least(one[i][j], (REROLE + more, "R"))
    return times(closure(), one)


def answer(product: Matrix) -> tuple[int, str]:
    """(cost, audit) of a conversation from the product of its turns."""
    whole = times(product, closure())[START]
    return least(whole[START], whole[ASSISTANT])


def repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of the turns that an audit leaves, inserts included; audit and turns are read once, in order."""
    user_next, first = True, True
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit != "K":
            role = "user" if user_next else "assistant"
        if not (first and edit == "K" and role[:1] == "s"):
            user_next = not user_next
        first = False
        yield f"{role}:{text}"


# -- rows --------------------------------------------------------------------------------------------------------------


def _space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after damage by crc32(``conv_id:turn``) mod 20: 0 drops a row, 1 empties its text, 2 strips ``.!?``, 3 repeats it, 4 makes its role user."""
    kind = F.crc32(F.concat(_space(F.col("conv_id")), F.lit(":"), _space(F.col("turn"))).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(_space(F.col("text")), ".!?", "")).otherwise(_space(F.col("text")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(_space(F.col("role"))).alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.where("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.drop("kind")


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copy), written in ranges, with ``part`` and ``pos``, which ascend in the order of each conversation.

    The last key, different on rows alike, lets a range end among them.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role", "text", "copy", "any"]
    rows = rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return cut(rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"), F.spark_partition_id().alias("part")))


def faults(ordered: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, part, initial, fault) of the rows of ``in_order``; fault: a row's first one or none."""
    blank = ~F.rlike("text", F.lit(WORD))
    truncated = ~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    same = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.length("role"), "role", "text"), 256))
    rows = ordered.select("conv_id", "turn", "pos", "part", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), truncated.alias("truncated"), same.alias("same"))
    rows = cut(rows)
    met = hot_join(rows, rows.groupBy("same").agg(F.min("pos").alias("first")), "same")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    return met.select("conv_id", "turn", "pos", "part", "initial", fault.alias("fault"))


# -- scan --------------------------------------------------------------------------------------------------------------

PIECE = "conv_id long, seq long, initials array<string>, illegal long, costs array<long>, audits array<string>"
LEGAL = ("su", "ua", "au")


def _flat(m: Matrix) -> tuple[list, list]:
    return [e and e[0] for row in m for e in row], [e and e[1] for row in m for e in row]


def _square(costs: list, audits: list) -> Matrix:
    one = [None if c is None else (int(c), a) for c, a in zip(costs, audits, strict=True)]
    return [one[i : i + 4] for i in range(0, 16, 4)]


def _batch(pieces: list) -> pa.RecordBatch:
    names = ["conv_id", "seq", "initials", "illegal", "costs", "audits"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pieces], k) for i, k in enumerate(kinds)], names)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A product for each run of rows of one (conv_id, seq); rows come in order, and a run may cross batches."""
    kinds: dict[tuple, Matrix] = {}
    now, product, ends, illegal = None, None, ["", ""], 0
    for batch in batches:
        out = []
        for conv, seq, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "initial", "fault")), strict=True):
            kind = (initial, fault in ("blank", "duplicate"), fault == "truncated")
            if kind not in kinds:
                kinds[kind] = turn_matrix(*kind)
            if now == (conv, seq):
                illegal += ends[1] + initial not in LEGAL
                ends[1] = initial
                product = times(product, kinds[kind])
                continue
            if now is not None:
                out.append((*now, ends, illegal, *_flat(product)))
            now, product, ends, illegal = (conv, seq), kinds[kind], [initial, initial], 0
        if out:
            yield _batch(out)
    if now is not None:
        yield _batch([(*now, ends, illegal, *_flat(product))])


def merged(pieces: pa.Table) -> pa.Table:
    """The product of at most ``FAN`` pieces of one conversation."""
    rows = sorted(pieces.to_pylist(), key=lambda p: p["seq"])
    product, illegal, ends = _square(rows[0]["costs"], rows[0]["audits"]), rows[0]["illegal"], rows[0]["initials"]
    for p in rows[1:]:
        first, last = p["initials"]
        product, illegal, ends = times(product, _square(p["costs"], p["audits"])), illegal + p["illegal"] + (ends[1] + first not in LEGAL), [ends[0], last]
    return pa.Table.from_batches([_batch([(rows[0]["conv_id"], rows[0]["seq"] // FAN, ends, illegal, *_flat(product))])])


def scanned(turns: DataFrame) -> DataFrame:
    """(conv_id, illegal, costs, audits): the product of all turns of each conversation, from ``faults``."""
    most = turns.agg(F.max(F.expr(f"(pos & {(1 << 33) - 1}) div {RUN}"))).first()[0] or 0
    seq = F.col("part").cast("long") * (most + 1) + F.expr(f"(pos & {(1 << 33) - 1}) div {RUN}")
    rows = turns.select("conv_id", seq.alias("seq"), "pos", "initial", "fault").repartition("conv_id", "seq").sortWithinPartitions("conv_id", "seq", "pos")
    pieces = cut(lean(rows.select("conv_id", "seq", "initial", "fault")).mapInArrow(runs, PIECE))
    done = None
    while True:
        count = pieces.groupBy("conv_id").agg(F.count("*").alias("c"))
        same = F.col("p.conv_id").eqNullSafe(F.col("c.conv_id"))
        many = cut(pieces.alias("p").join(count.where("c > 1").alias("c"), same, "left_semi"))
        alone = pieces.alias("p").join(count.where("c = 1").alias("c"), same, "left_semi")
        done = alone if done is None else done.unionByName(alone)
        if many.isEmpty():
            return done.select("conv_id", "illegal", "costs", "audits")
        group = many.withColumn("up", F.expr(f"seq div {FAN}"))
        pieces = cut(group.groupBy("conv_id", "up").applyInArrow(lambda t: merged(t), PIECE))


def digests(ordered: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256); each conversation's audit comes first, then its turns in order."""
    none = F.lit(None).cast("string")
    rows = ordered.select("conv_id", "pos", "role", "text", none.alias("audit")).unionByName(audits.select("conv_id", F.lit(-1).cast("long").alias("pos"), none.alias("role"), none.alias("text"), "audit"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")), strict=True)

        found, stream = [], turns()
        head = next(stream, None)
        while head is not None:
            conv, audit = head[0], head[3]
            head, sha, sep = None, hashlib.sha256(), b""
            for line in repaired(audit, (r[1:3] for r in stream)):
                sha.update(sep + line.encode())
                sep = b"\n"
            found.append((conv, sha.hexdigest()))
            head = next(stream, None)
            if len(found) == 1000 or head is None:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], ["conv_id", "repaired_sha256"])
                found = []

    return lean(rows.drop("pos")).mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """A row per conv_id of ``conversations``: faults, cheapest repair and digest of ``rows`` (conv_id, turn, role, text, copy), which are ``damaged`` ones if not given."""
    ordered = in_order(damaged(conversations) if rows is None else rows)
    turns = cut(faults(ordered))
    of = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = turns.groupBy("conv_id", "turn").agg(*[of(x) for x in ("blank", "duplicate", "truncated")])
    counts = counts.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])

    @F.udf("struct<cost long, audit string>")
    def best(costs, audits):
        return answer(_square(costs, audits))

    repairs = scanned(turns).withColumn("best", best("costs", "audits")).select("conv_id", "illegal", "best.cost", "best.audit")
    repairs = cut(repairs)
    shas = digests(ordered, repairs)
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("o")
    for name, table in (("c", counts), ("r", repairs), ("h", shas)):
        out = out.join(table.alias(name), F.col("o.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("o.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
