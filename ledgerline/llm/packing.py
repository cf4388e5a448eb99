"""Best-fit packing of token sequences by a configuration linear program.

Pieces are at most ``LENGTH`` tokens, so the problem is a histogram over at most ``LENGTH`` lengths, however large the
corpus.  Configurations (multisets of lengths that fit in a sequence) are priced by multiplicative weights: each round a
knapsack dynamic program finds the configuration of largest value, which is used for a part of the sequences, and the
weights of its lengths fall with the demand covered.  What the rounded program leaves over, a few hundredths of the
pieces, goes best fit, longest first, into gaps and new sequences.  Each task then looks up its pieces' places by number
within their length.

Cases: a null text counts as empty: its one piece is the end token; a document of exactly ``LENGTH`` tokens is one
piece; rows that share a doc_id are packed separately; equal lengths are numbered in the order of their tasks; an empty
table gives an empty result; extra columns of any name are passed over.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import cut, lean, mix64, tokens, U

LENGTH = 2048
END = 0
ROUNDS = 64  #: a configuration is used for one in so many of the sequences still to fill
ETA = 1.0  #: how far the price of a length falls while its demand is covered
FOR_LONG = 0.5  #: exponent that makes long pieces dearer than short ones
PRICED = 1024  #: lengths of which one round picks its configuration
BEARABLE = 0.7  #: part of the tokens left whose lengths bear the uses of a round
LEFT = 0.005  #: part of the tokens that the program leaves over
HELD = 0.002  #: part of the tokens, in the shortest pieces, that it does not touch
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS  #: units whose ids a worker remembers (20 MB, and 16 MB of ids)
MOST_IDS = 4_000_000  #: ids that it remembers; then it starts anew

#: bytes: 0 white space, 1 letter, 2 digit, 3 other, 4 of a word that is asked for as a whole
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
#: bytes that plain words lack: controls, the apostrophe of contractions, and all letters but U+00C0 to U+017F
_ODD = np.zeros(256, dtype=bool)
_ODD[[*range(9), *range(14, 32), 39, 127, 0xC2, *range(0xC6, 256)]] = True


class Memory:
    """The tokenizer of a file and the ids of units (parts of words) that a worker has met, by 64-bit hash.

    A table of ``SLOTS`` places holds for each unit where its ids lie in ``pool``; a unit whose place another has taken is
    asked for again.  So memory is bounded and a chunk costs what its own units cost.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.last = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), dtype=bool)
        for w, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.last[i] = w.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.keys, self.offset, self.size = np.zeros(SLOTS, U), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    def ask(self, plain: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, one after the other, and their numbers, of plain units (asked for in one text) and then of odd ones."""
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def each(units: list[str]) -> None:
            for e in self.tok.encode_batch(units, add_special_tokens=False) if units else []:
                ids.append(np.array(e.ids, dtype="<u4"))
                sizes.append(np.array([len(e.ids)]))

        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            got = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) == len(some):
                ids.append(got)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each(some)
        each(odd)
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def ids_of(self, h: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after the other, and their numbers; unit i is ``text[start[i]:end[i]]`` with hash ``h[i]``."""
        if self.used > MOST_IDS:
            self.forget()
        slot = (h >> U(64 - SLOT_BITS)).astype(np.int64)
        at, size = self.offset[slot], self.size[slot].astype(np.int64)
        miss = np.flatnonzero((self.keys[slot] != h) | (size == 0))
        if len(miss):
            _, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            new = miss[first]
            order = np.argsort(odd[new], kind="stable")
            words = [text[a:z].tobytes().decode("utf-8", "replace") for a, z in zip(start[new[order]].tolist(), end[new[order]].tolist(), strict=True)]
            n = int((~odd[new]).sum())
            ids, sizes = self.ask(words[:n], words[n:])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), "<u4")])
            self.pool[self.used : self.used + len(ids)] = ids
            begin = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            begin, sizes = begin[back], sizes[back]
            self.keys[slot[new]], self.offset[slot[new]], self.size[slot[new]] = h[new], begin, sizes
            at[miss], size[miss] = begin[inverse], sizes[inverse]
        return self.pool[spread(at, size)], size


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + size - 1."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


_memory: dict[str, Memory] = {}


def token_ids(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text, as the tokenizer gives them.

    This vocabulary's tokenizer drops white space, lower-cases, and splits words into runs of letters, digits and other
    characters, each with ids of its own; so units of a batch are found and hashed at once and each distinct one is asked
    for once.  Words with other characters or an apostrophe are units as a whole.
    """
    if path not in _memory:
        _memory[path] = Memory(path)
    m = _memory[path]
    for t in tokens(column):
        buf = t.buf
        if not len(t.starts):
            yield from (np.zeros(0, "<u4") for _ in t.bounds[1:])
            continue
        cls = _CLASS[buf]
        bad = _ODD[buf]
        if len(buf) > 1:
            for x, y in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (0x3C, 0x7C)):
                bad[:-1] |= (buf[:-1] == x) & (buf[1:] == y)
        if bad.any():
            total = np.concatenate([[0], np.cumsum(bad)])
            for i in np.flatnonzero(total[t.ends] > total[t.starts]):
                cls[t.starts[i] : t.ends[i]] = 4
        edge = np.empty(len(buf), dtype=bool)
        edge[0] = True
        edge[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == 2)
        edge[t.starts] = True
        start = np.flatnonzero(edge)  # of units and of white space runs
        end = np.append(start[1:], len(buf))
        real = cls[start] != 0
        start, end = start[real], end[real]
        # white space inside a run of edges cannot occur; a unit may touch the next text's first, which is an edge itself
        up, down = t.powers()
        with np.errstate(over="ignore"):
            h = mix64((t.total[end] - t.total[start]) * down[start] + (end - start).astype(U) * U(0x2545F4914F6CDD1D))
        for i in np.flatnonzero(cls[start] == 4):  # case counts: a special token's text is lower case
            h[i] = xxhash.xxh3_64_intdigest(t.raw[start[i] : end[i]].tobytes())
        flat, sizes = m.ids_of(h, t.raw, start, end, cls[start] == 4)
        # units of a text are those that start in its tokens
        owner = np.searchsorted(start, np.append(t.starts, len(buf)))[t.bounds]
        cuts = np.concatenate([[0], np.cumsum(sizes)])[owner]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield flat[lo:hi]


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): nth counts pieces of one length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(length + 1, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rows = []
                for i, t in zip(b.column("doc_id").to_pylist(), token_ids(b.column("text"), path), strict=True):
                    ids = np.append(t, np.array([END], dtype="<u4"))
                    for p, start in enumerate(range(0, len(ids), length)):
                        part = ids[start : start + length]
                        rows.append((i, p, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                        seen[len(part)] += 1
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k in (1, 5) else pa.int64()) for k, c in enumerate(cols)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def _price(values: np.ndarray, sizes: np.ndarray, most: np.ndarray, room: int) -> np.ndarray:
    """Counts, of each size at most ``most``, of the filling of largest value: a bounded knapsack by dynamic programming."""
    best = np.zeros(room + 1)
    taken = []  # (size's place, how many at once, where they are in the best filling)
    for k, (size, value, left) in enumerate(zip(sizes.tolist(), values.tolist(), np.minimum(most, room // sizes).tolist(), strict=True)):
        times = 1
        while left > 0:
            times = min(times, left)
            new, old = best[: room + 1 - times * size] + times * value, best[times * size :]
            won = new > old
            np.copyto(old, new, where=won)
            taken.append((k, times, won))
            left -= times
            times *= 2
    out, at = np.zeros(len(sizes), np.int64), room
    for k, times, won in reversed(taken):
        under = at - times * int(sizes[k])
        if under >= 0 and won[under]:
            out[k] += times
            at = under
    return out


def program(histogram: dict[int, int], room: int = LENGTH) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """(times, {length: count}) of the configurations that the covering program uses, and the pieces left over.

    The program asks for the fewest sequences that cover the demand of every length.  A length's price starts at its share
    of a sequence, a little more for the long ones, and falls by ``exp(-ETA)`` while its demand is covered: the
    multiplicative weights.  Each round the knapsack finds the dearest configuration, of at most ``PRICED`` lengths in
    turn (partial pricing), and uses it for about 1/ROUNDS of the sequences still to fill; configurations are held to
    what is left for that many uses, so the uses are whole numbers and rounding is part of each step.  The last ``LEFT``
    of the tokens, for which a step holds hardly any length, are left over, and the shortest pieces, ``HELD`` of the tokens.
    """
    sizes = np.array(sorted((s for s, n in histogram.items() if n), reverse=True), dtype=np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    # the shortest pieces are held back: they fill what rounding leaves of sequences
    shorter = np.cumsum((demand * sizes)[::-1])[::-1] - demand * sizes
    held = np.clip((HELD * float(demand @ sizes) - shorter) // sizes, 0, demand).astype(np.int64)
    left, plan, turn = demand - held, [], 0
    price = (sizes / room) ** (1 + FOR_LONG)
    least = LEFT * float(demand @ sizes)
    while len(sizes) and (total := int(left @ sizes)) > least:
        # uses: no more than the lengths that hold most of what is left can bear
        order = np.argsort(-left, kind="stable")
        bearable = left[order][np.searchsorted(np.cumsum((left * sizes)[order]), BEARABLE * total)]
        uses = max(1, min(total // room // ROUNDS, int(bearable)))
        on = np.flatnonzero(left >= uses)
        turns = -(-len(on) // PRICED)
        on = on[turn % turns :: turns]
        turn += 1
        a = _price(price[on] * np.exp(-ETA * (1 - left[on] / demand[on])), sizes[on], left[on] // uses, room)
        left[on] -= uses * a
        plan.append((uses, dict(zip(sizes[on][a > 0].tolist(), a[a > 0].tolist(), strict=True))))
    return plan, {s: n for s, n in zip(sizes.tolist(), (left + held).tolist(), strict=True) if n}


def solve(histogram: dict[int, int], room: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: count}) of sequences that hold every piece of the histogram exactly once."""
    plan, left = program(histogram, room)
    return _best_fit(left, room, plan)


def _best_fit(histogram: dict[int, int], room: int, plan: list[tuple[int, dict[int, int]]] = ()) -> list[tuple[int, dict[int, int]]]:
    """``plan`` with the pieces added best fit, longest first, to runs of equal sequences: as many at once as have the same filling."""
    open_: dict[int, list[list]] = {}  # free room -> [times, filling]
    for times, filling in plan:
        open_.setdefault(room - sum(s * n for s, n in filling.items()), []).append([times, filling])
    for s in sorted((s for s, n in histogram.items() if n), reverse=True):
        n = histogram[s]
        for free in range(s, room):
            while n and open_.get(free):
                times, filling = open_[free].pop()
                per = free // s
                full, rest = (n // per, n % per) if times > n // per else (times, 0)
                n -= full * per + rest
                more = lambda c: {**filling, s: filling.get(s, 0) + c}  # noqa: E731, B023
                if full:
                    open_.setdefault(free - per * s, []).append([full, more(per)])
                if rest:
                    open_.setdefault(free - rest * s, []).append([1, more(rest)])
                if times > full + (rest > 0):
                    open_.setdefault(free, []).append([times - full - (rest > 0), filling])
            if not n:
                break
        per = room // s
        if n // per:
            open_.setdefault(room - per * s, []).append([n // per, {s: per}])
        if n % per:
            open_.setdefault(room - n % per * s, []).append([1, {s: n % per}])
    return [(times, filling) for rows in open_.values() for times, filling in rows]


def places(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first number, per sequence, first sequence, offset), sorted: where pieces of a length go."""
    rows, given, sequence = [], {}, 0
    for times, filling in plan:
        offset = 0
        for s, n in sorted(filling.items(), reverse=True):
            rows.append((s, given.get(s, 0), n, sequence, offset))
            given[s] = given.get(s, 0) + n * times
            offset += n * s
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece's sequence and place there."""
    parts = cut(pieces(docs, path, length))
    counts = cut(parts.groupBy("length", "task").agg(F.count("*").alias("c")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("c").alias("n")).collect()}  # at most `length` rows
    table = parts.sparkSession.sparkContext.broadcast(places(solve(histogram, length)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    numbered = parts.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in batches:
            size, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            at = np.searchsorted(t[:, 0] * (1 << 48) + t[:, 1], size * (1 << 48) + number, side="right") - 1
            r = t[at]
            copy, slot = (number - r[:, 1]) // r[:, 2], (number - r[:, 1]) % r[:, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(r[:, 3] + copy), pa.array(r[:, 4] + slot * size)], [*b.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
