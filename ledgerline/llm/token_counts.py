"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the vocabulary's word mark before it.  The distinct pre-tokens of a batch go into a trie; the
best unigram score of the segmentation that ends at a node depends only on the path to it, so it is computed once for all
words that share the prefix, and the count of pieces at a word's last node is that word's token count.

The vocabulary is a public one that lists pieces by merge rank and has no probabilities; a piece's unigram score is taken
as -ln(rank + 1) - 1, after Zipf's law.  Of equal scores the segmentation with fewer pieces counts.  A character that no
piece covers counts as its UTF-8 bytes.

Cases: a null, empty or blank text has no pre-tokens and counts 0; words are runs outside ``\\x20 \\x09-\\x0D``; repeated
rows get equal results; an empty table gives an empty result; extra columns of any name are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import lean, tokens, U

MARK = "▁"
BYTE_SCORE = -20.0  #: of a character that no piece covers, for each of its bytes
MOST_WORDS = 500_000  #: distinct words whose counts a worker remembers; then it starts anew


class Trie:
    """Piece scores and the forward scores of every prefix met: node = (score, count) of its best segmentation."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)

    def counts(self, words: list[str]) -> list[int]:
        """Token count of each of the distinct ``words``, in order; prefixes that words share are scored once.

        Sorted words visit the trie depth first, so the path to the current node is all of it that is held.
        """
        out = [0] * len(words)
        best: list[float] = [0.0]
        count: list[int] = [0]
        last = ""
        get, longest = self.scores.get, self.longest
        for i in sorted(range(len(words)), key=words.__getitem__):
            w = words[i]
            shared, most = 0, min(len(w), len(last))
            while shared < most and w[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                size = len(w[end - 1].encode("utf-8", "surrogatepass"))
                top, n = best[end - 1] + BYTE_SCORE * size, count[end - 1] + size
                for start in range(max(0, end - longest), end):
                    s = get(w[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or (s == top and count[start] + 1 < n):
                            top, n = s, count[start] + 1
                best.append(top)
                count.append(n)
            out[i] = count[len(w)]
            last = w
        return out


def piece_scores(path: str) -> dict[str, float]:
    """Pieces of a vocabulary file and their scores; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(sp.id_to_piece(i), i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {p: -math.log(rank + 1) - 1 for rank, (p, _) in enumerate(pieces)}


_memory: dict[str, list] = {}


def _remember(path: str) -> list:
    if path not in _memory:
        _memory[path] = [Trie(piece_scores(path)), np.zeros(0, U), np.zeros(0, np.int64)]
    return _memory[path]


def text_counts(column: pa.Array, path: str) -> Iterator[tuple[int, int]]:
    """(words, tokens) of each text."""
    m = _remember(path)
    for t in tokens(column):
        distinct, first, inverse = np.unique(t.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(m[1], distinct)
        new = m[1][np.minimum(at, len(m[1]) - 1)] != distinct if len(m[1]) else np.ones(len(distinct), bool)
        if new.any():
            if len(m[1]) > MOST_WORDS:
                m[1], m[2], new = np.zeros(0, U), np.zeros(0, np.int64), np.ones(len(distinct), bool)
            words = [MARK + t.word(i).decode("utf-8", "replace") for i in first[new].tolist()]
            h = np.concatenate([m[1], distinct[new]])
            c = np.concatenate([m[2], np.array(m[0].counts(words), dtype=np.int64)])
            order = np.argsort(h)
            m[1], m[2] = h[order], c[order]
            at = np.searchsorted(m[1], distinct)
        each = m[2][at][inverse] if len(distinct) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        yield from zip(np.diff(t.bounds).tolist(), (total[t.bounds[1:]] - total[t.bounds[:-1]]).tolist(), strict=True)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of ``docs``, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(text_counts(b.column("text"), path))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
