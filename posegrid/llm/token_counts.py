"""Piece counts under a unigram vocabulary, without the pieces.

A text is cut before each run of word marks (white space spelled as U+2581), as no piece of the
vocabulary has a mark after another character. In each part an Aho-Corasick automaton names every vocabulary piece that
ends at a place, and dynamic programming keeps, per place, the best score and the number of pieces of
the path that has it. No path is traced back.

Ties are those of the unigram tokenizer: places are left from left to right, pieces tried from short to
long, and a later path replaces an earlier one only with a better score. A character that is no piece
costs the least score less ten; with byte fallback it counts as its UTF-8 bytes, else runs of such
characters count as one.

No public unigram file is at hand and tokenizers are never trained here, so the pieces of a public file
that ranks them by merges get the scores of Zipf's law: ``log(1 / (rank + ZIPF_SHIFT))``, normalised, a
rule without a fit. ``unigram_model`` gives the same vocabulary in the form of the tokenizers library,
whose counts these are, text by text.

Counts of parts are kept in a bounded dictionary, as parts repeat. Defined cases: null and empty text
have no pieces; a null ``doc_id`` is kept; repeated rows are each returned, whatever their ids; a text of
any length is counted part by part, a part of any length in memory of its size; other columns are not
read; no rows, no result rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_PARTS = 400_000

_PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


#: Of the Zipf-Mandelbrot law.
ZIPF_SHIFT = 2.7


def unigram_vocabulary(path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece file in the order of their ranks, with log-probabilities by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    pieces = [model.id_to_piece(i) for i in ordinary]
    total = math.log(math.fsum(1 / (rank + ZIPF_SHIFT) for rank in range(1, len(pieces) + 1)))
    return {piece: -math.log(rank + ZIPF_SHIFT) - total for rank, piece in enumerate(pieces, 1)}


def unigram_model(vocabulary: dict[str, float], byte_fallback: bool = True):
    """The vocabulary as a tokenizer of the tokenizers library."""
    from tokenizers import Tokenizer, models, normalizers

    own = [("<unk>", 0.0), *vocabulary.items(), *((f"<0x{b:02X}>", -1e9) for b in range(256) if byte_fallback)]
    out = Tokenizer(models.Unigram(own, unk_id=0, byte_fallback=byte_fallback))
    out.normalizer = normalizers.Sequence([normalizers.Prepend(MARK), normalizers.Replace(" ", MARK)])
    return out


class PieceCounter:
    def __init__(self, vocabulary: dict[str, float], byte_fallback: bool = True):
        import ahocorasick

        if any(MARK in piece.lstrip(MARK) for piece in vocabulary):
            raise ValueError("a piece has a word mark after another character")
        self._automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._single = {p for p in vocabulary if len(p) == 1}
        self._unknown = min(vocabulary.values(), default=0.0) - UNKNOWN_PENALTY
        self._bytes = byte_fallback
        self._known: dict[str, int] = {}

    def part(self, text: str) -> int:
        """Pieces of the best segmentation of one part."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self._automaton.iter(text):
            ends[end].append(piece)
        best = [0.0] + [float("-inf")] * n
        count = [0] * (n + 1)
        lone = [False] * (n + 1)  # the path ends with an unknown character
        for at in range(n):
            char, end = text[at], at + 1
            # The automaton gives longer pieces first; from left to right is the longest first too,
            # and an equal score keeps the path that starts earliest.
            found = ends[at]
            if len(found) > 1:
                found = sorted(found, reverse=True)
            for length, score in found:
                start = end - length
                if best[start] + score > best[end]:
                    best[end], count[end], lone[end] = best[start] + score, count[start] + 1, False
            if char not in self._single and best[at] + self._unknown > best[end]:
                best[end] = best[at] + self._unknown
                count[end] = count[at] + (len(char.encode()) if self._bytes else 0 if lone[at] else 1)
                lone[end] = True
        return count[n]

    def count(self, text: str | None) -> int:
        """Pieces of a whole text, with the word mark that stands before it."""
        if not text:
            return 0
        total, known = 0, self._known
        for part in _PART.findall(MARK + text.replace(" ", MARK)):
            if (n := known.get(part)) is None:
                n = self.part(part)
                if len(part) < 64:
                    if len(known) >= CACHE_PARTS:
                        known.clear()
                    known[part] = n
            total += n
        return total


_loaded: dict[tuple, PieceCounter] = {}


def count_pieces(documents: DataFrame, model: str, byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_pieces) of every whole text under the pieces of ``model`` and their unigram scores."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model, byte_fallback) not in _loaded:
            _loaded[model, byte_fallback] = PieceCounter(unigram_vocabulary(model), byte_fallback)
        counter = _loaded[model, byte_fallback]
        for batch in batches:
            found = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "n_pieces"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, n_pieces long")
