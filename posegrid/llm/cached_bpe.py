"""Whole-text encoding with a public BPE tokenizer through a bounded cache of pre-tokens.

A BPE vocabulary first cuts a text into pre-tokens and merges within them, so the ids of a text are the
ids of its pre-tokens one after the other. Pre-tokens repeat, and a dictionary look-up is far cheaper
than an encoder call; those that the cache lacks are given to the tokenizers library, many at a time.
A word with characters beyond Latin-1 needs the library's Unicode tables and goes to it as a whole, and
so does a text that may spell a special token, which the library then gives its special id.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np

#: Entries in each of the two generations of the cache.
CACHE_ENTRIES = 250_000
#: Code points handled at once; bounds the lists of pre-tokens that live at the same time.
SLICE_CHARS = 2_000_000

# The pre-token patterns of the two vocabularies, with the letter and number classes
# written out for Latin-1. NUL stands between texts.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACED = re.compile(rf" ?[{_LETTER}]+|{_ENDINGS}| ?[{_NUMBER}]+| ?[^\0\s{_LETTER}{_NUMBER}]+|\s+(?![^\s\0])|\s+|\0")
_UNSPACED = re.compile(rf"[{_LETTER}]+|{_ENDINGS}|[{_NUMBER}]|[^\0\s{_LETTER}{_NUMBER}]+|\0")

# NUL is kept for our own use; Python counts the four separators as white space, the library does not.
# The special tokens of both vocabularies begin with "<|".
_ODD = ("\0", "\x1c", "\x1d", "\x1e", "\x1f", "<|")
_SPACED_WORD = re.compile(r"\s*\S+|\s+")

#: Stands between texts and pre-tokens in id sequences; beyond every id.
_GAP = b"\xff\xff"


def _odd(text: str) -> bool:
    """Substring searches, which are many times faster than a pattern."""
    return any(x in text for x in _ODD)


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class CachedBpe:
    """``keeps_space``: the vocabulary spells white space and case; else both are dropped."""

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        if self._whole.get_vocab_size() > 0xFF00:
            raise ValueError("ids and the gap mark are held as 16-bit integers")
        self._merges = Tokenizer(self._whole.model)
        self._merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._letters = _byte_letters()
        self._gap_letter = self._letters[0]
        self._gap_ids = self._merges.encode(self._gap_letter, add_special_tokens=False).ids
        self._keeps_space = keeps_space
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _merged(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens, by the library's merge model; one call for all, a gap letter between them."""
        if not parts:
            return []
        spelled = "\0".join(parts).encode().decode("latin-1").translate(self._letters)
        gap = self._gap_letter
        ids = self._merges.encode_batch_fast([spelled.replace(gap, f" {gap} ")], add_special_tokens=False)[0].ids
        ids = np.array(ids, np.uint16)
        ids[ids == self._gap_ids[0]] = 0xFFFF
        return ids.tobytes().split(_GAP)

    def _pieces(self, texts: list[str]) -> list[str]:
        """The pre-tokens of texts, with NUL between texts; a word beyond Latin-1 is one piece."""
        find = (_SPACED if self._keeps_space else _UNSPACED).findall
        if all(map(_latin, texts)) and not any(map(_odd, texts)):
            joined = "\0".join(texts)
            return find(joined if self._keeps_space else joined.lower())
        pieces: list[str] = []
        for i, text in enumerate(texts):
            if i:
                pieces.append("\0")
            if _odd(text):
                pieces.append("\0" + text)
            elif _latin(text):
                pieces += find(text if self._keeps_space else text.lower())
            else:
                for word in _SPACED_WORD.findall(text) if self._keeps_space else text.split():
                    if _latin(word):
                        pieces += find(word if self._keeps_space else word.lower())
                    else:
                        pieces.append("\0" + word)
        return pieces

    def _slice(self, texts: list[str]) -> list[bytes]:
        pieces = self._pieces(texts)
        ids: dict[str, bytes] = {}
        parts, words = [], []
        new, old = self._new, self._old
        for piece in set(pieces):
            if (found := new.get(piece)) is not None:
                ids[piece] = found
            elif (found := old.get(piece)) is not None:
                ids[piece] = new[piece] = found
            elif piece[0] == "\0":
                words.append(piece)
            else:
                parts.append(piece)
        learnt = dict(zip(parts, self._merged(parts)))
        if "\0" in words:
            words.remove("\0")
        for word, found in zip(words, self._whole.encode_batch_fast([w[1:] for w in words], add_special_tokens=False)):
            learnt[word] = np.array(found.ids, np.uint16).tobytes()
        ids |= learnt
        ids["\0"] = _GAP
        new.update(x for x in learnt.items() if len(x[0]) < 64)
        if len(new) > CACHE_ENTRIES:
            self._old, self._new = new, {}
        return b"".join(map(ids.__getitem__, pieces)).split(_GAP)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids (16-bit) of every text in order; none for null."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE_CHARS):
                size += len(texts[end] or "")
                end += 1
            gc.disable()  # the lists of a slice hold no cycles, and collecting over them takes a third of the time
            try:
                found = self._slice([t or "" for t in texts[at:end]])
            finally:
                gc.enable()
            for ids in found:
                yield np.frombuffer(ids, np.uint16)
            at = end


def encoded_documents(batch, path: str, keeps_space: bool) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the rows of an Arrow batch, of which few are Python objects at a time."""
    encoder = cached_bpe(path, keeps_space)
    for at in range(0, batch.num_rows, 1024):
        part = batch.slice(at, 1024)
        yield from zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()))


_loaded: dict[tuple[str, bool], CachedBpe] = {}


def cached_bpe(path: str, keeps_space: bool) -> CachedBpe:
    """One encoder a Python worker and vocabulary."""
    if (path, keeps_space) not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path, keeps_space] = CachedBpe(path, keeps_space)
    return _loaded[path, keeps_space]
