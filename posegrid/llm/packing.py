"""Packing of token sequences into windows of near-equal length by multiway differencing.

Documents are encoded and cut at the window length: full windows stand alone, and the rest of each
document (under a window) is an item. Items of consecutive documents form a group of about
``GROUP_WINDOWS`` windows. In a group, Karmarkar-Karp differencing starts from one partial partition
per item, merges again and again the two with the largest spread (the fullest part of one with the
emptiest of the other), and ends with one partition into near-equal windows, as many as hold the group
at ``FILL``. A window above the capacity has its largest item cut once, where the window is full, and
the tail goes to the window with most room. When that can't hold it, or a window is above the capacity
by more than its largest item, the number of windows rises by one and the group is done again. So a
document is torn beyond its full windows only where a window overflows, at most once a window.

A group is a bounded run of a partition's rows, so nothing is shuffled and memory does not grow with
the data. Sequence ids are made from the partition and a count within it, as Spark's own
``monotonically_increasing_id`` does.

Defined cases: null or empty text is a document of the end id alone; a null ``doc_id`` is kept; repeated
rows are separate documents, whatever their ids; a text of any length is encoded whole, and its ids are
held once; other columns are not read; no rows, no pieces.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cached_bpe import encoded_documents

WINDOW = 1024
GROUP_WINDOWS = 192
#: Share of the windows' room that the fewest windows of a group are filled to.
FILL = 0.99

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], parts: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``parts`` near-equal sums, by Karmarkar-Karp multiway differencing.

    A partial partition is a rising list of its non-empty parts (sum, number, members); the other parts
    are empty. The spread of a partition, fullest less emptiest part, is its rank in the heap.
    """
    heap = [(-size, at, [(size, at, [at])]) for at, size in enumerate(sizes)]
    heapq.heapify(heap)
    stamp = len(sizes)
    while len(heap) > 1:
        more, few = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(more) < len(few):
            more, few = few, more
        if len(few) == 1:  # one part meets the emptiest
            size, _, members = few[0]
            if len(more) == parts:
                least, _, others = more.pop(0)
                size, members = size + least, others + members
            bisect.insort(more, (size, stamp, members))
        else:
            free = parts - len(more)
            # The other's fullest parts take our empty ones, its emptiest meet ours, fullest with emptiest.
            met = max(0, len(few) - free)
            merged = [(s + t, stamp + k, m + n) for k, ((s, _, m), (t, _, n)) in enumerate(zip(more[:met], reversed(few[:met])))]
            more = sorted(merged + more[met:] + few[met:])
        stamp += parts
        heapq.heappush(heap, ((more[0][0] if len(more) == parts else 0) - more[-1][0], stamp, more))
    return [m for _, _, m in heap[0][2]] if heap else []


def fitted(windows: list[list[int]], sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]] | None:
    """Windows of (item, from, to) within the capacity, at most one item cut in each that was above it; None if that can't be."""
    pieces = [[(i, 0, sizes[i]) for i in sorted(w)] for w in windows]
    room = [(sum(sizes[i] for i in w) - capacity, k) for k, w in enumerate(windows)]
    free = [r for r in room if r[0] < 0]
    heapq.heapify(free)
    for over, k in sorted((r for r in room if r[0] > 0), reverse=True):
        at = max(range(len(pieces[k])), key=lambda j: pieces[k][j][2])
        item, begin, end = pieces[k][at]
        if end <= over or not free or -free[0][0] < over:
            return None
        pieces[k][at] = (item, begin, end - over)
        left, other = heapq.heappop(free)
        pieces[other].append((item, end - over, end))
        if left + over < 0:
            heapq.heappush(free, (left + over, other))
    return pieces


def level(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """The fewest near-equal windows, as lists of (item, from, to), that hold all items."""
    parts = max(1, math.ceil(sum(sizes) / (FILL * capacity)))
    while (found := fitted(difference(sizes, parts), sizes, capacity)) is None:
        parts += 1
    return found


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int, keeps_space: bool = True, window: int = WINDOW) -> DataFrame:
    """One row per piece of ``documents`` (doc_id, text): PIECE_SCHEMA."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end = np.array([end_id], np.uint32)
        base = TaskContext.get().partitionId() << 33
        sequences = 0
        rows: list[tuple] = []
        items: list[tuple] = []  # doc_id, start, ids, doc_tokens
        held = 0

        def row(key: int | None, start: int, ids: np.ndarray, tokens: int, offset: int) -> tuple:
            return (key, start, len(ids), zlib.crc32(ids.tobytes()), tokens, base + sequences, offset)

        def flush() -> None:
            nonlocal sequences, items, held
            for members in level([len(x[2]) for x in items], window):
                offset = 0
                for i, begin, end in members:
                    key, start, ids, tokens = items[i]
                    rows.append(row(key, start + begin, ids[begin:end], tokens, offset))
                    offset += end - begin
                sequences += 1
            items, held = [], 0

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)

        for batch in batches:
            for key, short in encoded_documents(batch, tokenizer, keeps_space):
                ids = np.concatenate([short.astype("<u4"), end.astype("<u4")])
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    if len(part) == window:
                        rows.append(row(key, start, part, len(ids), 0))
                        sequences += 1
                    else:
                        items.append((key, start, part.copy(), len(ids)))
                        held += len(part)
                if held >= window * GROUP_WINDOWS:
                    flush()
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
        if items:
            flush()
        if rows:
            yield batch_of(rows)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, PIECE_SCHEMA)
