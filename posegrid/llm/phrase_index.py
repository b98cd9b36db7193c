"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores every word of the training documents, whatever benchmarks come. Documents are
indexed in shards (runs of rows of a partition): a shard lays its documents one after the other on a
line of positions, with gaps that no match can cross, and holds its distinct words with the positions
each stands at. The index is a table in the shared folder; many benchmarks can be searched in it.

``search_index`` cuts items into windows (ten words in a row, or a whole shorter item). The frequency
of the test words, summed over all shards, names the rarest term of each window. In a shard the windows
all of whose terms it has start from the postings of their rarest term, less its offset; each further
term's offset-adjusted list is intersected with what is left. Exact phrases need equal places, proximity
matches allow each term up to ``slop`` positions off its place by the rarest one.

Test items are a stated query set. They are packed into blocks of about ``BLOCK_CHARS`` characters in
tasks, written to the shared folder, and sent to the shards one block at a time, so neither driver nor
tasks hold more than a block whatever the size of the benchmark; hits of blocks are put together by
document. Shuffled are term counts (a row per shard and test term), the numbers of the documents, and hits.

Defined cases: null text has no words; an item without words has no window; a null ``item_id`` is left
out of the list of items but its windows still mark words; an item_id that is repeated counts once a
document; repeated documents, whatever their ids, are judged one by one; texts of any length are read
in slices; other columns are not read; an empty benchmark leaves every document clean, no documents no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

WINDOW_WORDS = 10
SLOP = 2
#: Positions between documents; windows and slop must be shorter.
GAP = 64
#: Characters of benchmark text sent to the tasks at once; a longer item is a block of its own.
BLOCK_CHARS = 8_000_000
#: A shard of the index ends with the document that brings it to this many words.
SHARD_WORDS = 2_000_000
#: Candidate places of windows that are intersected at once.
STEP = 1 << 20
#: Characters of a text that are split at once.
SLICE_CHARS = 1 << 22

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

INDEX_SCHEMA = "shard long, doc_ids array<long>, n_words array<long>, terms array<string>, counts array<int>, postings binary"
BLOCK_SCHEMA = "block long, item_ids array<string>, words array<int>, terms array<string>, tokens binary"
HITS_SCHEMA = "shard long, place int, starts array<long>, ends array<long>, items array<string>, near array<string>"


def words(text: str | None) -> list[bytes]:
    """ASCII letters and digits in lower case, and everything beyond ASCII."""
    return _WORD.findall((text or "").encode().lower())


def _token_ids(text: str | None, known: defaultdict) -> np.ndarray:
    """The words of a whole text by their numbers in ``known``, slice by slice."""
    text, at, parts = text or "", 0, []
    while at < len(text):
        end = len(text)
        if at + SLICE_CHARS < end and (stop := _BREAK.search(text, at + SLICE_CHARS)):
            end = stop.end()
        found = words(text[at:end])
        parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _numbers() -> defaultdict:
    return defaultdict(count().__next__)


def build_index(documents: DataFrame) -> DataFrame:
    """INDEX_SCHEMA rows, one per shard, of every word of ``documents`` (doc_id, text).

    ``postings`` holds the positions of the first term, then of the second, and so on, as differences.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 33
        doc_ids: list[int | None] = []
        docs: list[np.ndarray] = []
        known, line = _numbers(), 0

        def put() -> pa.RecordBatch:
            nonlocal doc_ids, docs, known, line, shard
            lengths = np.array([len(d) for d in docs], np.int64)
            which, docs = np.concatenate(docs), []
            # Positions take four bytes unless a text is beyond them, and each array goes as soon as the next is there.
            where = np.arange(len(which), dtype=np.int32 if line < 1 << 31 else np.int64)
            where += np.repeat(GAP * np.arange(len(lengths), dtype=where.dtype), lengths)
            counts = np.bincount(which, minlength=len(known)).astype(np.int32)
            order = np.argsort(which, kind="stable")
            del which
            where = where[order]
            del order
            where[1:] -= where[:-1]
            where = where.astype(np.int32, copy=False)
            terms = pa.array(list(known), pa.binary()).cast(pa.string())
            columns = [
                pa.array([shard], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
                pa.array([counts], pa.list_(pa.int32())),
                pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, where.nbytes], np.int32)), pa.py_buffer(where)]),
            ]
            doc_ids, known, line, shard = [], _numbers(), 0, shard + 1
            return pa.RecordBatch.from_arrays(columns, schema=SHARD)

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                doc_ids.append(key)
                docs.append(_token_ids(text.as_py(), known))
                line += len(docs[-1]) + GAP
                if line >= SHARD_WORDS:
                    yield put()
        if doc_ids:
            yield put()

    SHARD = pa.schema(
        [("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())]
    )
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(shards, INDEX_SCHEMA)


def _item_blocks(benchmark: DataFrame) -> DataFrame:
    """BLOCK_SCHEMA rows: items by the numbers of their words, in blocks of bounded size."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        ids, items, known, size = [], [], _numbers(), 0

        def put() -> pa.RecordBatch:
            nonlocal ids, items, known, size, block
            row = {"block": block, "item_ids": ids, "words": [len(i) for i in items], "terms": [w.decode() for w in known], "tokens": np.concatenate(items).tobytes()}
            ids, items, known, size, block = [], [], _numbers(), 0, block + 1
            return pa.RecordBatch.from_pylist([row], BLOCK)

        for batch in batches:
            for key, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                if ids and size + len(text) > BLOCK_CHARS:
                    yield put()
                ids.append(key)
                items.append(_token_ids(text, known))
                size += len(text)
        if ids:
            yield put()

    BLOCK = pa.schema([("block", pa.int64()), ("item_ids", pa.list_(pa.string())), ("words", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("tokens", pa.binary())])
    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(blocks, BLOCK_SCHEMA)


def _with_frequency(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """Blocks with ``frequency``: how often each of their terms stands in all documents."""
    own = blocks.select("block", F.posexplode("terms").alias("at", "term"))
    pairs = index.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n"))).alias("x")).select("x.term", "x.n")
    total = pairs.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    counted = own.join(total, "term", "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("f"))
    return blocks.join(counted.select("block", F.col("f.n").alias("frequency")), "block", "left")


class Windows:
    """The windows of a block of items: where each begins in the tokens, its length, item and rarest term's offset."""

    def __init__(self, block: pa.Table, width: int):
        row = {name: block.column(name).combine_chunks()[0] for name in block.column_names}
        self.items = row["item_ids"].as_py()
        self.terms = row["terms"].values
        self.tokens = np.frombuffer(row["tokens"].as_py(), np.int32)
        lengths = np.array(row["words"].as_py(), np.int64)
        first = np.cumsum(lengths) - lengths
        each = np.where(lengths > 0, np.maximum(1, lengths - width + 1), 0)
        self.item = np.repeat(np.arange(len(lengths)), each)
        self.begin = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
        self.length = np.repeat(np.minimum(lengths, width), each)
        frequency = np.array(row["frequency"].as_py() or [], np.int64)
        self.anchor = np.zeros(len(self.begin), np.int64)
        offsets = np.arange(width)
        for at in range(0, len(self.begin), 1 << 16):
            begin, length = self.begin[at : at + (1 << 16)], self.length[at : at + (1 << 16)]
            beyond = offsets[None, :] >= length[:, None]
            places = np.where(beyond, 0, begin[:, None] + offsets)
            rare = np.where(beyond, np.iinfo(np.int64).max, frequency[self.tokens[places]])
            self.anchor[at : at + (1 << 16)] = rare.argmin(axis=1)

    def found_in(self, terms: pa.Array, counts: np.ndarray, where: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a shard: windows that stand in it, the position each begins at, and whether exactly; offset-adjusted intersection."""
        mine = pc.index_in(self.terms, value_set=terms)
        own = mine.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        token = own[self.tokens] if len(self.tokens) else np.zeros(0, np.int64)
        absent = np.concatenate([[0], np.cumsum(token < 0)])
        hopeful = np.flatnonzero(absent[self.begin + self.length] == absent[self.begin])
        none = np.zeros(0, np.int64)
        if not len(hopeful):
            return none, none, none.astype(bool)
        start = np.cumsum(counts) - counts
        # One list for all terms: a position is searched behind its term's number.
        listed = np.repeat(np.arange(len(counts)) << 32, counts)
        listed |= where
        rarest = token[self.begin[hopeful] + self.anchor[hopeful]]
        out = []
        ends = np.cumsum(counts[rarest])
        at = 0
        while at < len(hopeful):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + STEP, "right")))
            some, rare = hopeful[at:stop], rarest[at:stop]
            n = counts[rare]
            which = np.repeat(some, n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = where[np.repeat(start[rare], n) + inner] - self.anchor[which]
            exact = np.ones(len(which), bool)
            for step in range(1, int(self.length[some].max(initial=1))):
                # The offsets of a window from its rarest term on, around its end.
                offset = (self.anchor[which] + step) % self.length[which]
                live = step < self.length[which]
                term = token[self.begin[which] + offset]
                key = term << 32 | np.maximum(begin + offset, 0)
                right = np.searchsorted(listed, key)
                after = listed[np.minimum(right, len(listed) - 1)]
                same = (after == key) & (begin + offset >= 0)
                before = listed[np.maximum(right - 1, 0)]
                near = (after >> 32 == term) & (np.abs((after & 0xFFFFFFFF) - begin - offset) <= slop)
                near |= (before >> 32 == term) & (np.abs((before & 0xFFFFFFFF) - begin - offset) <= slop)
                keep = near | ~live
                exact &= same | ~live
                which, begin, exact = which[keep], begin[keep], exact[keep]
                if not len(which):
                    break
            out.append((which, begin, exact))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*out))


def _hits(index: DataFrame, block: pa.Table, width: int, slop: int) -> DataFrame:
    """HITS_SCHEMA of one block: a row per document with a near or exact window."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema) as out:
        out.write_table(block)
    sent = index.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(pa.ipc.open_stream(sent.value).read_all(), width)
        known = np.array([i is not None for i in windows.items], bool)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = {name: batch.column(name)[row] for name in batch.schema.names}
                counts = shard["counts"].values.to_numpy().astype(np.int64)
                where = np.cumsum(np.frombuffer(shard["postings"].as_buffer(), np.int32), dtype=np.int64)
                which, begin, exact = windows.found_in(shard["terms"].values, counts, where, slop)
                if not len(which):
                    continue
                n_words = shard["n_words"].values.to_numpy().astype(np.int64)
                first = np.cumsum(n_words + GAP) - n_words - GAP
                doc = np.searchsorted(first, begin + windows.anchor[which], "right") - 1
                lists: dict[str, dict[int, list[str]]] = {}
                for name, mask in (("near", known[windows.item[which]]), ("items", exact & known[windows.item[which]])):
                    pairs = np.unique(np.stack([doc[mask], windows.item[which[mask]]]), axis=1)
                    lists[name] = defaultdict(list)
                    for d, item in pairs.T.tolist():
                        lists[name][d].append(windows.items[item])
                # Gaps keep the spans of different documents apart.
                starts, stops = _runs(begin[exact], begin[exact] + windows.length[which[exact]])
                spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for d, a, b in zip((np.searchsorted(first, starts, "right") - 1).tolist(), starts.tolist(), stops.tolist()):
                    spans[d].append((a - int(first[d]), b - int(first[d])))
                rows = [
                    {
                        "shard": shard["shard"].as_py(),
                        "place": d,
                        "starts": [a for a, _ in spans.get(d, ())],
                        "ends": [b for _, b in spans.get(d, ())],
                        "items": sorted(set(lists["items"].get(d, ()))),
                        "near": sorted(set(lists["near"].get(d, ()))),
                    }
                    for d in np.unique(doc).tolist()
                ]
                yield pa.RecordBatch.from_pylist(rows, FOUND)

    FOUND = pa.schema([("shard", pa.int64()), ("place", pa.int32()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
    found = settle(index.mapInArrow(search, HITS_SCHEMA), "phrase-hits")
    sent.unpersist()
    return found


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch put together, in order."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    return begin[new], end[np.append(new[1:], len(begin)) - 1]


def _joined(hits: DataFrame) -> DataFrame:
    """Hits of all blocks by document: (shard, place, starts, ends, items, near_items)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [_runs(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(batch.column("starts"), batch.column("ends"))]
            new = {k: pa.array([r[i] for r in runs], pa.list_(pa.int64())) for i, k in enumerate(("starts", "ends"))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans")  # one list, so that both keep one order
    merged = hits.groupBy("shard", "place").agg(spans, names("items").alias("items"), names("near").alias("near_items"))
    merged = merged.select("shard", "place", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items", "near_items")
    return merged.mapInArrow(each, "shard long, place int, starts array<long>, ends array<long>, items array<string>, near_items array<string>")


def search_index(index: DataFrame, benchmark: DataFrame, slop: int = SLOP, width: int = WINDOW_WORDS) -> DataFrame:
    """Every document of a written index (doc_id, n_words) with its hits in ``benchmark`` (item_id, text).

    ``starts`` and ``ends`` are the runs of hit words, ``items`` and ``near_items`` the items (as strings)
    with windows that occur exactly and within ``slop``.
    """
    if width + slop >= GAP:
        raise ValueError(f"windows and slop must stay below the {GAP} positions between documents")
    blocks = settle(_item_blocks(benchmark), "benchmark-items")
    blocks = settle(_with_frequency(blocks, index), "benchmark-blocks")
    hits = None
    for number in [r.block for r in blocks.select("block").collect()]:  # a number per block of BLOCK_CHARS characters
        found = _hits(index, blocks.filter(F.col("block") == number).toArrow(), width, slop)
        hits = found if hits is None else hits.unionByName(found)
    documents = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d"))
    documents = documents.select("shard", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    if hits is None:
        hits = index.sparkSession.createDataFrame([], HITS_SCHEMA)
    none = F.array().cast("array<string>")
    whole = documents.join(_joined(hits), ["shard", "place"], "left")
    gone = F.array().cast("array<long>")
    return whole.select(
        "doc_id", "n_words",
        F.coalesce("starts", gone).alias("starts"), F.coalesce("ends", gone).alias("ends"),
        F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, near_items (their number), contaminated of every document."""
    hits = search_index(settle(build_index(documents), "phrase-index"), benchmark, slop)
    return hits.select(
        "doc_id",
        "n_words",
        F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.size("near_items").cast("long").alias("near_items"),
        (F.size("starts") > 0).alias("contaminated"),
    )
