"""Token ids in binary files of patched frame-of-reference blocks.

``write_token_files`` encodes every whole text, appends the end id to each document, deals documents to
shards by ranges of ``doc_id`` and writes each shard as files. ``read_token_files`` reads files back as
one row per document. Both stream: a task holds the ids of one file (``FILE_IDS``) at a time.

File: magic, counts, blocks, block index, document table. A block of 256 ids holds its minimum, the
bit width that its 90th percentile needs, the packed differences from the minimum, and exception
lists (position, high part) for the differences that are wider. The index holds the byte at which each
block starts, so that a reader can fetch any range of ids without unpacking what stands before it.

Defined cases: null text has only the end id; a null ``doc_id`` sorts first and is kept as null;
repeated ids stay separate documents, ordered by their texts (null first), equal rows in any order; a text of any length is
encoded whole, and the file that it ends is as long as it needs; other columns are not read; no documents, no files, no rows.
A task writes under a name of its own and renames when complete, so that a repeated or speculative
task replaces a file by an equal one.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cached_bpe import encoded_documents
from .shared import settle, shared_folder

BLOCK = 256
PERCENTILE = 90
#: A file ends with the document that brings it to this many ids.
FILE_IDS = 4_000_000
MAGIC = b"PFORTOK1"
_HEAD = struct.Struct("<8sQQQ")  # magic, documents, ids, bytes of blocks
_BLOCK_HEAD = struct.Struct("<IBHH")  # minimum, width, ids, exceptions

DOCUMENT_SCHEMA = "file string, place long, doc_id long, first long, n_tokens long, ids_crc32 long"


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of bytes, most significant bit first.

    Eight values are ``width`` bytes; up to 16 bits wide they are put together in two words of four values each.
    """
    if width > 16:
        bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(*values.shape, 4), axis=2)[:, :, 32 - width :]
        return np.packbits(bits.reshape(len(values), -1), axis=1)
    eights = values.reshape(-1, 2, 4).astype(np.uint64)
    fours = eights[:, :, 3].copy()
    for k in range(3):
        fours |= eights[:, :, k] << np.uint64(width * (3 - k))
    upper, lower = fours[:, 0], fours[:, 1]
    words = np.empty((len(fours), 2), ">u8")
    if width == 16:
        words[:, 0], words[:, 1] = upper, lower
    else:
        words[:, 0], words[:, 1] = upper >> np.uint64(64 - 4 * width), upper << np.uint64(4 * width) | lower
    return np.ascontiguousarray(words.view(np.uint8)[:, 16 - width :]).reshape(len(values), -1)


def _unpacked(rows: np.ndarray, width: int) -> np.ndarray:
    if width > 16:
        bits = np.unpackbits(rows, axis=1)[:, : BLOCK * width].reshape(len(rows), BLOCK, width)
        wide = np.zeros((len(rows), BLOCK, 32), np.uint8)
        wide[:, :, 32 - width :] = bits
        return np.packbits(wide, axis=2).view(">u4").reshape(len(rows), BLOCK).astype(np.uint32)
    held = np.zeros((len(rows) * BLOCK // 8, 16), np.uint8)
    held[:, 16 - width :] = rows.reshape(-1, width)
    words = held.view(">u8").astype(np.uint64)
    upper = words[:, 0] if width == 16 else words[:, 0] << np.uint64(64 - 4 * width) | words[:, 1] >> np.uint64(4 * width)
    out = np.empty((len(held), 2, 4), np.uint32)
    for k in range(4):
        for i, four in enumerate((upper, words[:, 1])):
            out[:, i, k] = four >> np.uint64(width * (3 - k)) & np.uint64((1 << width) - 1)
    return out.reshape(len(rows), BLOCK)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of a sequence of ids, and the byte at which each starts."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return b"", np.zeros(0, np.uint64)
    padded = np.full(blocks * BLOCK, ids[-1], np.uint32)
    padded[:n] = ids
    padded = padded.reshape(blocks, BLOCK)
    least = padded.min(axis=1)
    over = padded - least[:, None]
    bound = np.partition(over, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    widths = np.ceil(np.log2(bound.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * blocks
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        for some in np.array_split(at, -(-len(at) // 2048)):
            part = over[some]
            low = part & np.uint32((1 << width) - 1)
            rows = _packed(low, width) if width else np.zeros((len(some), 0), np.uint8)
            high = part >> np.uint32(width)
            row, place = np.nonzero(high)
            ends = np.cumsum(np.bincount(row, minlength=len(some))).tolist()
            places, outliers = place.astype("<u2").tobytes(), high[row, place].astype("<u4").tobytes()
            packed, wide, begin = rows.tobytes(), rows.shape[1], 0
            for k, (block, end, low) in enumerate(zip(some.tolist(), ends, least[some].tolist())):
                head = _BLOCK_HEAD.pack(low, width, min(BLOCK, n - block * BLOCK), end - begin)
                out[block] = head + packed[k * wide : (k + 1) * wide] + places[2 * begin : 2 * end] + outliers[4 * begin : 4 * end]
                begin = end
    starts = np.zeros(blocks, np.uint64)
    np.cumsum([len(x) for x in out[:-1]], out=starts[1:], dtype=np.uint64)
    return b"".join(out), starts


def unpack_blocks(data: bytes | memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of blocks that start at ``starts`` in ``data``."""
    heads = [_BLOCK_HEAD.unpack_from(data, s) for s in starts.tolist()]
    out = np.zeros((len(heads), BLOCK), np.uint32)
    widths = np.array([h[1] for h in heads], np.int64)
    raw = np.frombuffer(data, np.uint8)
    for width in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == width)
        for some in np.array_split(at, -(-len(at) // 2048)):
            begin = starts[some].astype(np.int64) + _BLOCK_HEAD.size
            out[some] = _unpacked(raw[begin[:, None] + np.arange(BLOCK * width // 8)], width)
    least, _, sizes, odd = (np.array(x, np.int64) for x in zip(*heads)) if heads else (np.zeros(0, np.int64),) * 4
    # Exceptions of all blocks: the block of each, its number there, and the bytes of its place and of its high part.
    block = np.repeat(np.arange(len(heads)), odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(odd) - odd, odd)
    begin = starts.astype(np.int64)[block] + _BLOCK_HEAD.size + BLOCK * widths[block] // 8
    where = raw[(begin + 2 * nth)[:, None] + np.arange(2)].view("<u2")[:, 0]
    high = raw[(begin + 2 * odd[block] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0]
    out[block, where] |= high << widths[block].astype(np.uint32)
    out += least.astype(np.uint32)[:, None]
    if not heads:
        return np.zeros(0, np.uint32)
    flat = out.reshape(-1)
    return flat[: (len(heads) - 1) * BLOCK + sizes[-1]]


def pack_file(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    lengths = np.array([len(d) for d in docs], "<u8")
    blocks, starts = pack_blocks(np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, len(docs), int(lengths.sum()), len(blocks))
    return head + blocks + starts.astype("<u8").tobytes() + ids.tobytes() + known.tobytes() + lengths.tobytes()


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids."""
    magic, n, total, size = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size + size
    starts = np.frombuffer(data, "<u8", -(-total // BLOCK), at)
    at += starts.nbytes
    ids = np.frombuffer(data, "<i8", n, at)
    known = np.frombuffer(data, np.uint8, n, at + 8 * n)
    lengths = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
    doc_ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist())]
    return doc_ids, lengths, unpack_blocks(memoryview(data)[_HEAD.size : _HEAD.size + size], starts)


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int, keeps_space: bool = False) -> DataFrame:
    """Writes ``documents`` (doc_id, text) as token files into ``folder``, a URI; returns the written manifest.

    The manifest has a row per file: name, first doc_id, documents, ids. It is a table in the shared
    folder; computing it is the one action that writes the files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        store, path = FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        task, files = TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint16)
        keys: list[int | None] = []
        docs: list[np.ndarray] = []
        size = 0

        def put() -> pa.RecordBatch:
            nonlocal keys, docs, size, files
            name = f"part-{task:06d}-{files:06d}.pfor"
            own = f"{path}/_{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(pack_file(keys, docs))
            store.move(own, f"{path}/{name}")
            row = pa.RecordBatch.from_pylist([{"file": name, "first_doc": keys[0], "documents": len(keys), "ids": size}], MANIFEST)
            keys, docs, size, files = [], [], 0, files + 1
            return row

        for batch in batches:
            for key, ids in encoded_documents(batch, tokenizer, keeps_space):
                keys.append(key)
                docs.append(np.concatenate([ids, end]))
                size += len(docs[-1])
                if size >= FILE_IDS:
                    yield put()
        if keys:
            yield put()

    MANIFEST = pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())])
    ordered = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(write, "file string, first_doc long, documents long, ids long")
    return settle(manifest, "token-manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files in ``folder``: its file, place in it, first id's place in the file, ids and checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                doc_ids, lengths, ids = unpack_file(data.as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.rpartition("/")[2]] * len(doc_ids), pa.string()),
                        pa.array(np.arange(len(doc_ids))),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["file", "place", "doc_id", "first", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)
    return files.select("path", "content").mapInArrow(read, DOCUMENT_SCHEMA)


def token_index(documents: DataFrame, tokenizer: str, end_id: int, keeps_space: bool = False) -> DataFrame:
    """Writes token files and reads them back: doc_id, start, n_tokens, ids_crc32 and the file of every document.

    ``start`` counts the ids of all documents before it in ascending ``doc_id`` order. Files hold
    ranges of ``doc_id``, so a running sum over files (a row each) places each of them.
    """
    spark = documents.sparkSession
    folder = shared_folder(spark, "token-files")
    manifest = write_token_files(documents, folder, tokenizer, end_id, keeps_space)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    found = settle(read_token_files(spark, folder), "token-index")
    files = found.groupBy("file").agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("ids"))
    before = Window.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    return found.join(files, "file").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "file")
