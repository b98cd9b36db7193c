"""Near-duplicate groups by 64-bit SimHash and Golay-code keys.

A fingerprint is cut into three segments of 22, 21 and 21 bits. The perfect Golay code of length 23
puts every segment within three bits of exactly one codeword; a segment at the full three bits has five
further codewords at four bits. These 1 or 6 codewords are a segment's *near* keys, the first its
*centre*: segments that differ in one bit have the centre of either among the near keys of the other,
and segments that differ in two bits share a near key.

With four differing bits over three segments, sorted by their errors, only (0,0,*), (0,1,*), (1,1,2)
and (0,2,2) occur. So two segments with at most one error each exist, or one is equal and the others
have two. The first case is found by pairs of codewords: centre keys of one fingerprint against near
keys of the other; the second by an equal segment with a shared near key. Candidates are verified in
the join itself, and each linked pair comes from one table only.

Copies are one fingerprint before any key is made, and keys are joined as equi-joins that Spark can
split, so neither a large group of copies nor a hot key gathers in a task. Keys are about 110 rows a
distinct fingerprint; a fingerprint meets about 5e-6 random others of the table in its buckets.

``similar_documents`` is the wider search that training data is thinned by: five-word shingles and a
Jaccard similarity of 0.8. A fingerprint can't find all such pairs: at that similarity about ten of its
64 bits differ, and keys that bear ten errors are too short to tell documents apart. So the Golay keys
are one source of candidates there and bands of minima over the same shingle hashes are the other; every
candidate pair is verified by the exact similarity of its shingle sets. Texts of equal words are one
text from the start. A bucket ties each member to its first, in some bands to one drawn anew for the band, and to the ``NEXT`` after it
in the order of their names: all pairs of a small bucket, and a net over a large one. Then all other pairs of a large bucket whose
members no group holds together are met, by counts that exclude only pairs which can't be similar, so no link between two
members of a bucket is lost. That last step is quadratic in the members of a bucket that stay unlinked; its memory is bound by the block. On the 10 000
documents of a test 0.97 or more of the similar pairs that are no copies are in one group.

Defined cases: text without words (or null) has fingerprint zero; a null ``doc_id`` takes part but names
no component while its group has another id; different texts under one id are rows of their own; equal rows are each returned; a
text of any length is hashed whole, shingle by shingle; other columns are not read; no rows, no result rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import forget, settle, shuffled

BITS = 4
SHINGLE_WORDS = 4
SEED = 42
#: (shift, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

#: Fixed value: a generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011


def _syndromes() -> np.ndarray:
    """Syndrome of each single bit of a 23-bit word."""
    out = np.zeros(23, np.int64)
    for bit in range(23):
        rest = 1 << bit
        for high in range(22, 10, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - 11)
        out[bit] = rest
    return out


@cache
def near_errors() -> tuple[np.ndarray, np.ndarray]:
    """For each of 2048 syndromes the error patterns (up to 6, the lightest first) that lead to a codeword within four bits, and their number."""
    from itertools import combinations

    single = _syndromes()
    patterns = np.zeros((2048, 6), np.int64)
    number = np.zeros(2048, np.int64)
    weights: dict[int, int] = {}
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = int(np.bitwise_xor.reduce(single[list(bits)])) if bits else 0
            if weight == 4 and weights[syndrome] < 3:
                continue
            weights.setdefault(syndrome, weight)
            patterns[syndrome, number[syndrome]] = sum(1 << b for b in bits)
            number[syndrome] += 1
    return patterns, number


def shingle_hashes(words: list[bytes], width: int = SHINGLE_WORDS) -> list[int]:
    """Hash of every run of ``width`` words, repeats included; of all words, if they are fewer."""
    import xxhash

    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def fingerprint(text: str | None) -> int:
    """SimHash of whole text over four-word shingles, repeats included."""
    return majority(shingle_hashes(words_of(text)))


def majority(hashes: list[int]) -> int:
    """The bits set in over half of the hashes, as a signed integer; zero for none."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], np.uint64)
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long) of every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "bits"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, bits long")


def _keyed(distinct: DataFrame) -> DataFrame:
    """Rows (side, kind, key, bits): side 0 is looked up in side 1; both sides of kinds 3 to 5 are alike.

    Kinds 0 to 2 are the pairs of segments (0,1), (0,2), (1,2); kind 3 + i has segment i equal.
    """
    # An equal segment goes with one of the others, which then has two errors.
    pairs = ((0, 1), (0, 2), (1, 2))
    mates = (1, 0, 0)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, number = near_errors()
        table = np.zeros(1 << 12, np.int64)  # syndromes of a word's upper twelve bits
        low = np.zeros(1 << 11, np.int64)
        single = _syndromes()
        for bit in range(12):
            table ^= np.where(np.arange(1 << 12) >> bit & 1, single[bit + 11], 0)
        for bit in range(11):
            low ^= np.where(np.arange(1 << 11) >> bit & 1, single[bit], 0)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                bits = whole.column("bits").slice(at, 4096).to_numpy()
                parts = [bits >> shift & ((1 << width) - 1) for shift, width in SEGMENTS]
                near, counts = [], []
                for part in parts:
                    syndrome = table[part >> 11] ^ low[part & 2047]
                    # The upper twelve bits of a codeword name it.
                    near.append((part[:, None] ^ patterns[syndrome]) >> 11)
                    counts.append(number[syndrome])
                sides, kinds, found, of = [], [], [], []

                def put(side: int, kind: int, key: np.ndarray, row: np.ndarray) -> None:
                    sides.append(np.full(len(key), side, np.int8))
                    kinds.append(np.full(len(key), kind, np.int8))
                    found.append(key)
                    of.append(bits[row])

                rows = np.arange(len(bits))
                for kind, (a, b) in enumerate(pairs):
                    put(1, kind, near[a][:, 0] << 12 | near[b][:, 0], rows)
                    grid = (np.arange(6)[None, :, None] < counts[a][:, None, None]) & (np.arange(6)[None, None, :] < counts[b][:, None, None])
                    r, i, j = np.nonzero(grid)
                    put(0, kind, near[a][r, i] << 12 | near[b][r, j], r)
                for same, mate in enumerate(mates):
                    r, i = np.nonzero(np.arange(6)[None, :] < counts[mate][:, None])
                    key = parts[same][r] << 12 | near[mate][r, i]
                    put(0, 3 + same, key, r)
                    put(1, 3 + same, key, r)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sides, kinds, found, of)], names=["side", "kind", "key", "bits"])

    # A settled table of eight bytes a row is few files, and each row becomes a hundred; a number keeps Spark from joining small parts again.
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("bits").repartition(parts, "bits")
    return dealt.mapInArrow(keys, "side byte, kind byte, key long, bits long")


def linked_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in 1 to 4 bits; a pair may repeat."""
    keys = _keyed(distinct)
    index = keys.filter("side = 1").select("kind", "key", F.col("bits").alias("a"))
    probe = keys.filter("side = 0").select(F.col("kind").alias("probe_kind"), F.col("key").alias("probe_key"), F.col("bits").alias("b"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    errors = [F.bit_count(F.shiftrightunsigned(apart, shift).bitwiseAND(F.lit((1 << width) - 1))) for shift, width in SEGMENTS]
    few = [e <= 1 for e in errors]
    kind = F.col("kind")
    # A pair belongs to the first kind that fits it.
    own = (kind == 0) & few[0] & few[1] | (kind == 1) & few[0] & few[2] & ~few[1] | (kind == 2) & few[1] & few[2] & ~few[0]
    for i in range(3):
        one, two = (errors[j] == 2 for j in range(3) if j != i)
        own = own | (kind == 3 + i) & (errors[i] == 0) & one & two
    met = (kind == F.col("probe_kind")) & (F.col("key") == F.col("probe_key"))
    return index.join(shuffled(probe), met & (F.col("a") < F.col("b")) & (F.bit_count(apart) <= BITS) & own).select("a", "b")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, bits and component_id of every document: the smallest doc_id reachable over links."""
    marked = settle(fingerprints(documents), "fingerprints")
    distinct = settle(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = settle(linked_pairs(distinct), "links")
    roots = components(links)
    named = distinct.join(shuffled(roots), distinct.bits == roots.node).groupBy("root").agg(F.min("least").alias("component"))
    linked = settle(roots.join(shuffled(named), "root").select(F.col("node").alias("bits"), "component"), "linked-fingerprints")
    classes = settle(
        distinct.join(shuffled(linked), "bits", "left").select("bits", F.coalesce("component", "least").alias("component_id")), "fingerprint-classes"
    )
    return marked.join(shuffled(classes), "bits").select("doc_id", "bits", "component_id")


#: Words of a shingle and least similarity of linked documents in the wider search.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: A band is the hash of ROWS minima; two documents of similarity 0.8 share none of BANDS in 2 of 10 000 cases.
BANDS, ROWS = 16, 4
#: Of so many bands a member is also tied to one drawn for the band.
DRAWN = 6
#: Members after it that each member of a bucket is tied to, and the size of the parts that large buckets are ordered in.
NEXT, PART = 7, 512
#: Counts of shingles by hash that members of large buckets are compared by before they are verified.
CELLS = 256
#: Up to so many names of candidates (16 bytes each) are sent to the tasks that read the texts; more are joined by a shuffle.
SENT_NODES = 500_000


def _node(words: list[bytes]) -> bytes:
    """Name of a sequence of words."""
    from hashlib import blake2b

    return blake2b(b" ".join(words), digest_size=16).digest()


def _marks(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, bits, bands): node names the sequence of words; bits and bands are of its shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        odd = np.array([xxhash.xxh64_intdigest(str(i), SEED) | 1 for i in range(BANDS * ROWS)], np.uint64)
        for batch in batches:
            nodes, bits, bands = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                hashes = shingle_hashes(words, width)
                distinct = np.unique(np.array(hashes, np.uint64))
                least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
                for some in np.array_split(distinct, len(distinct) // 4096 + 1):
                    if len(some):
                        least = np.minimum(least, (odd[:, None] * some[None, :]).min(axis=1))
                rows = least.reshape(BANDS, ROWS)
                nodes.append(_node(words))
                bits.append(majority(hashes))
                bands.append([xxhash.xxh64_intdigest(row.tobytes(), k) - 2**63 for k, row in enumerate(rows)] if hashes else [])
            columns = [batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(bits, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "bits", "bands"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(each, "doc_id long, node binary, bits long, bands array<long>")


def _shingle_sets(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the distinct shingles, as 32-bit hashes, of the nodes that ``wanted``, a written table, names."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array([_node(words_of(t.as_py())) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([nodes, batch.column("text")], names=["node", "text"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.array(shingle_hashes(words_of(t.as_py()), width), np.uint64).astype(np.uint32)).view(np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int32()))], names=["node", "shingles"])

    texts = documents.select(F.col("text").cast("string")).mapInArrow(named, "node binary, text string")
    # Copies of a text go before it is shuffled; of each a task sends one.
    one = F.first("text").alias("text")
    if wanted.count() <= SENT_NODES:
        one = texts.join(F.broadcast(wanted), "node", "left_semi").groupBy("node").agg(one)
    else:
        one = texts.groupBy("node").agg(one).join(shuffled(wanted), "node", "left_semi")
    return one.mapInArrow(sets, "node binary, shingles array<int>")


def _tied(members: DataFrame, to: str) -> DataFrame:
    """Pairs (a, b), a < b, of every key of (key, node): each node with the key's "first", with one "drawn" anew for each key, or with the ``NEXT`` after it.

    A key of many nodes is ordered in parts of about ``PART``, so none is ordered in one task.
    """
    order = F.xxhash64("key", "node") if to == "drawn" else F.col("node")
    ends = members.groupBy("key").agg(F.min_by("node", order).alias("p"), F.count("*").alias("n")).filter("n > 1")
    met = members.join(shuffled(ends), "key")
    others = F.array("p")
    if to == "next":
        part = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("n") / PART))
        over = Window.partitionBy("key", part).orderBy("node")
        met = met.withColumns({f"q{k}": F.lead("node", k).over(over) for k in range(1, NEXT + 1)})
        others = F.array(*(f"q{k}" for k in range(1, NEXT + 1)))
    pairs = met.select("node", F.explode(others).alias("q")).filter("q is not null and node <> q")
    return pairs.select(F.least("node", "q").alias("a"), F.greatest("node", "q").alias("b")).distinct()


def _similar(documents: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The written pairs (a, b) of ``pairs`` whose shingle sets have the similarity."""
    pairs = settle(pairs.distinct(), "candidate-pairs")
    wanted = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidates")
    sets = settle(_shingle_sets(documents, wanted, width), "shingle-sets")
    links = _verified(pairs, sets, similarity)
    forget(sets, pairs, wanted)
    return links


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(shuffled(sets.toDF("a", "s")), "a").join(shuffled(sets.toDF("b", "t")), "b")
    # Sets that differ in size by more than the similarity allows needn't be met.
    sizes = F.least(F.size("s"), F.size("t")) >= similarity * F.greatest(F.size("s"), F.size("t"))
    common = F.size(F.array_intersect("s", "t"))
    return settle(both.filter(sizes).filter(common >= similarity * (F.size("s") + F.size("t") - common)).select("a", "b"), "similar-pairs")


def _left(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, n, node, root): members of the buckets (keys, least, node) that have ``least`` members or more, not all in one group."""
    root = F.coalesce("root", "node").alias("root")
    members = buckets.join(shuffled(roots), "node", "left").select(F.explode("keys").alias("key"), "least", "node", root)
    of = F.xxhash64("root")
    mixed = members.groupBy("key").agg(F.count("*").alias("n"), F.max("least").alias("_least"), F.min(of).alias("_low"), F.max(of).alias("_high"))
    mixed = mixed.filter("n >= _least and _low <> _high").select("key", "n")
    return members.join(shuffled(mixed), "key").select("key", "n", "node", "root")


def _across(documents: DataFrame, left: DataFrame, width: int, similarity: float) -> DataFrame:
    """The written pairs (a, b) of all members of a bucket of ``left``, a written table, in different groups, whose shingle sets have the similarity.

    Every member meets every other one as ``CELLS`` counts of its shingles by hash, in blocks that are dealt over all tasks. The counts of
    two sets differ by no more than the sets do, so pairs with too different counts are not similar; the others are verified.
    """
    wanted = settle(left.select("node").distinct(), "candidates")
    sets = settle(_shingle_sets(documents, wanted, width), "shingle-sets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [s.values.to_numpy().view(np.uint32) for s in batch.column("shingles")]
            cells = [np.bincount(s % CELLS, minlength=CELLS).clip(max=255).astype(np.uint8).tobytes() for s in of]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(map(len, of)), pa.int32()), pa.array(cells, pa.binary())], names=["node", "size", "cells"])

    counted = sets.mapInArrow(count, "node binary, size int, cells binary")
    parts = F.ceil(F.col("n") / PART)
    own = left.withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), parts)).join(shuffled(counted), "node")
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "size", "cells")

    def meet(block: pa.Table) -> pa.Table:
        nodes, groups = (np.array(block.column(c).to_pylist(), object) for c in ("node", "root"))
        groups = np.unique(groups, return_inverse=True)[1]
        sizes = block.column("size").to_numpy().astype(np.int64)
        counts = np.frombuffer(b"".join(block.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
        mine, i, j = (block.column(c).to_numpy() for c in ("own", "i", "j"))
        # Two blocks meet each other; a block alone meets itself, each pair once.
        alone = i[0] == j[0]
        first, second = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        a, b = [], []
        for k, at in enumerate(first.tolist()):
            others = second[k + 1 :] if alone else second
            others = others[groups[others] != groups[at]]
            apart = np.abs(counts[others] - counts[at]).sum(axis=1, dtype=np.int64)
            near = others[apart * (1 + similarity) <= (sizes[others] + sizes[at]) * (1 - similarity) + 1e-6]
            a += [nodes[at]] * len(near)
            b += nodes[near].tolist()
        return pa.table({"p": pa.array(a, pa.binary()), "q": pa.array(b, pa.binary())})

    met = dealt.groupBy("key", "i", "j").applyInArrow(meet, "p binary, q binary")
    pairs = settle(met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "candidate-pairs")
    links = _verified(pairs, sets, similarity)
    forget(sets, pairs, wanted)
    return links


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The groups (node, root) that ``links`` make of those of ``roots``."""
    found = settle(components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(links)), "groups")
    forget(roots, links)
    return found


def similar_documents(documents: DataFrame, width: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id of every document, linked where shingle sets have the Jaccard similarity or more.

    ``component_id`` is the smallest doc_id reachable over found links, null if no id there is known.
    """
    marked = settle(_marks(documents, width), "marked")
    classes = marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    classes = settle(classes, "word-classes")
    prints = classes.select(F.col("bits").alias("key"), "node")
    named = prints.groupBy("key").agg(F.min("node").alias("node"), F.count("*").alias("texts"))
    distinct = settle(named.select(F.col("key").alias("bits")), "distinct-fingerprints")
    linked = settle(linked_pairs(distinct).distinct(), "linked-fingerprints")
    forget(distinct)
    end = lambda of, node: shuffled(named.select(F.col("key").alias(of), F.col("node").alias(node)))
    near = linked.join(end("a", "m"), "a").join(end("b", "n"), "b")
    banded = classes.select(F.explode("bands").alias("key"), "node")
    drawn = classes.select(F.explode(F.slice("bands", 1, DRAWN)).alias("key"), "node")
    anchored = _tied(banded, "first").union(_tied(drawn, "drawn")).union(_tied(prints, "first"))
    roots = components(_similar(documents, anchored.union(near.select(F.least("m", "n"), F.greatest("m", "n"))), width, similarity))
    roots = settle(roots, "first-groups")
    # Neighbours in a bucket that one group holds already need no verification.
    group = lambda end: shuffled(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")))
    beside = _tied(banded.union(prints), "next").join(group("a"), "a", "left").join(group("b"), "b", "left")
    apart = beside.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    roots = _joined(roots, _similar(documents, apart, width, similarity))
    # All other pairs of large buckets, and of the texts of a fingerprint and of those that it is linked to.
    several = named.filter("texts > 1").select("key")
    ends = linked.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", F.col("x.b").alias("key"))
    around = ends.join(shuffled(several), "key").select(F.col("a").alias("_of"), "key").union(ends.join(shuffled(several.toDF("a")), "a", "left_semi").select("a", "key"))
    around = around.union(around.select("_of", F.col("_of").alias("key"))).distinct()
    around = prints.join(shuffled(around), "key").select(F.array(F.xxhash64("_of", F.lit(3))).alias("keys"), F.lit(3).alias("least"), "node")
    large = classes.select(F.concat("bands", F.array("bits")).alias("keys"), F.lit(NEXT + 2).alias("least"), "node")
    left = settle(_left(large.union(around), roots), "large-buckets")
    if not left.isEmpty():
        roots = _joined(roots, _across(documents, left, width, similarity))
    forget(left, linked)
    least = classes.select("node", "least").join(shuffled(roots), "node")
    least = least.join(shuffled(least.groupBy("root").agg(F.min("least").alias("component"))), "root").select("node", "component")
    found = settle(classes.select("node", "least").join(shuffled(least), "node", "left").select("node", F.coalesce("component", "least").alias("component_id")), "text-classes")
    forget(classes, roots)
    return marked.select("doc_id", "node").join(shuffled(found), "node").select("doc_id", "component_id")
