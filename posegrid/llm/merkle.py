"""A Merkle manifest of a data set: a tree for each part, a tree over the parts, and a proof for every row.

A node hashes the digests of up to ``arity`` consecutive children, as hex text; a last run may be shorter,
even one. Leaves of a part ascend by the row's id; the roots of the parts, in order of the part's name,
are the leaves of the tree above them.

The tree is made by time-forward processing. A node's label is (level, index), children before parents, and a
digest is a message to the parent's label. Inside a run of ``arity ** height`` consecutive leaves (at most
``RUN_LEAVES``) a heap delivers the messages in label order. Between runs Spark's shuffle is the queue's external part: each
run sends one message, its root, to the run above it, which collects a bounded number of them. So each
round divides the nodes by thousands, and two rounds reach sixteen million leaves. The reversed sweep goes through the same
runs in the opposite order: a run gets the proof suffix of its root, pops its labels backwards and delivers to every child its
siblings and its parent's suffix, down to the leaves. No task holds more than a run, no level passes the driver.

Positions come from a range sort, dealt by (part, id, digest, row), so that one id or a part with most rows is split; the
sorted rows are written, and each gets its rank from the row counts of the sorted pieces before it.

Defined cases: a null part is a part of its own, before all others, and an empty name comes next; a null id comes before all
ids and is never tampered with in the query; rows of one id are ordered by their digests, and repeated rows are leaves of their
own; a null value is written ``-``, an empty text ``0:``; one row is its own subroot, one part's subroot the root; texts of any
length are hashed whole; other columns are ignored; no rows, no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: Leaves of one run, at most.
RUN_LEAVES = 4096
#: Characters of a digest.
WIDE = 64

Node = tuple[tuple[int, int], list[bytes]]


def digest_of(run: list[bytes] | bytes) -> bytes:
    return hashlib.sha256(run if isinstance(run, bytes) else b"".join(run)).hexdigest().encode()


def height_of(arity: int) -> int:
    """Levels of a run."""
    height = 1
    while arity ** (height + 1) <= RUN_LEAVES:
        height += 1
    return height


def levels_above(n: int, arity: int, height: int) -> int:
    """Levels that a run in a tree over ``n`` nodes climbs: until one node is left, or the run's height."""
    k = 0
    while n > 1 and k < height:
        n, k = -(-n // arity), k + 1
    return k


def forward(digests: list[bytes], arity: int, levels: int) -> tuple[list[Node], bytes]:
    """The runs below every inner node in label order, and the root's digest."""
    if not levels:
        return [], digests[0]
    queue = [((1, i // arity), i % arity, d) for i, d in enumerate(digests)]
    nodes: list[Node] = []
    digest = b""
    while queue:
        label, run = queue[0][0], []
        while queue and queue[0][0] == label:
            run.append(heappop(queue)[2])
        digest = digest_of(run)
        nodes.append((label, run))
        level, index = label
        if level < levels:
            heappush(queue, ((level + 1, index // arity), index % arity, digest))
    return nodes, digest


def backward(nodes: list[Node], arity: int, above: bytes, n_leaves: int) -> list[bytes]:
    """The proof of every leaf of a run: siblings from the bottom to the top, then the proof of the run's root."""
    if not nodes:
        return [above] * n_leaves
    suffix = {nodes[-1][0]: above}
    for (level, index), run in reversed(nodes):
        own = suffix.pop((level, index))
        for slot in range(len(run)):
            suffix[level - 1, index * arity + slot] = b"".join(run[:slot] + run[slot + 1 :]) + own
    return [suffix[0, i] for i in range(n_leaves)]


def folded(digest: bytes, proof: bytes, places: list[tuple[int, int]], arity: int) -> bytes:
    """The root that a leaf's digest and its proof give; ``places`` are (index, number of leaves) of each tree on the way."""
    at = 0
    for index, n in places:
        while n > 1:
            first = index // arity * arity
            wide = WIDE * (min(arity, n - first) - 1)
            left = at + WIDE * (index - first)
            digest = digest_of(proof[at:left] + digest + proof[left : at + wide])
            at, index, n = at + wide, index // arity, -(-n // arity)
    return digest


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank``, the number of rows before each in ``order``; equal rows are split and numbered too."""
    held = df.withColumn("_row", F.monotonically_increasing_id())
    by = [*order, F.col("_row")]
    rows = held.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    rows = settle(rows, "ranked").withColumn("_piece", F.shiftright("_at", 33))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("_piece").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = pieces.select("_piece", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(starts, "_piece").withColumn("rank", F.col("_at") + F.col("_shift")).drop("_piece", "_at", "_shift")


def _runs(nodes: DataFrame, arity: int, *carried: str) -> DataFrame:
    """(tree, run, n, nodes): up to ``arity ** height`` consecutive nodes (pos, digest, carried) of a tree of ``n`` nodes."""
    width = arity ** height_of(arity)
    members = F.sort_array(F.collect_list(F.struct("pos", "digest", *carried)))
    return nodes.groupBy("tree", F.expr(f"pos div {width}").alias("run")).agg(F.first("n").alias("n"), members.alias("nodes"))


def _members(batch: pa.RecordBatch, name: str = "nodes") -> Iterator[tuple[dict, pa.StructArray]]:
    """Each row's plain columns and its nodes."""
    column = batch.column(batch.schema.get_field_index(name))
    plain = batch.drop_columns([name]).to_pylist()
    for k, row in enumerate(plain):
        yield row, column[k].values


def _digests(nodes: pa.StructArray, name: str = "digest") -> list[bytes]:
    return [d.encode() for d in nodes.field(name).to_pylist()]


def _roots(runs: DataFrame, arity: int) -> DataFrame:
    """(tree, pos, digest, n): one message of every run, its root, as a node of the round above."""
    height = height_of(arity)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, nodes in _members(batch):
                digests = _digests(nodes)
                root = forward(digests, arity, levels_above(row["n"], arity, height))[1]
                rows.append((row["tree"], row["run"], root.decode(), -(-row["n"] // arity**height)))
            yield _batch(rows, ("tree", pa.int64()), ("pos", pa.int64()), ("digest", pa.string()), ("n", pa.int64()))

    needed = F.transform("nodes", lambda node: F.struct(node["digest"].alias("digest")))
    return runs.select("tree", "run", "n", needed.alias("nodes")).mapInArrow(climb, "tree long, pos long, digest string, n long")


def _batch(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[name for name, _ in fields])


def _suffixes(runs: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """(tree, pos, above): the proof of every node of ``runs``, given that of their roots."""
    height = height_of(arity)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, nodes in _members(batch):
                digests = _digests(nodes)
                inner = forward(digests, arity, levels_above(row["n"], arity, height))[0]
                proofs = backward(inner, arity, row["above"].encode(), len(digests))
                rows = [(row["tree"], p, x.decode()) for p, x in zip(nodes.field("pos").to_pylist(), proofs)]
                yield _batch(rows, ("tree", pa.int64()), ("pos", pa.int64()), ("above", pa.string()))

    return runs.join(above, ["tree", "run"]).select("tree", "n", "nodes", "above").mapInArrow(descend, "tree long, pos long, above string")


def _climbed(nodes: DataFrame, arity: int, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """The written runs of every round, bottom up, and the roots (tree, pos, digest, n) of all trees."""
    rounds = []
    while True:
        rounds.append(settle(_runs(nodes, arity, *carried), "runs"))
        nodes, carried = settle(_roots(rounds[-1], arity), "roots"), ()
        if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
            return rounds, nodes


def manifest(leaves: DataFrame, arity: int = 2, with_proofs: bool = False) -> DataFrame:
    """Trees and proofs of ``leaves`` (part string, id long, leaf string, claim string).

    Returns (id, leaf, subroot, root, proof_sha256, folded_root, verified), where ``folded_root`` comes from the claimed
    digest and the leaf's proof; with ``with_proofs`` also ``proof``, the siblings' digests, 64 characters each.
    """
    if arity < 2:
        raise ValueError("a node has two children at least")
    height = height_of(arity)
    placed = ranked(leaves.select("part", "id", "leaf", "claim"), *(F.col(c).asc_nulls_first() for c in ("part", "id", "leaf")))
    parts = settle(placed.groupBy("part").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "parts")
    trees = settle(ranked(parts, F.col("first")).withColumnRenamed("rank", "tree"), "trees")
    own = placed.join(trees.withColumnRenamed("part", "_part"), F.col("part").eqNullSafe(F.col("_part")))
    nodes = own.select("tree", (F.col("rank") - F.col("first")).alias("pos"), F.col("leaf").alias("digest"), "n", "id", "claim")
    within, subroots = _climbed(nodes, arity, "id", "claim")

    n_trees = trees.count()
    over, root = _climbed(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(n_trees).cast("long").alias("n")), arity)

    above = root.select("tree", F.col("pos").alias("run"), F.lit("").alias("above"))
    for runs in reversed(over):
        above = _suffixes(runs, above, arity).withColumnRenamed("pos", "run")
    above = settle(above.select(F.col("run").alias("tree"), F.lit(0).cast("long").alias("run"), "above"), "suffixes")
    for runs in reversed(within[1:]):
        above = settle(_suffixes(runs, above, arity).withColumnRenamed("pos", "run"), "suffixes")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if with_proofs else [])]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), *([pa.string()] if with_proofs else [])]
        for batch in batches:
            for row, members in _members(batch):
                digests, claims = _digests(members), _digests(members, "claim")
                inner = forward(digests, arity, levels_above(row["n"], arity, height))[0]
                proofs = backward(inner, arity, row["above"].encode(), len(digests))
                rows = []
                for key, pos, leaf, claim, proof in zip(members.field("id").to_pylist(), members.field("pos").to_pylist(), digests, claims, proofs):
                    top = folded(claim, proof, [(pos, row["n"]), (row["tree"], n_trees)], arity).decode()
                    found = (key, leaf.decode(), row["subroot"], row["root"], digest_of(proof).decode(), top, top == row["root"])
                    rows.append((*found, proof.decode()) if with_proofs else found)
                yield _batch(rows, *zip(names, kinds))

    top = root.first()
    tops = subroots.select("tree", F.col("digest").alias("subroot"), F.lit(top["digest"] if top else None).cast("string").alias("root"))
    known = within[0].join(above, ["tree", "run"]).join(tops, "tree")
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return known.select("tree", "n", "nodes", "above", "subroot", "root").mapInArrow(prove, schema + (", proof string" if with_proofs else ""))


def _written(value: Column) -> Column:
    """A value under its byte count, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(_written(v) for v in values)), 256)
