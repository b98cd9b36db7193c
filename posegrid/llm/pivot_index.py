"""Exact top-k search by inner product over an index of pivots and distances.

A component x becomes floor(scale * x), and scores are integer inner products. A further component lifts every vector
to the norm of the longest one, so the largest product is the smallest distance (a query is scaled to the
same norm, its own further component is zero). A vector's key is (nearest pivot, distance to it). A range
sort by key deals the rows to tasks, so that copies of one vector are split too; each task cuts its rows into annuli of one
pivot, which are written with their inner and outer radius.

Queries are packed in groups of neighbours, and a search has two rounds. The first reads the annulus nearest to each of
a group's own pivots, which gives each query a k-th best distance. The second joins groups to the
annuli that this distance can reach around any pivot, deals them out in slices of bounded size, and each task expands its
slice from the nearest annulus on: by the triangle inequality no vector of an annulus is nearer to the query than its distance from the annulus, so an
annulus is passed over by queries that have k better ones, and the task stops when that holds for all. A bound is widened by a
millionth of the norm against rounding. Every annulus that no bound excludes is read, so the result is exact.

Only the pivots are fitted on a sample: ``SAMPLE`` rows, those with the least hash of their row number. They go to tasks by value and are
bounded by ``PIVOTS`` vectors; a group, an annulus and a slice are bounded by their sizes below. No pair of rows is
ever a row of a table: a query gives at most k rows for each slice.

Defined cases: vectors that are null or hold null, non-finite or greater components than ``LARGEST`` take no part; shorter vectors are
filled with zeros; a null id is never a query, and as a partner comes after all others of its score; repeated ids are rows of
their own, each a partner of the other; a zero vector scores zero with all; scores saturate at the range of a long; with
fewer than k other rows all are given; no rows or no queries, no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

PIVOTS, SAMPLE, LLOYD_STEPS = 64, 2048, 5
#: Numbers of a packed group of queries and of an annulus, and the fewest rows of each.
GROUP_NUMBERS, GROUP_ROWS, RING_NUMBERS, RING_ROWS = 1 << 16, 256, 1 << 14, 64
#: Annuli of a slice, on average.
SLICE_RINGS = 64
LARGEST = 1e100
NEVER = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


class Space:
    """What all tasks know of the table: its norm, width, number type and pivots."""

    def __init__(self, norm2: float, width: int, pivots: np.ndarray | None = None):
        self.norm, self.width = sqrt(norm2), width
        # Inner products and their partial sums stay below the squared norm, so these types hold them exactly.
        self.kind = np.dtype("<f4" if norm2 < 1 << 24 else "<f8")
        self.exact = norm2 < 1 << 53
        self.slack = 1e-6 * self.norm
        self.pivots = pivots

    def rows(self, vectors: pa.Array) -> np.ndarray:
        """A matrix of vectors, filled with zeros."""
        lengths = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(lengths), self.width))
        out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        return out

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([rows, np.sqrt(np.maximum(self.norm**2 - (rows**2).sum(1), 0))])

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        norms = np.sqrt((rows**2).sum(1, keepdims=True))
        return np.column_stack([rows * np.divide(self.norm, norms, out=np.zeros_like(norms), where=norms > 0), np.zeros(len(rows))])

    def to_pivots(self, points: np.ndarray) -> np.ndarray:
        squares = (points**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def products(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self.exact:
            return np.rint(left @ right.T).astype(np.int64)
        whole = [[[int(x) for x in row] for row in side] for side in (left.tolist(), right.tolist())]
        found = np.array(whole[0], object) @ np.array(whole[1], object).T
        return np.clip(found, NEVER + 1, NO_ID).astype(np.int64)

    def reach(self, scores: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The distance at which a query has this score."""
        if not self.exact:
            return np.full(len(scores), np.inf)
        share = np.divide(self.norm, norms, out=np.zeros_like(norms), where=norms > 0)
        far = np.sqrt(np.maximum(2 * self.norm**2 - 2 * share * scores, 0))
        return np.where(norms > 0, far, self.norm) + self.slack


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Written rows (key, id, v, norm2) of the vectors that take part, under row numbers."""
    sound = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < LARGEST))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)) + 0.0
            lengths = np.diff(lists.offsets.to_numpy())
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            norms = np.bincount(np.repeat(np.arange(len(lengths)), lengths), flat**2, len(lengths))
            v = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id"), v, pa.array(norms)], names=["id", "v", "norm2"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(sound)
    whole = rows.mapInArrow(floors, "id long, v array<double>, norm2 double")
    return settle(whole.withColumn("key", F.monotonically_increasing_id()), "vectors")


def fit_pivots(table: DataFrame, space: Space) -> np.ndarray:
    """At most ``PIVOTS`` centres of the sample, by Lloyd's steps from its first different rows."""
    found = table.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").collect()
    rows = np.zeros((len(found), space.width))
    for i, r in enumerate(found):
        rows[i, : len(r.v)] = r.v
    _, first = np.unique(rows, axis=0, return_index=True)
    points = space.lifted(rows[np.sort(first)])
    space.pivots = points[:PIVOTS]
    for _ in range(LLOYD_STEPS):
        nearest = space.to_pivots(points).argmin(1)
        space.pivots = np.array([points[nearest == p].mean(0) for p in np.unique(nearest)])
    return space.pivots


def _placed(rows: DataFrame, space: Space, as_query: bool) -> DataFrame:
    """``rows`` (key, id, v) with their nearest pivot and the distance to it, in that order over all tasks."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = space.rows(batch.column("v"))
            far = space.to_pivots(space.scaled(points) if as_query else space.lifted(points))
            columns = [*batch.columns, pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1) if len(far) else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "pivot", "distance"])

    by = ["pivot", "distance", "key"]
    placed = rows.select("key", "id", "v").mapInArrow(place, "key long, id long, v array<double>, pivot int, distance double")
    return placed.repartitionByRange(*by).sortWithinPartitions(*by)


def _packs(batches: Iterator[pa.RecordBatch], most: int, by_pivot: bool) -> Iterator[pa.Table]:
    """Consecutive rows, ``most`` at a time, of one pivot only if asked for."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        pivots = batch.column("pivot").to_numpy()
        at = 0
        while at < len(pivots):
            if held and by_pivot and held[0].column("pivot")[0].as_py() != pivots[at]:
                yield pa.Table.from_batches(held)
                held = []
            room = most - sum(b.num_rows for b in held)
            end = min(at + room, len(pivots))
            if by_pivot:
                end = at + int(np.searchsorted(pivots[at:end], pivots[at], "right"))
            held.append(batch.slice(at, end - at))
            if end - at == room:
                yield pa.Table.from_batches(held)
                held = []
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _packed(pack: pa.Table, space: Space) -> tuple:
    """(keys, ids, missing, vectors) of a pack as bytes."""
    pack = pack.combine_chunks()
    ids = pack.column("id").combine_chunks()
    vectors = space.rows(pack.column("v").combine_chunks())
    plain = pack.column("key").to_numpy().astype("<i8").tobytes(), ids.fill_null(NO_ID).to_numpy().astype("<i8").tobytes()
    return *plain, ids.is_null().to_numpy(zero_copy_only=False).tobytes(), vectors.astype(space.kind).tobytes()


PACK = [("keys", pa.binary()), ("ids", pa.binary()), ("missing", pa.binary()), ("vectors", pa.binary())]
PACK_SCHEMA = "keys binary, ids binary, missing binary, vectors binary"


def build_index(table: DataFrame, space: Space) -> DataFrame:
    """Written annuli (ring, pivot, low, high, keys, ids, missing, vectors): every row is in one."""
    most = max(RING_ROWS, RING_NUMBERS // max(space.width, 1))
    schema = pa.schema([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), *PACK])

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches, most, True):
            far = pack.column("distance").to_numpy()
            row = (pack.column("pivot")[0].as_py(), far[0], far[-1], *_packed(pack, space))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    found = _placed(table, space, False).mapInArrow(rings, f"pivot int, low double, high double, {PACK_SCHEMA}")
    return settle(found.withColumn("ring", F.monotonically_increasing_id()), "rings")


def pack_queries(rows: DataFrame, space: Space) -> DataFrame:
    """Written groups (group, own, keys, ids, missing, vectors, far): ``own`` their pivots and mean distances, ``far`` all distances."""
    most = max(GROUP_ROWS, GROUP_NUMBERS // max(space.width, 1))
    own_type = pa.list_(pa.struct([("pivot", pa.int32()), ("distance", pa.float64())]))
    schema = pa.schema([("own", own_type), *PACK, ("far", pa.binary())])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches, most, False):
            far = space.to_pivots(space.scaled(space.rows(pack.column("v").combine_chunks())))
            pivots, distances = pack.column("pivot").to_numpy(), pack.column("distance").to_numpy()
            own = [{"pivot": int(p), "distance": float(distances[pivots == p].mean())} for p in np.unique(pivots)]
            row = (own, *_packed(pack, space), far.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    found = _placed(rows, space, True).mapInArrow(groups, f"own array<struct<pivot:int,distance:double>>, {PACK_SCHEMA}, far binary")
    return settle(found.withColumn("group", F.monotonically_increasing_id()), "groups")


FOUND = pa.schema([(c, pa.int64()) for c in ("group", "place", "query", "query_id", "vec_id", "score")])


class Best:
    """The k best partners so far of each query of a group."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.place = np.zeros(0, np.int64)
        self.score, self.id, self.gone = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.bar, self.bar_id = np.full(n, NEVER), np.full(n, NO_ID)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray, gone: np.ndarray) -> None:
        place, score, ids, gone = (np.concatenate(x) for x in ((self.place, place), (self.score, score), (self.id, ids), (self.gone, gone)))
        order = np.lexsort((ids, gone, -score, place))
        nth = np.arange(len(order)) - np.searchsorted(place[order], place[order])
        order, nth = order[nth < self.k], nth[nth < self.k]
        self.place, self.score, self.id, self.gone = place[order], score[order], ids[order], gone[order]
        last = nth == self.k - 1
        higher = self.score[last] >= self.bar[self.place[last]]
        at = self.place[last][higher]
        self.bar[at], self.bar_id[at] = self.score[last][higher], self.id[last][higher]


def _search(queries: DataFrame, pairs: DataFrame, space: Space, k: int) -> DataFrame:
    """FOUND rows: the partners in the annuli of ``pairs`` (group, slice, pivot, low, high, pack) that ``queries`` (group, slice, pack, far, bars) lack."""

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        mine = left.to_pylist()[0]
        keys, ids = np.frombuffer(mine["keys"], "<i8"), np.frombuffer(mine["ids"], "<i8")
        vectors = np.frombuffer(mine["vectors"], space.kind).reshape(len(keys), space.width)
        far = np.frombuffer(mine["far"], "<f8").reshape(len(keys), -1)
        norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
        best = Best(len(keys), k)
        for bar in mine["bars"] or []:
            best.bar[bar["place"]], best.bar_id[bar["place"]] = bar["score"], NO_ID if bar["id"] is None else bar["id"]

        pivots, low, high = (right.column(c).to_numpy() for c in ("pivot", "low", "high"))
        to_ring = np.maximum(np.maximum(low - far[:, pivots], far[:, pivots] - high), 0)
        for r in np.argsort(to_ring.min(0), kind="stable"):
            reach = np.where(best.bar == NEVER, np.inf, space.reach(best.bar, norms))
            if to_ring[:, r].min() > reach.max():
                break
            near = np.flatnonzero(to_ring[:, r] <= reach)
            if not len(near):
                continue
            ring = {c: right.column(c)[int(r)].as_py() for c in ("keys", "ids", "missing", "vectors")}
            ring_keys, ring_ids = np.frombuffer(ring["keys"], "<i8"), np.frombuffer(ring["ids"], "<i8")
            gone = np.frombuffer(ring["missing"], bool)
            scores = space.products(vectors[near], np.frombuffer(ring["vectors"], space.kind).reshape(len(ring_keys), space.width))
            scores[keys[near][:, None] == ring_keys] = NEVER
            bar = best.bar[near][:, None]
            good = (scores > bar) | ((scores == bar) & (ring_ids <= best.bar_id[near][:, None]))
            if len(ring_keys) > k:
                good &= scores >= np.partition(scores, -k, axis=1)[:, [-k]]
            at, column = np.nonzero(good & (scores > NEVER))
            if len(at):
                best.add(near[at], scores[at, column], ring_ids[column], gone[column])
        n = len(best.place)
        partner = pa.array(best.id, mask=best.gone)
        return pa.Table.from_arrays(
            [pa.array(np.full(n, mine["group"])), pa.array(best.place), pa.array(keys[best.place]), pa.array(ids[best.place]), partner, pa.array(best.score)],
            schema=FOUND,
        )

    by = ["group", "slice"]
    schema = ", ".join(f"`{f.name}` long" for f in FOUND)
    return queries.groupBy(*by).cogroup(pairs.groupBy(*by)).applyInArrow(expand, schema)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _reached(groups: DataFrame, space: Space) -> DataFrame:
    """(group, pivot, from, to, seeds): around each pivot, what the queries of a group can reach."""
    schema = pa.schema([("group", pa.int64()), ("pivot", pa.int32()), ("from", pa.float64()), ("to", pa.float64()), ("seeds", pa.list_(pa.int64()))])

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["keys"]) // 8
                far = np.frombuffer(row["far"], "<f8").reshape(n, -1)
                vectors = np.frombuffer(row["vectors"], space.kind).reshape(n, space.width)
                reach = np.full(n, np.inf)
                bars = row["bars"] or []
                places = np.array([b["place"] for b in bars], np.int64)
                norms = np.sqrt((vectors[places].astype(float) ** 2).sum(1))
                reach[places] = space.reach(np.array([b["score"] for b in bars], np.int64), norms)
                m = far.shape[1]
                columns = [[row["group"]] * m, range(m), (far - reach[:, None]).min(0), (far + reach[:, None]).max(0), [row["seeds"]] * m]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return groups.mapInArrow(intervals, "`group` long, pivot int, `from` double, `to` double, seeds array<long>")


def search(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every row that ``is_query`` holds for.

    ``is_query`` speaks of the column ``id``, which is ``key``.
    """
    table = quantised(vectors, key, vector, scale)
    norm2, width = table.agg(F.max("norm2"), F.max(F.size("v"))).first()
    names = ["query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"]
    if norm2 is None:
        empty = ", ".join(f"`{f.name}` long" for f in FOUND)
        return vectors.sparkSession.createDataFrame([], f"{empty}, rank int").select(*names)
    space = Space(norm2, width)
    space.pivots = fit_pivots(table, space)
    rings = build_index(table, space)
    groups = pack_queries(table.filter(is_query), space)
    radii = rings.select("ring", "pivot", "low", "high")

    # The nearest annulus around each of a group's own pivots.
    own = groups.select("group", F.inline("own"))
    apart = F.abs((F.col("low") + F.col("high")) / 2 - F.col("distance"))
    nearest = own.join(radii, "pivot").groupBy("group", "pivot").agg(F.min(F.struct(apart, "ring")).getField("ring").alias("ring"))
    seeds = settle(nearest.select("group", "ring", F.lit(0).alias("slice")), "seeds")
    no_bars = F.lit(None).cast("array<struct<place:bigint,score:bigint,id:bigint>>").alias("bars")
    started = groups.select("group", F.lit(0).alias("slice"), "keys", "ids", "vectors", "far", no_bars)
    first = settle(_top(_search(started, seeds.join(rings, "ring"), space, k), k), "first-found")

    bars = first.filter(F.col("rank") == k).groupBy("group").agg(F.collect_list(F.struct("place", "score", F.col("vec_id").alias("id"))).alias("bars"))
    told = groups.join(bars, "group", "left").join(seeds.groupBy("group").agg(F.collect_list("ring").alias("seeds")), "group", "left")
    told = settle(told.drop("own", "missing"), "told")
    slices = -(-radii.count() // SLICE_RINGS)
    near = _reached(told.drop("ids"), space).join(radii, "pivot").filter("high >= `from` and low <= `to` and not array_contains(seeds, ring)")
    dealt = near.select("group", "ring", F.pmod(F.xxhash64("ring"), F.lit(slices)).cast("int").alias("slice"))
    sent = told.drop("seeds").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    second = _search(sent, dealt.join(rings, "ring"), space, k)
    return _top(first.drop("rank").union(second), k).select(*names)
