"""Windows over long recordings, cut into chunks of samples: a recording of any length is many tasks.

Each operator gives the same rows as its namesake in ``series``. What a window needs from beyond its chunk comes in one of two
ways. A frame of fixed width gets a halo: the first and last rows of a chunk are copied to its neighbours. A
frame without an end (the last known value, a running count) gets what earlier chunks carry: one row a
chunk is summed up over the chunks of a series, which are fewer than its samples by ``CHUNK``.

Chunks are cut by position. With ``dense`` the index is the position (no gaps, no repeats, from zero); without it rows are
numbered first, by the counts of the chunks of the index before them, so gaps and uneven rates change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series

#: Samples of a chunk.
CHUNK = 1 << 16


def _earlier(keys) -> Window:
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _later(keys) -> Window:
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)


def _with_carried(df: DataFrame, carried: DataFrame, keys) -> DataFrame:
    """``df`` with the carried columns of its chunk; keys may be null."""
    on = [*keys, "_chunk"]
    named = carried.select(*(F.col(k).alias(f"_of_{k}") for k in on), *(c for c in carried.columns if c not in on))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_chunk") == F.col("_of__chunk")]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return df.join(named, condition).drop(*(f"_of_{k}" for k in on))


def placed(df: DataFrame, keys=("recording",), order: str = "idx", chunk: int | None = None, dense: bool = False) -> DataFrame:
    """``df`` with ``_at``, each row's position in its series, and ``_chunk``."""
    chunk = chunk or CHUNK
    if dense:
        return df.withColumn("_at", F.col(order).cast("long")).withColumn("_chunk", F.floor(F.col("_at") / chunk).cast("long"))
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))
    counts = cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order)) - 1
    numbered = _with_carried(cut.withColumn("_inside", inside), before, keys).withColumn("_at", F.col("_before") + F.col("_inside"))
    return numbered.drop("_inside", "_before").withColumn("_chunk", F.floor(F.col("_at") / chunk).cast("long"))


def with_halo(df: DataFrame, before: int, after: int, chunk: int | None = None) -> DataFrame:
    """Placed rows, those within ``before`` rows ahead of a chunk or ``after`` behind it copied there; ``_own`` marks the chunk's own."""
    chunk = chunk or CHUNK
    first = F.floor((F.col("_at") - after) / chunk).cast("long")
    last = F.floor((F.col("_at") + before) / chunk).cast("long")
    dealt = df.withColumn("_home", F.col("_chunk")).withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return dealt.withColumn("_own", F.col("_chunk") == F.col("_home")).drop("_home")


def windowed(
    df: DataFrame, run: Callable[..., DataFrame], before: int, after: int, keys=("recording",), order: str = "idx", chunk: int | None = None, dense: bool = False
) -> DataFrame:
    """``run(rows, keys=..., order=...)``, an operator whose frame spans ``before`` rows ahead and ``after`` behind, over chunks with halos."""
    dealt = with_halo(placed(df, keys, order, chunk, dense), before, after, chunk)
    return run(dealt, keys=(*keys, "_chunk"), order="_at").filter("_own").drop("_own", "_chunk", "_at")


def velocity(df: DataFrame, value: str = "v", keys=("recording",), order: str = "idx", fps: int = 100, first: float | None = None, **cut) -> DataFrame:
    def run(rows: DataFrame, keys, order: str) -> DataFrame:
        found = series.velocity(rows, value, keys, order, fps)
        return found if first is None else found.withColumn("velocity", F.when(F.col(order) == 0, F.lit(first)).otherwise(F.col("velocity")))

    return windowed(df, run, 1, 0, keys, order, **cut)


def moving_avg(df: DataFrame, window: int, stride: int = 1, value: str = "v", keys=("recording",), order: str = "idx", **cut) -> DataFrame:
    def run(rows: DataFrame, keys, order: str) -> DataFrame:
        around = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window // 2), (window - 1) // 2)
        return rows.withColumn("smooth", F.avg(value).over(around))

    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_n")
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    smooth = windowed(df, run, window // 2, (window - 1) // 2, keys, order, **cut).join(sizes, condition)
    inside = (F.col(order) >= window) & (F.col(order) < F.col("_n") - window) & ((F.col(order) - window) % stride == 0)
    return smooth.filter(inside).drop("_n", *(f"_of_{k}" for k in keys))


def running_median(df: DataFrame, kernel: int, value: str = "v", keys=("recording",), order: str = "idx", **cut) -> DataFrame:
    half = kernel // 2
    return windowed(df, lambda rows, keys, order: series.running_median(rows, kernel, value, keys, order), half, half, keys, order, **cut)


def mask_around(df: DataFrame, flag: Column, width: int = 10, value: str = "v", keys=("recording",), order: str = "idx", **cut) -> DataFrame:
    return windowed(df, lambda rows, keys, order: series.mask_around(rows, flag, width, value, keys, order), width - 1, width, keys, order, **cut)


def rising_edges(df: DataFrame, on: str = "on", keys=("recording",), order: str = "idx", **cut) -> DataFrame:
    def run(rows: DataFrame, keys, order: str) -> DataFrame:
        return rows.withColumn("_rise", F.lead(on).over(Window.partitionBy(*keys).orderBy(order)) - F.col(on) > 0)

    return windowed(df, run, 0, 1, keys, order, **cut).filter("_rise").select(*keys, F.col(order).alias("edge"))


def lagged_features(df: DataFrame, columns, lags: int, bias: bool = True, initial: bool = False, keys=("recording",), order: str = "idx", **cut) -> DataFrame:
    def run(rows: DataFrame, keys, order: str) -> DataFrame:
        over = Window.partitionBy(*keys).orderBy(order)
        return rows.withColumns({f"{c}_lag{k}": F.lag(c, k, 0.0).over(over) if k else F.col(c) for c in columns for k in range(lags, -1, -1)})

    lagged = windowed(df, run, lags, 0, keys, order, **cut)
    names = [f"{c}_lag{k}" for c in columns for k in range(lags, -1, -1)]
    if initial:
        first = df.groupBy(*keys).agg(*(F.min_by(c, order).alias(f"{c}_initial") for c in columns), F.lit(0).alias("_chunk"))
        lagged = _with_carried(lagged.withColumn("_chunk", F.lit(0)), first, keys)
    out = [F.lit(1.0).alias("bias")] if bias else []
    return lagged.select(*keys, order, *out, *([f"{c}_initial" for c in columns] if initial else []), *names)


def interpolate(df: DataFrame, value: str = "v", keys=("recording",), order: str = "idx", **cut) -> DataFrame:
    """The last and the next known sample of each chunk are carried over the chunks that have none."""
    rows = placed(df, keys, order, **cut)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("i"), F.col(value).alias("v")))
    known = rows.groupBy(*keys, "_chunk").agg(F.max(here).alias("_last"), F.min(here).alias("_first"))
    carried = known.select(
        *keys, "_chunk", F.last("_last", ignorenulls=True).over(_earlier(keys)).alias("_before"), F.first("_first", ignorenulls=True).over(_later(keys)).alias("_after")
    )
    over = Window.partitionBy(*keys, "_chunk")
    so_far = over.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    to_come = over.orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    held = _with_carried(rows.withColumns({"_l": F.last(here, ignorenulls=True).over(so_far), "_r": F.last(here, ignorenulls=True).over(to_come)}), carried, keys)
    held = held.withColumns({"_l": F.coalesce("_l", "_before"), "_r": F.coalesce("_r", "_after")})
    share = F.try_divide(F.col(order) - F.col("_l.i"), F.col("_r.i") - F.col("_l.i"))
    line = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * share
    filled = F.coalesce(F.col(value), line, F.col("_l.v"), F.col("_r.v"))
    return held.withColumn(value, filled).drop("_l", "_r", "_before", "_after", "_at", "_chunk")


def _running(rows: DataFrame, counts: dict[str, str], keys) -> DataFrame:
    """Placed rows with running sums, over the whole series, of the columns that ``counts`` names."""
    over = Window.partitionBy(*keys, "_chunk").orderBy("_at")
    sums = rows.groupBy(*keys, "_chunk").agg(*(F.sum(c).alias(f"_all_{name}") for name, c in counts.items()))
    carried = sums.select(*keys, "_chunk", *(F.coalesce(F.sum(f"_all_{name}").over(_earlier(keys)), F.lit(0)).alias(f"_from_{name}") for name in counts))
    held = _with_carried(rows.withColumns({name: F.sum(c).over(over) for name, c in counts.items()}), carried, keys)
    return held.withColumns({name: F.col(name) + F.col(f"_from_{name}") for name in counts}).drop(*(f"_from_{name}" for name in counts))


def _changes(rows: DataFrame, flags: dict[str, Column], keys, chunk: int | None) -> DataFrame:
    """Placed rows with 0 or 1 for each flag's expression over the row and the one before it."""
    dealt = with_halo(rows, 1, 0, chunk)
    return dealt.withColumns(flags).filter("_own").drop("_own")


def pulse_segments(df: DataFrame, on: str = "on", keys=("recording",), order: str = "idx", chunk: int | None = None, dense: bool = False) -> DataFrame:
    """A run has the number of changes up to it, so its parts in several chunks come together by that number."""
    over = Window.partitionBy(*keys, "_chunk").orderBy("_at")
    changed = _changes(placed(df, keys, order, chunk, dense), {"_c": (F.col(on) != F.lag(on, 1, 0).over(over)).cast("int")}, keys, chunk)
    runs = _running(changed, {"_run": "_c"}, keys).filter(F.col(on) == 1)
    found = runs.groupBy(*keys, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"))
    counts = runs.groupBy(*keys).agg(F.countDistinct("_run").alias("pulses"), F.lit(0).alias("_chunk"))
    # The first change opens the first pulse, so pulses have the odd numbers of changes.
    numbered = _with_carried(found.withColumn("_chunk", F.lit(0)), counts, keys)
    return numbered.select(*keys, "start", "end", F.expr("(_run + 1) div 2").cast("int").alias("number"), "pulses")


def bipolar_to_level(df: DataFrame, threshold: float, up: str = "up", down: str = "down", keys=("recording",), order: str = "idx", chunk: int | None = None, dense: bool = False) -> DataFrame:
    over = Window.partitionBy(*keys, "_chunk").orderBy("_at")
    crossing = lambda c: F.coalesce((F.col(c) > threshold) != F.lag(F.col(c) > threshold).over(over), F.lit(False)).cast("int")
    counted = _changes(placed(df, keys, order, chunk, dense), {"_o": crossing(up), "_c": crossing(down)}, keys, chunk)
    level = _running(counted, {"_opened": "_o", "_closed": "_c"}, keys)
    return level.withColumn("on", (F.col("_opened") > F.col("_closed")).cast("int")).drop("_o", "_c", "_opened", "_closed", "_at", "_chunk")


def gaps(events: DataFrame, time: str = "edge", keys=("recording",), chunk: int | None = None) -> DataFrame:
    """``events`` with ``gap``, the time since the event before, null for the first of a series."""
    rows = events.withColumn("_chunk", F.floor(F.col(time) / (chunk or CHUNK)).cast("long"))
    latest = rows.groupBy(*keys, "_chunk").agg(F.max(time).alias("_latest"))
    carried = latest.select(*keys, "_chunk", F.max("_latest").over(_earlier(keys)).alias("_before"))
    inside = F.lag(time).over(Window.partitionBy(*keys, "_chunk").orderBy(time))
    held = _with_carried(rows.withColumn("_inside", inside), carried, keys)
    return held.withColumn("gap", F.col(time) - F.coalesce("_inside", "_before")).drop("_inside", "_before", "_chunk")
