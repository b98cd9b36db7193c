"""Window operators on value series: a row per sample, keyed by series and ordered by an index.

Series are windowed by key; a recording is one series, as long as its camera ran. Statistics over a whole
series are aggregated and joined back instead of windowed, so they never hold a series in a task.
Missing values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys, order):
    return Window.partitionBy(*keys).orderBy(order)


def velocity(df: DataFrame, value: str = "v", keys=("recording",), order: str = "idx", fps: int = 100, first: float | None = None) -> DataFrame:
    """Absolute difference from the sample before, per second; the first is null or a given value."""
    step = F.abs(F.col(value) - F.lag(value).over(_over(keys, order))) * fps
    if first is not None:
        step = F.when(F.row_number().over(_over(keys, order)) == 1, F.lit(first)).otherwise(step)
    return df.withColumn("velocity", step)


def moving_avg(df: DataFrame, window: int, stride: int = 1, value: str = "v", keys=("recording",), order: str = "idx") -> DataFrame:
    """Centred moving average; ``window`` samples go at both ends, then every ``stride``-th sample stays."""
    around = _over(keys, order).rowsBetween(-(window // 2), (window - 1) // 2)
    n = F.count("*").over(Window.partitionBy(*keys))
    smooth = df.withColumns({"smooth": F.avg(value).over(around), "_n": n})
    inside = (F.col(order) >= window) & (F.col(order) < F.col("_n") - window)
    return smooth.filter(inside & ((F.col(order) - window) % stride == 0)).drop("_n")


def running_median(df: DataFrame, kernel: int, value: str = "v", keys=("recording",), order: str = "idx") -> DataFrame:
    """Median of ``kernel`` samples around each; zeros stand beyond the ends."""
    half = kernel // 2
    around = _over(keys, order).rowsBetween(-half, half)
    found = F.collect_list(value).over(around)
    zeros = F.array_repeat(F.lit(0.0), F.lit(kernel) - F.size("_w"))
    held = df.withColumn("_w", found)
    return held.withColumn("median", F.get(F.sort_array(F.concat("_w", zeros)), F.lit(half))).drop("_w")


def zscore(df: DataFrame, value: str = "v", keys=("recording",), guard: bool = True) -> DataFrame:
    """(v - mean) / population deviation; a deviation of zero counts as one, or gives null without the guard."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    std = F.when(F.col("_std") == 0, 1.0).otherwise(F.col("_std")) if guard else F.col("_std")
    return df.join(stats, list(keys)).withColumn("z", F.try_divide(F.col(value) - F.col("_mean"), std)).drop("_mean", "_std")


def unzscore(scored: DataFrame, stats: DataFrame, value: str = "z", keys=("recording",)) -> DataFrame:
    """Back to values by stats (keys, mean, std)."""
    return scored.join(stats, list(keys)).withColumn("v", F.col(value) * F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")) + F.col("mean"))


def minmax(df: DataFrame, value: str = "v", keys=("recording",)) -> DataFrame:
    """(v - min) / (max - min); null for a constant series."""
    stats = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return df.join(stats, list(keys)).withColumn("scaled", scaled).drop("_lo", "_hi")


def scale_by_std(df: DataFrame, value: str = "v", keys=("recording",)) -> DataFrame:
    """v / sample deviation of its key."""
    stats = df.groupBy(*keys).agg(F.stddev_samp(value).alias("_std"))
    return df.join(stats, list(keys)).withColumn("scaled", F.try_divide(F.col(value), F.col("_std"))).drop("_std")


def mask_around(df: DataFrame, flag: Column, width: int = 10, value: str = "v", keys=("recording",), order: str = "idx") -> DataFrame:
    """Null in the ``[a - width, a + width)`` samples around each flagged sample a. The index must be dense."""
    near = F.max(F.col("_flag")).over(_over(keys, order).rowsBetween(-(width - 1), width))
    return df.withColumn("_flag", flag.cast("int")).withColumn("_near", near).withColumn(value, F.when(F.col("_near") == 0, F.col(value))).drop("_flag", "_near")


def interpolate(df: DataFrame, value: str = "v", keys=("recording",), order: str = "idx") -> DataFrame:
    """Linear between the known samples on both sides; the nearest known one at the ends."""
    # Both frames grow from the start of their order, so each row costs one step.
    before = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    after = _over(keys, F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("i"), F.col(value).alias("v")))
    held = df.withColumns({"_l": F.last(here, ignorenulls=True).over(before), "_r": F.last(here, ignorenulls=True).over(after)})
    share = F.try_divide(F.col(order) - F.col("_l.i"), F.col("_r.i") - F.col("_l.i"))
    line = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * share
    return held.withColumn(value, F.coalesce(F.col(value), line, F.col("_l.v"), F.col("_r.v"))).drop("_l", "_r")


def rising_edges(df: DataFrame, on: str = "on", keys=("recording",), order: str = "idx") -> DataFrame:
    """Index before each step from 0 to 1; a signal that starts high has no edge there."""
    rise = F.lead(on).over(_over(keys, order)) - F.col(on) > 0
    return df.withColumn("_rise", rise).filter("_rise").select(*keys, F.col(order).alias("edge"))


def pulse_segments(df: DataFrame, on: str = "on", keys=("recording",), order: str = "idx") -> DataFrame:
    """Runs of ones (start, end inclusive) and their number of all, in order."""
    over = _over(keys, order)
    change = (F.col(on) != F.lag(on, 1, 0).over(over)).cast("int")
    runs = df.withColumn("_c", change).withColumn("_run", F.sum("_c").over(over)).filter(F.col(on) == 1)
    found = runs.groupBy(*keys, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"))
    own = Window.partitionBy(*keys)
    return found.select(*keys, "start", "end", F.row_number().over(own.orderBy("start")).alias("number"), F.count("*").over(own).alias("pulses"))


def chosen_segment(segments: DataFrame, which: str) -> DataFrame:
    """The first, last or middle run of each signal."""
    number = {"first": F.lit(1), "last": F.col("pulses"), "middle": F.expr("pulses div 2 + 1")}[which]
    return segments.filter(F.col("number") == number)


def bipolar_to_level(df: DataFrame, threshold: float, up: str = "up", down: str = "down", keys=("recording",), order: str = "idx") -> DataFrame:
    """Level from two pulse channels: the k-th crossing of the first opens, the k-th of the second closes.

    Crossings are counted in both directions. The level is on while more opened than closed.
    """
    over = _over(keys, order)
    crossing = lambda c: F.coalesce((F.col(c) > threshold) != F.lag(F.col(c) > threshold).over(over), F.lit(False)).cast("int")
    counted = df.withColumns({"_o": crossing(up), "_c": crossing(down)})
    level = F.sum("_o").over(over) > F.sum("_c").over(over)
    return counted.withColumn("on", level.cast("int")).drop("_o", "_c")


def median_gap(events: DataFrame, time: str = "edge", keys=("recording",)) -> DataFrame:
    """Median difference of neighbouring events of each key."""
    gaps = events.withColumn("_gap", F.col(time) - F.lag(time).over(_over(keys, time)))
    return gaps.groupBy(*keys).agg(F.percentile("_gap", F.lit(0.5)).alias("gap"), F.count("_gap").alias("gaps"))


def lagged_features(df: DataFrame, columns, lags: int, bias: bool = True, initial: bool = False, keys=("recording",), order: str = "idx") -> DataFrame:
    """A constant, first-row features and, per column, the values ``lags`` samples ago up to now; zeros before the start."""
    over = _over(keys, order)
    out = [F.lit(1.0).alias("bias")] if bias else []
    if initial:
        out += [F.first(c).over(over.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{c}_initial") for c in columns]
    for c in columns:
        out += [(F.lag(c, k, 0.0).over(over) if k else F.col(c)).alias(f"{c}_lag{k}") for k in range(lags, -1, -1)]
    return df.select(*keys, order, *out)


def avg_rank(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Rank from one; ties share the mean of their places, missing values come first.

    Different values are counted, and the counts before each are summed, in pieces of a range sort where there are no keys: no
    task holds all rows. The ranks are joined back by key and value.
    """
    from posegrid.sources.scratch import settled

    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    if keys:
        before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
        placed = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    else:
        pieces = settled(counts.repartitionByRange(F.col(value).asc_nulls_first()).withColumn("_piece", F.spark_partition_id()), "pieces")
        earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        shifts = pieces.groupBy("_piece").agg(F.sum("_n").alias("_all")).select("_piece", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_shift"))
        inside = Window.partitionBy("_piece").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        known = pieces.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(shifts, "_piece")
        placed = known.withColumn("_before", F.col("_inside") + F.col("_shift"))
    named = placed.select(*(F.col(k).alias(f"_of_{k}") for k in [*keys, value]), (F.col("_before") + 1 + (F.col("_n") - 1) / 2).alias("rank"))
    same = F.lit(True)
    for k in [*keys, value]:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return df.join(named, same).select(*df.columns, "rank")


def poly_features(df: DataFrame, columns, degree: int, interaction: bool = True) -> DataFrame:
    """Products of columns up to a degree, lower degrees first; without interaction only powers of one column."""
    from itertools import combinations_with_replacement

    out = [F.lit(1.0).alias("one")]
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            if interaction or len(set(combo)) == 1:
                product = F.col(combo[0])
                for c in combo[1:]:
                    product = product * F.col(c)
                out.append(product.alias("*".join(combo)))
    return df.select("*", *out)
