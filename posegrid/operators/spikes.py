"""Spike trains and waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def waveform_rows(peaks: DataFrame, samples: DataFrame, before: int = 10, after: int = 10) -> DataFrame:
    """(channel, spike, off, v): the samples from ``before`` ahead of each spike up to ``after`` behind it, where they exist."""
    wanted = peaks.select("channel", "spike", F.explode(F.sequence(F.lit(-before), F.lit(after - 1))).alias("off"))
    wanted = wanted.withColumn("sample", F.col("spike") + F.col("off"))
    return wanted.join(samples, ["channel", "sample"]).select("channel", "spike", "off", "v")


def mean_waveform(rows: DataFrame) -> DataFrame:
    """Mean per channel and offset, less the first offset's mean."""
    means = rows.groupBy("channel", "off").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    base = means.groupBy("channel").agg(F.min_by("mean", "off").alias("base"))
    return means.join(base, "channel").select("channel", "off", "n", (F.col("mean") - F.col("base")).alias("v"))


def sampled_spikes(spikes: DataFrame, keep: int, keys=("unit",), seed: int = 0) -> DataFrame:
    """``keep`` spikes of each unit at most, drawn by hash: the same ones each time."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("t_us").cast("string"))), "t_us"))
    return spikes.withColumn("_n", number).filter(F.col("_n") <= keep).drop("_n")


def firing_rate(spikes: DataFrame, bin_us: int = 10_000, session=()) -> DataFrame:
    """Spikes per second in every bin of each unit up to the last spike of its session; empty bins are zero."""
    keys = [*session, "unit"]
    counted = spikes.groupBy(*keys, F.floor(F.col("t_us") / bin_us).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = counted.groupBy(*session).agg(F.max("bin").alias("last"))
    units = counted.select(*keys).distinct()
    spine = units.join(bins, list(session)) if session else units.join(F.broadcast(bins))
    spine = spine.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("bin"))
    return spine.join(counted, [*keys, "bin"], "left").select(*keys, "bin", (F.coalesce("n", F.lit(0)) * (1e6 / bin_us)).alias("rate"))


def spike_train(spikes: DataFrame) -> DataFrame:
    """Distinct milliseconds with a spike."""
    return spikes.select("unit", F.floor(F.col("t_us") / 1000).cast("long").alias("ms")).distinct()


def train_times(train: DataFrame) -> DataFrame:
    return train.select("unit", (F.col("ms") * 1000).alias("t_us"))


def permutations(spark, n: int, seed: int = 0, least_ms: int = 15_000, most_ms: int = 60_000) -> DataFrame:
    """(perm, shift): one shift for each permutation, of ``least_ms`` to under ``most_ms`` either way, by hash."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % (2 * (most_ms - least_ms))
    shift = F.when(draw < most_ms - least_ms, draw + least_ms).otherwise(draw - (most_ms - least_ms) - most_ms)
    return spark.range(n).select(F.col("id").alias("perm"), shift.alias("shift"))


def cyclic_shuffle(train: DataFrame, shifts: DataFrame, length_ms: int) -> DataFrame:
    """Every train under every shift, modulo the length. ``shifts`` has a row per permutation (a thousand) and is broadcast."""
    return train.join(F.broadcast(shifts)).select("unit", "perm", F.pmod(F.col("ms") + F.col("shift"), F.lit(length_ms)).alias("ms"))


def tuning_curve(spike_frames: DataFrame, frames: DataFrame, bins: int = 20, fps: int = 100, keys=("unit",), session=()) -> DataFrame:
    """Rate per bin of a movement value: spikes in the bin's frames over the time spent in it.

    ``spike_frames`` has session, keys and frame, ``frames`` session, frame and bin.
    """
    on = list(session)
    time = frames.groupBy(*on, "bin").agg((F.count("*") / fps).alias("seconds"))
    hits = spike_frames.join(frames.select(*on, "frame", "bin"), [*on, "frame"]).groupBy(*on, *keys, "bin").agg(F.count("*").alias("spikes"))
    units = spike_frames.select(*on, *keys).distinct()
    grid = units.join(time, on) if on else units.join(F.broadcast(time))  # bins are few and fixed
    found = grid.join(hits, [*on, *keys, "bin"], "left").withColumn("spikes", F.coalesce("spikes", F.lit(0)))
    return found.select(*on, *keys, "bin", "spikes", "seconds", F.coalesce(F.try_divide("spikes", "seconds"), F.lit(0.0)).alias("rate"))


def spike_xcorr(spike_frames: DataFrame, frames: DataFrame, max_lag: int, keys=("unit",), session=()) -> DataFrame:
    """Sum of the movement ``lag`` frames before each spike, for lags of either sign: sum over l of rate[l + lag] * v[l].

    A row a spike and lag, for few spikes or lags; ``permutations.spike_xcorr`` takes whole windows by Fourier transforms.
    """
    lags = spike_frames.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("frame", F.col("frame") - F.col("lag"))
    return lags.join(frames, [*session, "frame"]).groupBy(*session, *keys, "lag").agg(F.sum("v").alias("corr"))


def xcorr_peaks(xcorr: DataFrame, low: int = -50, high: int = 49, keys=("unit",)) -> DataFrame:
    """Greatest and least correlation within the lags, and where; of equal ones the smaller lag."""
    near = xcorr.filter(F.col("lag").between(low, high))
    return near.groupBy(*keys).agg(
        F.max_by("lag", F.struct("corr", -F.col("lag"))).alias("peak_lag"), F.max("corr").alias("peak"), F.min_by("lag", F.struct("corr", "lag")).alias("trough_lag"), F.min("corr").alias("trough")
    )


def xcorr_significance(xcorr: DataFrame, envelope: DataFrame, first: int = -10, last: int = 0, keys=("unit",)) -> DataFrame:
    """Peaks with the ``envelope`` (keys, lag, low, high) of shuffled correlations at their lags, and whether each lies outside of it at a lag of ``first`` to ``last``."""
    on = list(keys)
    peaks = xcorr_peaks(xcorr, keys=keys)
    at = lambda n, c: envelope.select(*on, F.col("lag").alias(f"{n}_lag"), F.col(c).alias(f"{n}_bound"))
    both = peaks.join(at("peak", "high"), [*on, "peak_lag"], "left").join(at("trough", "low"), [*on, "trough_lag"], "left")
    within = lambda n: F.col(f"{n}_lag").between(first, last)
    return both.select(
        *on, "peak_lag", "peak", "peak_bound", "trough_lag", "trough", "trough_bound",
        F.coalesce(within("peak") & (F.col("peak") > F.col("peak_bound")), F.lit(False)).alias("peak_significant"),
        F.coalesce(within("trough") & (F.col("trough") < F.col("trough_bound")), F.lit(False)).alias("trough_significant"),
    )


def neighbour_channels(channels: DataFrame, keep: int = 9) -> DataFrame:
    """(channel, neighbour, place): the nearest channels of each, itself first. A probe has some dozen channels.

    Distance is along the shank, and half a step for the other shank; ties go to the lower channel.
    """
    from pyspark.sql import Window

    other = channels.select(F.col("channel").alias("neighbour"), F.col("shank").alias("_s"), F.col("position").alias("_p"))
    far = F.abs(F.col("position") - F.col("_p")) + F.when(F.col("shank") != F.col("_s"), 0.5).otherwise(0.0)
    placed = channels.join(F.broadcast(other)).withColumn("place", F.row_number().over(Window.partitionBy("channel").orderBy(far, "neighbour")))
    return placed.filter(F.col("place") <= keep).select("channel", "neighbour", "place")
