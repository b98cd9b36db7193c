"""Clock alignment from synchronisation pulses."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby, islice
from math import fma
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posegrid.sources.scratch import settled

from . import series


def crop_brightness(pixels: DataFrame, crops: DataFrame) -> DataFrame:
    """Mean grey value in each view's crop ``[sx, ex) x [sy, ey)`` per frame; a null bound is open. Crops are a row per view."""
    inside = F.lit(True)
    for axis, low, high in (("px", "sx", "ex"), ("py", "sy", "ey")):
        inside = inside & (F.col(low).isNull() | (F.col(axis) >= F.col(low))) & (F.col(high).isNull() | (F.col(axis) < F.col(high)))
    grey = 0.299 * F.col("red") + 0.587 * F.col("green") + 0.114 * F.col("blue")
    return pixels.join(F.broadcast(crops), "view").filter(inside).groupBy("recording", "view", "frame").agg(F.avg(grey).alias("v"))


def led_signal(df: DataFrame, threshold: float = 0.9, bins: int = 100, keys=("recording",)) -> DataFrame:
    """On where the brightness above the background passes a share of the peak.

    Background: the right edge of the fullest of equal bins. Peak: the 90th percentile of the values at
    or above the 75th percentile of those over two; the greatest value if there are none.
    """
    from .tables import equal_bins

    on = list(keys)
    binned = equal_bins(df, bins, "v", keys)
    counts = binned.groupBy(*on, "lo", "hi", "bin").agg(F.count("*").alias("n"))
    fullest = counts.groupBy(*on, "lo", "hi").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"))
    base = fullest.select(*on, (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("base"))
    raised = df.join(base, on).withColumn("above", F.col("v") - F.col("base"))
    high = raised.filter("above > 2").groupBy(*on).agg(F.percentile("above", F.lit(0.75)).alias("p75"))
    top = raised.join(high, on).filter("above >= p75").groupBy(*on).agg(F.percentile("above", F.lit(0.9)).alias("p90"))
    most = raised.groupBy(*on).agg(F.max("above").alias("most"))
    peak = most.join(top, on, "left").select(*on, F.coalesce("p90", "most").alias("peak"))
    return raised.join(peak, on).withColumn("on", (F.col("above") > threshold * F.col("peak")).cast("int"))


def threshold_signal(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    return df.withColumn("on", (F.col("v") > threshold).cast("int"))


def crop_edges(edges: DataFrame, cut: Column) -> DataFrame:
    """Edges after the first ``cut`` samples are gone, on the new index."""
    return edges.withColumn("_c", cut).filter(F.col("edge") >= F.col("_c")).withColumn("edge", F.col("edge") - F.col("_c")).drop("_c")


def resample(df: DataFrame, source: float, target: float, order: str = "idx") -> DataFrame:
    """Every n-th sample of a faster signal, or each sample of a slower one n times."""
    if source >= target:
        step = int(source / target)
        return df.filter(F.col(order) % step == 0).withColumn(order, F.expr(f"cast({order} div {step} as int)"))
    times = int(target / source)
    return df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(order, F.col(order) * times + F.col("_k")).drop("_k")


def ordinal_pairs(reference: DataFrame, target: DataFrame, key: str = "recording") -> DataFrame:
    """k-th edge with k-th edge, as far as the shorter list goes."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("edge"))
    r = reference.select(key, F.col("edge").alias("edge_r")).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("edge_r")))
    t = target.select(key, number.alias("k"), F.col("edge").alias("edge_t"))
    return r.join(t, [key, "k"])


def lag_counts(reference: DataFrame, target: DataFrame, key: str = "recording") -> DataFrame:
    """(recording, first, last, at_first, at_last): the pairs of ones of two binary signals by lag, reference less target.

    Signals are runs of ones. Two runs of p and q samples meet at p + q - 1 lags in a number that rises,
    stays and falls; as second differences these are four numbers a pair of runs, whatever their length.
    Their running sums give the counts as straight pieces between the lags where the slope changes.
    """
    ends = lambda d, n: series.pulse_segments(d, keys=(key,)).select(key, F.col("start").cast("long").alias(f"{n}s"), F.col("end").cast("long").alias(f"{n}e"))
    p, q = F.col("re") - F.col("rs") + 1, F.col("te") - F.col("ts") + 1
    low = F.col("rs") - F.col("te")
    turns = F.array(*(F.struct(at.alias("at"), F.lit(d).alias("d")) for at, d in ((low, 1), (low + p, -1), (low + q, -1), (low + p + q, 1))))
    pairs = ends(reference, "r").join(ends(target, "t"), key).select(key, F.explode(turns).alias("x"))
    second = pairs.groupBy(key, F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    over = Window.partitionBy(key).orderBy("at")
    pieces = second.withColumn("slope", F.sum("d").over(over)).withColumn("next", F.lead("at").over(over)).filter("next is not null")
    grown = pieces.withColumn("before", F.sum(F.col("slope") * (F.col("next") - F.col("at"))).over(over) - F.col("slope") * (F.col("next") - F.col("at")))
    return grown.select(
        key, F.col("at").alias("first"), (F.col("next") - 1).alias("last"), (F.col("before") + F.col("slope")).alias("at_first"), (F.col("before") + F.col("slope") * (F.col("next") - F.col("at"))).alias("at_last")
    )


def crosscorr_align(
    reference: DataFrame, target: DataFrame, target_rate: float, max_lag: int | None = None, key: str = "recording", reference_rate: float | None = None
) -> DataFrame:
    """Lag of the most coinciding ones of two binary signals, in samples and seconds; good if every edge coincides.

    The target is first brought to the reference's rate, if that is given; the lag in seconds is by the
    target's rate all the same. ``max_lag`` bounds the lags. Ties go to the lag nearest to one, then the smaller.
    """
    same = target if reference_rate in (None, target_rate) else resample(target, target_rate, reference_rate)
    counts = lag_counts(reference, same, key)
    if max_lag is not None:
        counts = counts.filter((F.col("last") >= -max_lag) & (F.col("first") <= max_lag))
    bound = F.lit(2**40 if max_lag is None else max_lag)
    low, high = F.greatest("first", -bound), F.least("last", bound)
    slope = F.coalesce(F.try_divide(F.col("at_last") - F.col("at_first"), F.col("last") - F.col("first")).cast("long"), F.lit(0))
    # A piece is greatest at an end; a level one may hold lag one.
    lags = F.array(low, high, F.greatest(low, F.least(high, F.lit(1))))
    tried = counts.select(key, "first", "at_first", slope.alias("slope"), F.explode(lags).alias("lag")).select(key, "lag", (F.col("at_first") + F.col("slope") * (F.col("lag") - F.col("first"))).alias("corr"))
    best = tried.filter("corr > 0").groupBy(key).agg(F.max(F.struct(F.col("corr"), -F.abs(F.col("lag") - 1), -F.col("lag"))).alias("b"))
    edges = lambda d, n: d.groupBy(key).agg(F.count("*").alias(n))
    er, et = edges(series.rising_edges(reference, keys=(key,)), "er"), edges(series.rising_edges(target, keys=(key,)), "et")
    found = best.select(key, F.col("b.corr").alias("corr"), (-F.col("b.col3")).alias("lag")).join(er, key, "left").join(et, key, "left")
    fewest = F.least(F.coalesce("er", F.lit(0)), F.coalesce("et", F.lit(0)))
    return found.select(key, "lag", (F.col("lag") / target_rate).alias("lag_time"), "corr", (F.col("corr") == fewest).alias("good"))


def _line(points: Iterable[tuple]) -> tuple[float | None, float | None, int]:
    """Slope and intercept of (x, y), and their number: one pass that updates means and moments. No line where x is one value."""
    n, mean_x, mean_y, co, square, sum_x, sum_y, rows = 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0
    for x, y in points:
        rows += 1
        if x is None or y is None:
            continue
        n += 1
        dx = x - mean_x
        mean_x += dx / n
        mean_y += (y - mean_y) / n
        co = fma(dx, y - mean_y, co)
        square += dx * (x - mean_x)
        sum_x += x
        sum_y += y
    if n < 2 or square == 0:
        return None, None, rows
    slope = (co / n) / (square / n)
    return slope, fma(-slope, sum_x / n, sum_y / n), rows


def ordered_lines(pairs: DataFrame, key: str = "recording", order: str = "k") -> DataFrame:
    """(key, slope, intercept, pairs): the line of y on x by least squares, summed in the given order.

    The last bit of a slope counts: a lag is often a whole number of samples, of which the next stage cuts as many as the
    product of lag and rate reaches. Partial sums would let that bit hang on how rows were dealt to tasks. So rows are
    sorted by key and order, and each key's pass through as a stream, with the fused product of DuckDB's regression.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = pairs.schema[key].dataType
    types = [to_arrow_type(kind), pa.float64(), pa.float64(), pa.int64()]
    kept = pairs.select(key, order, "x", "y").repartition(key).sortWithinPartitions(key, order).select(key, "x", "y")

    def lines(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        found = ((name, *_line(p[1:] for p in points)) for name, points in groupby(rows, itemgetter(0)))
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=[key, "slope", "intercept", "pairs"])

    return kept.mapInArrow(lines, f"`{key}` {kind.simpleString()}, slope double, intercept double, pairs long")


def regression_align(reference: DataFrame, target: DataFrame, rate_r: float, rate_t: float | Column, max_rmse: float, lag: float | Column = 0.0, key: str = "recording") -> DataFrame:
    """Line of target on reference edge times: new lag and rate; good if the residuals are small. One pair is no line.

    ``rate_t`` and ``lag`` are numbers, or columns of ``target``: the state that earlier stages left.
    """
    rate, before = (x if isinstance(x, Column) else F.lit(float(x)) for x in (rate_t, lag))
    known = target.select(key, "edge", rate.alias("_rate"), before.alias("_before"))
    state = known.groupBy(key).agg(F.first("_rate").alias("_rate"), F.first("_before").alias("_before"))
    pairs = ordinal_pairs(reference, known, key).join(state, key).select(key, "k", (F.col("edge_r") / rate_r).alias("x"), (F.col("edge_t") / F.col("_rate")).alias("y"))
    line = ordered_lines(pairs, key)
    rest = F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")
    error = pairs.join(line, key).groupBy(key).agg(F.sqrt(F.avg(rest * rest)).alias("rmse"))
    found = line.join(error, key).join(state, key)
    return found.select(
        key, "slope", (F.col("slope") * (F.col("_before") - F.col("intercept"))).alias("lag"), (F.col("slope") * F.col("_rate")).alias("sample_rate"), "rmse", "pairs",
        F.coalesce(F.col("rmse") < max_rmse, F.lit(False)).alias("good"),
    )


def samplerate_align(reference: DataFrame, target: DataFrame, rate_r: float, rate_t: float | Column, lag: float | Column = 0.0, key: str = "recording") -> DataFrame:
    """Ratio of the median gaps, in seconds, of as many edges as both have, scales lag and rate; good if there is one."""
    rate, before = (x if isinstance(x, Column) else F.lit(float(x)) for x in (rate_t, lag))
    known = target.select(key, "edge", rate.alias("_rate"), before.alias("_before"))
    state = known.groupBy(key).agg(F.first("_rate").alias("_rate"), F.first("_before").alias("_before"))
    over = Window.partitionBy(key).orderBy("k")
    gap = lambda c: F.col(c) - F.lag(c).over(over)
    gaps = ordinal_pairs(reference, known, key).select(key, gap("edge_r").alias("r"), gap("edge_t").alias("t"))
    both = gaps.groupBy(key).agg(F.percentile("r", F.lit(0.5)).alias("r"), F.percentile("t", F.lit(0.5)).alias("t")).join(state, key)
    ratio = F.try_divide(F.col("t") / F.col("_rate"), F.col("r") / rate_r)
    return both.select(key, ratio.alias("ratio"), (F.col("_before") * ratio).alias("lag"), (F.col("_rate") * ratio).alias("sample_rate"), ratio.isNotNull().alias("good"))


STAGES = ("crosscorr", "regression", "samplerate")


def _cropped(signal: DataFrame, cut: DataFrame, column: str, order: str, key: str) -> DataFrame:
    """A signal or its edges without the first samples of each key, on the new index, with the state of its key."""
    return signal.join(cut, key).filter(F.col(order) >= F.col(column)).withColumn(order, F.col(order) - F.col(column))


def align(reference: DataFrame, target: DataFrame, rate_r: float, rate_t: float, stages=STAGES, max_rmse: float = 0.05, max_lag: int | None = None, key: str = "recording", aligned: bool = False) -> DataFrame:
    """Stages in order, each result kept only if good: (recording, lag, slope, sample_rate, good).

    A stage works on the signals cropped by the state before it: a lag above zero cuts the target by
    ``int(lag * sample_rate)`` samples, one below zero the reference by ``int(-lag * rate_r)``, with the
    sample rate of that state. This rule is kept for equal results, though it cuts the side whose pulses
    already come first and so moves equal edges further apart: a later regression then counts the lag
    three times. ``aligned`` cuts the other side instead, which brings equal edges together. Regression sets lag, rate and slope, the gap ratio lag and rate. Recordings
    without pulses on either side keep the given rate and a null lag.
    """
    if unknown := [s for s in stages if s not in STAGES]:
        raise ValueError(f"unknown stages: {unknown}")
    state = target.select(key).distinct().select(
        key, F.lit(None).cast("double").alias("lag"), F.lit(1.0).alias("slope"), F.lit(float(rate_t)).alias("sample_rate"), F.lit(False).alias("good")
    )
    er, et = series.rising_edges(reference, keys=(key,)), series.rising_edges(target, keys=(key,))
    side = -1 if aligned else 1
    for stage in stages:
        lag = F.coalesce("lag", F.lit(0.0))
        cut = state.select(
            key, lag.alias("_lag"), F.col("sample_rate").alias("_state"),
            F.greatest(F.lit(0), (side * lag * F.col("sample_rate")).cast("int")).alias("_cut_t"), F.greatest(F.lit(0), (-side * lag * rate_r).cast("int")).alias("_cut_r"),
        )
        none = F.lit(None).cast("double")
        if stage == "crosscorr":
            r = _cropped(reference, cut, "_cut_r", "idx", key).select(key, "idx", "on")
            t = _cropped(target, cut, "_cut_t", "idx", key).select(key, "idx", "on")
            found = crosscorr_align(r, t, rate_t, max_lag, key, rate_r)
            new = found.select(key, F.col("lag_time").alias("nl"), none.alias("ns"), none.alias("nr"), F.col("good").alias("ng"))
        else:
            r, t = _cropped(er, cut, "_cut_r", "edge", key).select(key, "edge"), _cropped(et, cut, "_cut_t", "edge", key)
            if stage == "regression":
                found = regression_align(r, t, rate_r, F.col("_state"), max_rmse, F.col("_lag"), key)
                slope = F.col("slope")
            else:
                found, slope = samplerate_align(r, t, rate_r, F.col("_state"), F.col("_lag"), key), none
            new = found.select(key, F.col("lag").alias("nl"), slope.alias("ns"), F.col("sample_rate").alias("nr"), F.col("good").alias("ng"))
        ok = F.coalesce("ng", F.lit(False))
        pick = lambda n, o: F.when(ok, F.coalesce(n, o)).otherwise(F.col(o)).alias(o)
        state = state.join(new, key, "left").select(key, pick("nl", "lag"), pick("ns", "slope"), pick("nr", "sample_rate"), (F.col("good") | ok).alias("good"))
        state = settled(state, "alignment-state")  # a row a recording, read several times by the next stage
    return state


def apply_alignment(df: DataFrame, params: DataFrame, key: str = "recording") -> DataFrame:
    """Adds the corrected time idx / rate + lag of every sample."""
    p = params.select(key, "lag", "sample_rate")
    return df.join(p, key).withColumn("time", F.col("idx") / F.col("sample_rate") + F.coalesce("lag", F.lit(0.0))).drop("lag", "sample_rate")


def dense_lag_sums(reference: DataFrame, target: DataFrame, max_lag: int | None = None, key: str = "recording", value: str = "on", block: int = 1 << 16) -> DataFrame:
    """(key, lag, corr): sums over i of reference[i + lag] * target[i] of real signals (idx, value), missing samples zero.

    Signals are cut into blocks. A block of the reference meets the blocks of the target that its lags can
    reach, each pair is correlated by Fourier transforms, and the sums of all pairs are added by lag. With a bound on the lags the cost
    goes with the length of the signals, however often they change; without one all pairs of blocks meet. Only
    lags between two samples that are there have a row.
    """
    import numpy as np
    import pyarrow as pa

    far = None if max_lag is None else -(-max_lag // block)

    def packed(df: DataFrame, n: str) -> DataFrame:
        rows = df.select(key, F.col("idx").cast("long").alias("i"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"))
        cut = rows.withColumn("b", F.floor(F.col("i") / block).cast("long"))
        return cut.groupBy(key, F.col("b").alias(f"{n}b")).agg(F.collect_list(F.struct((F.col("i") - F.col("b") * block).alias("i"), "x")).alias(n))

    r, t = packed(reference, "r"), packed(target, "t")
    if far is None:
        pairs = r.join(t, key)
    else:
        pairs = r.withColumn("tb", F.explode(F.sequence(F.col("rb") - far - 1, F.col("rb") + far + 1))).join(t, [key, "tb"])
    part = lambda n, c: F.transform(n, lambda s: s[c]).alias(n + c)
    sent = pairs.select(key, (F.col("rb") - F.col("tb")).alias("apart"), *(part(n, c) for n in "rt" for c in "ix"))

    def correlate(batches):
        for batch in batches:
            rows, lags, sums, held = [], [], [], 0

            def put():
                keys = batch.column(key).take(pa.array(np.repeat(np.array(rows, np.int32), list(map(len, lags)))))
                return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(lags)), pa.array(np.concatenate(sums))], names=[key, "lag", "corr"])

            apart = batch.column("apart").to_pylist()
            for row in range(batch.num_rows):
                ri, rx, ti, tx = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ri", "rx", "ti", "tx"))
                # Transforms are as long as the samples that are there, which may be far fewer than a block's.
                r0, t0 = ri.min(), ti.min()
                r, t = np.bincount(ri - r0, rx), np.bincount(ti - t0, tx)
                size = 1 << (len(r) + len(t) - 2).bit_length()
                found = np.fft.irfft(np.fft.rfft(r, size) * np.fft.rfft(t, size).conj(), size) if size > 1 else r * t
                near = np.arange(1 - len(t), len(r))
                whole = near + r0 - t0 + apart[row] * block
                if max_lag is not None:
                    near, whole = near[np.abs(whole) <= max_lag], whole[np.abs(whole) <= max_lag]
                rows.append(row)
                lags.append(whole)
                sums.append(found[near % size])
                held += len(whole)
                if held >= block:
                    yield put()
                    rows, lags, sums, held = [], [], [], 0
            if rows:
                yield put()

    parts = sent.mapInArrow(correlate, f"`{key}` {reference.schema[key].dataType.simpleString()}, lag long, corr double")
    return parts.groupBy(key, "lag").agg(F.sum("corr").alias("corr"))


def dense_crosscorr_align(reference: DataFrame, target: DataFrame, target_rate: float, max_lag: int | None = None, key: str = "recording", binary: bool = True) -> DataFrame:
    """``crosscorr_align`` for signals that flicker, or of real values: (key, lag, lag_time, corr), with the same rule for ties.

    Sums of binary signals are whole numbers and are rounded to them; those of real ones to nine digits, so that equal peaks tie.
    """
    sums = dense_lag_sums(reference, target, max_lag, key)
    exact = sums.withColumn("corr", F.round("corr").cast("long") if binary else F.round("corr", 9)).filter("corr > 0")
    best = exact.groupBy(key).agg(F.max(F.struct(F.col("corr"), -F.abs(F.col("lag") - 1), -F.col("lag"))).alias("b"))
    return best.select(key, (-F.col("b.col3")).alias("lag"), (-F.col("b.col3") / target_rate).alias("lag_time"), F.col("b.corr").alias("corr"))
