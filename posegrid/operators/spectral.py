"""Spectra of sampled signals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tukey(n: int, share: float = 0.25):
    """Periodic Tukey window."""
    import numpy as np

    at = np.arange(n) / n
    edge = share / 2
    ramp = np.minimum(np.minimum(at, 1 - at) / edge, 1.0)
    return 0.5 * (1 - np.cos(np.pi * ramp))


def spectrogram(df: DataFrame, rate: float, nperseg: int = 5000, key: str = "recording", samples: int = 1 << 18) -> DataFrame:
    """(recording, seg, t, freq, power): magnitudes of windowed segments without their mean, an eighth overlapping.

    Samples are dealt to runs of segments, about ``samples`` of them each, and the few that the first segment of the next run
    needs to both; the segments of a run are transformed together. Segments that lack samples, as the last, partial one, are
    dropped; t is a segment's middle.
    """
    step = nperseg - nperseg // 8
    run = max(1, samples // step)
    last = F.floor(F.col("idx") / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - nperseg + 1) / step))
    runs = F.sequence(F.floor(first / run), F.floor(last / run))
    dealt = df.select(key, F.col("idx").cast("long"), F.col("v").cast("double"), F.explode(runs).alias("_run"))

    def each(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        begin = int(group["_run"].iloc[0]) * run
        at = group["idx"].to_numpy() - begin * step
        n = min(run, (int(at.max()) + 1 - nperseg) // step + 1) if at.max() + 1 >= nperseg else 0
        x, there = np.zeros((run - 1) * step + nperseg), np.zeros((run - 1) * step + nperseg, bool)
        x[at], there[at] = group["v"].to_numpy(), True
        if n > 0:
            segs = np.arange(n)[np.lib.stride_tricks.sliding_window_view(there, nperseg)[::step][:n].all(axis=1)]
        else:
            segs = np.zeros(0, np.int64)
        window = tukey(nperseg)
        parts = x[segs[:, None] * step + np.arange(nperseg)]
        power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * window, axis=1)) / window.sum()
        width = nperseg // 2 + 1
        seg = np.repeat(segs + begin, width)
        return pd.DataFrame(
            {key: np.full(len(seg), group[key].iloc[0], group[key].to_numpy().dtype), "seg": seg, "t": (nperseg / 2 + seg * step) / rate, "freq": np.tile(np.arange(width) * rate / nperseg, len(segs)), "power": power.ravel()}
        )

    kind = df.schema[key].dataType.simpleString()
    return dealt.groupBy(key, "_run").applyInPandas(each, f"{key} {kind}, seg long, t double, freq double, power double")


def band_powers(spectrum: DataFrame, key: str = "recording") -> DataFrame:
    """Mean power under 1, from 1 to 4 and from 5 to 10 Hz at each time."""
    f = F.col("freq")
    band = lambda c, n: F.avg(F.when(c, F.col("power"))).alias(n)
    return spectrum.groupBy(key, "seg", "t").agg(band(f < 1, "low"), band((f >= 1) & (f <= 4), "delta"), band((f >= 5) & (f <= 10), "theta"))


def band_series(bands: DataFrame, window: int = 8, key: str = "recording") -> DataFrame:
    """Smoothed and z-scored band powers, long."""
    from . import series

    long = bands.select(key, F.col("seg").alias("idx"), "t", "low", "delta", "theta").unpivot([key, "idx", "t"], ["low", "delta", "theta"], "band", "v")
    smooth = series.moving_avg(long, window, keys=(key, "band"))
    return series.zscore(smooth, "smooth", (key, "band")).select(key, "band", "idx", "t", "z")
