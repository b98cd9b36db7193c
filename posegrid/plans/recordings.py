"""Queries on raw recordings and on long ones: the data source, windows over chunks, exact percentiles, uneven frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from posegrid.functions import measurements as m
from posegrid.operators import chunks, quantiles, sync, tables
from posegrid.sources import derived, xdat
from posegrid.sources.scratch import scratch_folder

from . import series as whole
from .geometry import SQL_LONG
from .series import ALIGN, SPIKES, S
from .signals import CROSS

QUERIES, ORACLES = {}, {}
#: Samples of a chunk here: series of the tables are short, and several chunks each.
CHUNK = 512


def query(name, sql):
    def add(run):
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


def _r(column, digits=4):
    return F.round(column, digits)


#: Raw recordings: eight channels at 1000 Hz, from sample 500 on.
RATE, CHANNELS, FIRST = 1000.0, 8, 500
RAW = f"{S}, x AS (SELECT recording, idx + {FIRST} AS sample, unnest(range({CHANNELS})) AS channel, v FROM s)"
RAW_COLUMNS = f"recording, channel::INTEGER AS channel, sample::BIGINT AS sample, sample::BIGINT AS \"timestamp\", round(sample / {RATE}, 4) AS seconds, round((v * (channel + 1))::FLOAT::DOUBLE, 3) AS v"


def _written(spark, sf):
    folder = scratch_folder(spark, "raw")
    rows = derived.series(spark, sf).withColumn("sample", F.col("idx") + FIRST)
    values = F.transform(F.sequence(F.lit(1), F.lit(CHANNELS)), lambda c: F.col("v") * c)
    xdat.write_xdat(rows.select("recording", "sample", F.col("sample").alias("timestamp"), values.alias("v")), folder, RATE, CHANNELS)
    return folder


def _shown(df):
    return df.select("recording", "channel", "sample", "timestamp", _r("seconds").alias("seconds"), _r(F.col("v").cast("double"), 3).alias("v"))


@query("s09_raw_recordings", f"WITH {RAW} SELECT {RAW_COLUMNS} FROM x")
def _(spark, sf):
    """Every channel of every recording, written in the raw format and read back."""
    return _shown(xdat.read_xdat(spark, _written(spark, sf)))


@query("s09_raw_range", f"WITH {RAW} SELECT {RAW_COLUMNS} FROM x WHERE channel IN (2, 5) AND sample >= 750 AND sample < 1500")
def _(spark, sf):
    """Two channels from 0.75 to 1.5 s of every recording: only their bytes' blocks are read."""
    return _shown(xdat.read_xdat(spark, _written(spark, sf), 0.75, 1.5, [2, 5]))


def _twin(name, run):
    """The chunked operator against the SQL of the operator over whole series."""
    QUERIES[f"{name}_chunks"], ORACLES[f"{name}_chunks"] = run, whole.ORACLES[name]


_twin("w01_velocity", lambda spark, sf: chunks.velocity(derived.series(spark, sf), chunk=CHUNK).select("recording", "idx", _r("velocity").alias("velocity")))
_twin("w02_moving_avg", lambda spark, sf: chunks.moving_avg(derived.series(spark, sf), 8, 3, chunk=CHUNK).select("recording", "idx", _r("smooth", 6).alias("smooth")))
_twin("w03_running_median", lambda spark, sf: chunks.running_median(derived.series(spark, sf), 13, chunk=CHUNK).select("recording", "idx", _r("median").alias("median")))
_twin("w07_mask_around", lambda spark, sf: chunks.mask_around(derived.series(spark, sf), F.col("event_id") % 97 == 0, chunk=CHUNK).select("recording", "idx", _r("v").alias("v")))
_twin("w08_interpolate", lambda spark, sf: chunks.interpolate(derived.series_gappy(spark, sf), chunk=CHUNK).select("recording", "idx", _r("v").alias("v")))
_twin("w09_rising_edges", lambda spark, sf: chunks.rising_edges(derived.sync_reference(spark, sf), chunk=16))
_twin("w10_pulse_segments", lambda spark, sf: chunks.pulse_segments(derived.sync_reference(spark, sf), chunk=16))


def _w11(spark, sf):
    df = derived.series(spark, sf).select("recording", "idx", F.col("v").alias("up"), F.when(F.col("event_id") % 10 > 7, 101.0).otherwise(0.0).alias("down"))
    return chunks.bipolar_to_level(df, 100.0, chunk=CHUNK).select("recording", "idx", "on")


_twin("w11_bipolar_to_level", _w11)


def _w12(spark, sf):
    gaps = chunks.gaps(chunks.rising_edges(derived.sync_reference(spark, sf), chunk=16), chunk=16)
    medians = quantiles.percentiles(gaps, "gap", [0.5])
    counts = gaps.groupBy("recording").agg(F.count("gap").alias("gaps"))
    return counts.join(medians, "recording", "left").select("recording", _r("percentile").alias("gap"), "gaps")


_twin("w12_median_gap", _w12)
_twin("w13_lagged_features", lambda spark, sf: chunks.lagged_features(derived.series(spark, sf), ["v"], 2, True, True, chunk=CHUNK))


@query(
    "a13_exact_percentiles",
    f"""WITH {S}, q AS (SELECT recording, count(*) AS n, quantile_cont(v, [0.0, 0.025, 0.5, 0.75, 0.975, 0.999, 1.0]) AS p FROM s GROUP BY 1)
    SELECT recording, unnest([0.0, 0.025, 0.5, 0.75, 0.975, 0.999, 1.0])::DOUBLE AS share, n, round(unnest(p), 4) AS percentile FROM q""",
)
def _(spark, sf):
    """Percentiles that keep no group in a task: bounds by a sketch, then the values between them."""
    found = quantiles.percentiles(derived.series(spark, sf), "v", [0.0, 0.025, 0.5, 0.75, 0.975, 0.999, 1.0], few=100)
    return found.select("recording", _r("share", 3).alias("share"), "n", _r("percentile").alias("percentile"))


@query(
    "a04_exact_speeds",
    f"""WITH {SQL_LONG}, sp AS (SELECT recording, measurement_name, abs(value - lag(value) OVER (PARTITION BY recording, measurement_name ORDER BY frame)) * 100 AS v FROM ml)
    SELECT recording, measurement_name, count(v) AS n, round(quantile_cont(v, 0.999), 4) AS speed FROM sp GROUP BY ALL""",
)
def _(spark, sf):
    """The 99.9th percentile of every measurement's speed, exact for groups of any size."""
    long = m.long(m.measurements(derived.pose_wide(spark, sf))).withColumnRenamed("frame", "idx")
    speed = chunks.velocity(long, "value", ("recording", "measurement_name"), chunk=64)
    found = quantiles.percentiles(speed, "velocity", [0.999], ("recording", "measurement_name"), few=10)
    return found.select("recording", "measurement_name", "n", _r("percentile").alias("speed"))


@query(
    "j05_uneven_frames",
    f"""WITH {SPIKES}, fr AS (SELECT unit, frame, 3000000 + frame * 9800 + (frame * 7919) % 4001 AS t_us FROM (SELECT DISTINCT unit FROM sp), (SELECT unnest(range((SELECT max(t_us) // 10000 + 2 FROM sp))) AS frame) WHERE frame % 7 <> 3)
    SELECT sp.unit, sp.t_us, coalesce(fr.frame, 0) AS frame FROM sp ASOF LEFT JOIN fr ON sp.unit = fr.unit AND sp.t_us >= fr.t_us""",
)
def _(spark, sf):
    """Spikes to the frames of a camera with uneven times and lost frames, clipped at both ends."""
    sp = derived.spikes(spark, sf)
    frames = derived.movement(spark, sf).filter("frame % 7 <> 3").select("frame", F.expr("3000000 + frame * 9800 + (frame * 7919) % 4001").alias("t_us"))
    frames = sp.select("unit").distinct().join(frames).select("unit", "frame", "t_us")
    return tables.frame_at(sp, frames, "t_us", ["unit"]).select("unit", "t_us", "frame")


@query("y06_dense_crosscorr", f"WITH {ALIGN}, {CROSS} SELECT recording, lag, round(lag / 100.0, 6) AS lag_time, corr FROM best")
def _(spark, sf):
    found = sync.dense_crosscorr_align(derived.sync_reference(spark, sf), derived.sync_target(spark, sf), 100.0)
    return found.select("recording", "lag", _r("lag_time", 6).alias("lag_time"), "corr")
