"""Jitter of tracked points and of measurements, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def point_jitter(points: DataFrame, keys=("recording", "keypoint"), fps: int = 100) -> DataFrame:
    """Per key and axis: deviation from the mean position (thousandths) and speed; std, least, most, mean."""
    long = points.unpivot([*keys, "frame"], ["x", "y", "z"], "axis", "value")
    own = (*keys, "axis")
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*own).orderBy("frame"))) * fps
    mean = long.groupBy(*own).agg(F.avg("value").alias("mean"))
    rows = long.withColumn("speed", step).join(mean, list(own)).withColumn("deviation", (F.col("value") - F.col("mean")) * 1000)
    return rows.groupBy(*own).agg(
        F.stddev_pop("value").alias("position_stddev"),
        F.min("deviation").alias("min_deviation"),
        F.max("deviation").alias("max_deviation"),
        F.avg("speed").alias("velocity_mean"),
        F.min("speed").alias("min_velocity"),
        F.max("speed").alias("max_velocity"),
    )


def vector_jitter(points: DataFrame, axes=("x", "y", "z"), keys=("recording", "keypoint"), fps: int = 100) -> DataFrame:
    """Per key: length of the deviation and of the step; the deviation's std, and the speed's mean, most and std."""
    mean = points.groupBy(*keys).agg(*(F.avg(a).alias(f"_{a}") for a in axes))
    over = Window.partitionBy(*keys).orderBy("frame")
    square = lambda parts: F.sqrt(sum(parts[1:], parts[0]))
    step = square([(F.col(a) - F.lag(a).over(over)) * (F.col(a) - F.lag(a).over(over)) for a in axes]) * fps
    rows = points.withColumn("speed", step).join(mean, list(keys))
    rows = rows.withColumn("deviation", square([(F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in axes]) * 1000)
    return rows.groupBy(*keys).agg(
        F.stddev_pop("deviation").alias("position_stddev"),
        F.max("deviation").alias("max_deviation"),
        F.avg("speed").alias("velocity_mean"),
        F.max("speed").alias("max_velocity"),
        F.stddev_pop("speed").alias("velocity_stddev"),
    )


def measurement_jitter(measured: DataFrame, keys=("recording", "measurement_name"), order: str = "frame", fps: int = 100, share: float = 0.999) -> DataFrame:
    """Per measurement: deviations, speeds, a high percentile of the speed, and each relative to the mean."""
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*keys).orderBy(order))) * fps
    mean = measured.groupBy(*keys).agg(F.avg("value").alias("mean"))
    rows = measured.withColumn("speed", step).join(mean, list(keys)).withColumn("deviation", F.abs(F.col("value") - F.col("mean")))
    found = rows.groupBy(*keys, "mean").agg(
        F.stddev_pop("value").alias("std"),
        F.min("deviation").alias("min_deviation"),
        F.max("deviation").alias("max_deviation"),
        F.avg("speed").alias("mean_speed"),
        F.min("speed").alias("min_speed"),
        F.max("speed").alias("max_speed"),
        F.percentile("speed", F.lit(share)).alias("high_speed"),
    )
    relative = {f"rel_{c}": F.try_divide(F.col(c), F.col("mean")) for c in ("std", "min_deviation", "max_deviation", "mean_speed")}
    return found.withColumns(relative | {"rel_high_speed": F.try_divide(F.col("high_speed"), F.col("mean_speed"))})


def movement_events(measured: DataFrame, jitter: DataFrame, keys=("recording", "measurement_name"), order: str = "frame", fps: int = 100) -> DataFrame:
    """Frames that move faster than the still period's high percentile."""
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*keys).orderBy(order))) * fps
    limit = jitter.select(*keys, F.col("high_speed").alias("limit"))
    return measured.withColumn("speed", step).join(limit, list(keys)).filter("speed > limit")


def artefact_frames(points: DataFrame) -> DataFrame:
    """Frames of a keypoint whose score is missing, or low with one camera at most."""
    bad = F.col("score").isNull() | F.isnan("score") | ((F.col("ncams") <= 1) & (F.col("score") < 0.8))
    return points.filter(bad).select("recording", "frame", "keypoint")


def artefacts_of(measurement_points: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Distinct frames per measurement in which one of its keypoints is an artefact. The mapping has a few rows per measurement."""
    return artefacts.join(F.broadcast(measurement_points), "keypoint").select("recording", "measurement_name", "frame").distinct()


def clean_measurements(measured: DataFrame, artefacts: DataFrame, width: int = 10) -> DataFrame:
    """Values around artefacts are masked and interpolated."""
    from . import series

    keys = ("recording", "measurement_name")
    flagged = measured.join(artefacts.withColumn("_bad", F.lit(True)), [*keys, "frame"], "left")
    masked = series.mask_around(flagged, F.coalesce("_bad", F.lit(False)), width, "value", keys, "frame").drop("_bad")
    return series.interpolate(masked, "value", keys, "frame")
