"""Reports on long tables: means, traces, thresholds, lengths, peaks, and what two tables have in common."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_means(df: DataFrame, keys, value: str = "value", name: str = "mean") -> DataFrame:
    """Mean of each group: a region of a view, a run of a test set, a time step over sessions."""
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def mean_trace(df: DataFrame, value: str = "v", order: str = "idx", keys=()) -> DataFrame:
    """Mean over sessions at equal time steps, and how many sessions reach each step."""
    return df.groupBy(*keys, order).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def mean_std(df: DataFrame, value: str = "v", keys=("recording",)) -> DataFrame:
    """Mean, sample deviation and count of each group."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))


def groups_above(df: DataFrame, limit: float, value: str = "v", keys=("recording",)) -> DataFrame:
    """Groups whose population deviation is above a limit."""
    return df.groupBy(*keys).agg(F.stddev_pop(value).alias("std")).filter(F.col("std") > limit)


def extremes(df: DataFrame, value: str = "v", keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"))


def recording_lengths(df: DataFrame, order: str = "idx", keys=("recording",)) -> DataFrame:
    """Frames of each recording, by its last index."""
    return df.groupBy(*keys).agg((F.max(order) + 1).alias("frames"))


def measurement_groups(long: DataFrame) -> DataFrame:
    """(grp, names): the groups of measurements, and how many names each has."""
    return long.groupBy(F.split_part("measurement_name", F.lit("-"), F.lit(1)).alias("grp")).agg(F.countDistinct("measurement_name").alias("names"))


def peak_preserving(df: DataFrame, step: int, value: str = "v", keys=("recording",), order: str = "idx") -> DataFrame:
    """For display: the least and greatest value of every ``step`` samples, and where they are."""
    bucket = F.floor(F.col(order) / step).cast("int").alias("bucket")
    return df.groupBy(*keys, bucket).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.min_by(order, value).alias("at_lo"), F.max_by(order, value).alias("at_hi"))


def keypoints_present(df: DataFrame, keys=("view",), keypoint: str = "keypoint") -> DataFrame:
    """Number and first of the keypoints that a tracker or view has at all."""
    return df.groupBy(*keys).agg(F.countDistinct(keypoint).alias("n"), F.min(keypoint).alias("first"))


def common_views(first: DataFrame, second: DataFrame, view: str = "view") -> DataFrame:
    """Views that both trackers have."""
    return first.select(view).intersect(second.select(view))


def common_view_means(points: DataFrame, views: DataFrame, region: Column, value: str = "x", keypoint: str = "kp") -> DataFrame:
    """(region, mean): means of keypoints in the common views, then of regions without their side."""
    means = points.join(views, "view", "left_semi").groupBy("view", keypoint).agg(F.avg(value).alias("_mean"))
    return means.groupBy(F.split_part(region, F.lit("("), F.lit(1)).alias("region")).agg(F.avg("_mean").alias("mean"))


def common_view_speed(trackers: dict[str, DataFrame], views: DataFrame, fps: int = 100, keys=("mouse", "kp"), order: str = "frame") -> DataFrame:
    """(kp, a column per tracker): mean speed of each keypoint in the common views, trackers side by side."""
    both = reduce(DataFrame.unionByName, (df.withColumn("tracker", F.lit(name)) for name, df in trackers.items())).join(views, "view", "left_semi")
    over = Window.partitionBy("tracker", *keys).orderBy(order)
    step = lambda a: F.col(a) - F.lag(a).over(over)
    moving = both.select("tracker", keys[-1], (F.sqrt(step("x") * step("x") + step("y") * step("y")) * fps).alias("_speed"))
    return moving.groupBy(keys[-1]).pivot("tracker", list(trackers)).agg(F.avg("_speed"))


def frames_of_any(*frames: DataFrame) -> DataFrame:
    """Rows of at least one table, each once."""
    return reduce(DataFrame.union, frames).distinct()


def frames_of_all(*frames: DataFrame) -> DataFrame:
    """Rows that all tables have."""
    return reduce(DataFrame.intersect, frames)


def frames_of_first(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the first table that the second lacks."""
    return first.subtract(second)


def peaks(df: DataFrame, value: str = "v", keys=("recording",), order: str = "idx") -> DataFrame:
    """Greatest value of each series and where; of equal ones the first."""
    return df.groupBy(*keys).agg(F.max_by(order, F.struct(value, -F.col(order))).alias(order), F.max(value).alias(value))


def downsample_factor(df: DataFrame, seconds: float, rate: float = 100.0, keys=("recording",)) -> DataFrame:
    """Samples of each series and the whole factor from ``rate`` down to its own rate over ``seconds``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.floor(rate / (F.count("*") / seconds)).alias("factor"))
