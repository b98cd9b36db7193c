"""Tables of labelled image points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def annotations_nested(points: DataFrame) -> DataFrame:
    """(keypoint, files): map of file to [x, y] or null. The first row of a (keypoint, file) stays, by x then y."""
    one = points.groupBy("keypoint", "filename").agg(F.min(F.struct("x", "y")).alias("p"))
    xy = F.when(F.col("p.x").isNotNull() & F.col("p.y").isNotNull(), F.array("p.x", "p.y"))
    return one.groupBy("keypoint").agg(F.map_from_entries(F.collect_list(F.struct(F.col("filename"), xy.alias("xy")))).alias("files"))


def annotations_long(nested: DataFrame) -> DataFrame:
    """A row per (filename, keypoint), with null coordinates where nothing was marked."""
    rows = nested.select("keypoint", F.explode("files").alias("filename", "xy"))
    return rows.select("filename", "keypoint", F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y"))


def complete_annotations(points: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Every file with every configured keypoint (a few dozen names, broadcast), null where there is no row."""
    grid = points.select("filename").distinct().join(F.broadcast(keypoints.select("keypoint").distinct()))
    return grid.join(points, ["filename", "keypoint"], "left")


def conflicts(points: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Names that only one of annotations and configuration has."""
    a, b = points.select("keypoint").distinct(), keypoints.select("keypoint").distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("annotations")).union(b.exceptAll(a).withColumn("only_in", F.lit("configuration")))


def annotations_pivot(points: DataFrame, keypoints: list[str]) -> DataFrame:
    """A row per file; two columns per keypoint."""
    return points.groupBy("filename").pivot("keypoint", keypoints).agg(F.min("x").alias("x"), F.min("y").alias("y"))


def annotations_unpivot(wide: DataFrame, keypoints: list[str]) -> DataFrame:
    parts = ", ".join(f"'{k}', `{k}_x`, `{k}_y`" for k in keypoints)
    return wide.select("filename", F.expr(f"stack({len(keypoints)}, {parts}) as (keypoint, x, y)"))


def missing_images(images: DataFrame, points: DataFrame) -> DataFrame:
    return images.join(points.select("filename"), "filename", "left_anti")
