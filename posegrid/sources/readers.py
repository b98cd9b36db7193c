"""Readers and writers of recordings, with declared schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pose3d(spark: SparkSession, path: str, keypoints: list[str], extra: tuple[str, ...] = (), layout: str = "wide", folder_key: str | None = None) -> DataFrame:
    """Pose CSVs with a header: recording (the file's stem, or the value of a ``key=value`` folder), frame and the columns of each keypoint, wide or long.

    Frames come from a ``frame`` column; rows have no order of their own on a cluster.
    """
    names = [f"{k}_{c}" for k in keypoints for c in ("x", "y", "z", *extra)]
    schema = T.StructType([T.StructField("frame", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    path_of = F.col("_metadata.file_path")
    recording = F.regexp_extract(F.url_decode(path_of), f"{folder_key}=([^/]*)/", 1) if folder_key else stem(path_of)
    wide = rows.select(recording.alias("recording"), *schema.names)
    if layout == "wide":
        return wide
    columns = ["x", "y", "z", *extra]
    parts = ", ".join(f"'{k}', " + ", ".join(f"`{k}_{c}`" for c in columns) for k in keypoints)
    return wide.select("recording", "frame", F.expr(f"stack({len(keypoints)}, {parts}) as (keypoint, {', '.join(columns)})"))


def keypoints_of(header: list[str]) -> list[str]:
    """Names that have x, y and z in a header."""
    return sorted({c[:-2] for c in header if c.endswith("_x") and {c[:-2] + "_y", c[:-2] + "_z"} <= set(header)})


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.url_decode(path), r"([^/]+)$", 1), r"\.[^.]*$", "")


def pose2d_long(df: DataFrame, view_keypoints: DataFrame) -> DataFrame:
    """Points in the views that can see them; ``view_keypoints`` (view, keypoint) is configuration, some dozen rows.

    A table without ``view`` gets a row for each view of its keypoint.
    """
    on = ["view", "keypoint"] if "view" in df.columns else ["keypoint"]
    return df.join(F.broadcast(view_keypoints), on)


def normalise_side(df: DataFrame) -> DataFrame:
    """Eye names of a tracker without sides get the side of the view."""
    left = F.col("view").isin("L", "TL", "TC")
    side = F.when(left, "(left)").otherwise("(right)")
    bare = F.col("keypoint").startswith("eye") & ~F.col("keypoint").contains("left") & ~F.col("keypoint").contains("right")
    return df.withColumn("keypoint", F.when(bare, F.concat("keypoint", side)).otherwise(F.col("keypoint")))


def read_signal_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless text of ``H:M:S:f`` and a value: recording, seconds (of day), v."""
    rows = spark.read.option("sep", "\t").schema("timestamp string, v double").csv(path)
    return rows.select(stem(F.col("_metadata.file_path")).alias("recording"), seconds_of(F.col("timestamp")).alias("seconds"), "v")


def seconds_of(timestamp: Column) -> Column:
    """Seconds of day; the fraction's digits are decimals, whatever their number."""
    part = lambda i: F.split_part(timestamp, F.lit(":"), F.lit(i))
    return part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int") + F.concat(F.lit("0."), part(4)).cast("double")


def estimate_sample_rate(df: DataFrame, nominal: float, tolerance: float = 0.1, key: str = "recording") -> DataFrame:
    """Rate from first and last time of each key, or the nominal rate if they agree within the tolerance."""
    span = df.groupBy(key).agg((F.count("*") - 1).alias("n"), F.min("seconds").alias("a"), F.max("seconds").alias("b"))
    rate = F.try_divide(F.col("n"), F.col("b") - F.col("a"))
    return span.select(key, F.when(F.abs(rate - nominal) > tolerance * nominal, rate).otherwise(F.lit(float(nominal))).alias("rate"))


def trim_leading_zeros(df: DataFrame, rate: float, key: str = "recording") -> DataFrame:
    """Samples from the first that isn't zero (missing counts as zero), re-indexed, with the offset in seconds."""
    filled = df.withColumn("v", F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0)))
    first = filled.filter("v <> 0").groupBy(key).agg(F.min("idx").alias("_first"))
    kept = filled.join(first, key).filter("idx >= _first")
    return kept.withColumn("idx", F.col("idx") - F.col("_first")).withColumn("offset", F.col("_first") / rate).drop("_first")


def write_features(df: DataFrame, path: str, key: str = "recording") -> None:
    """Appends the recordings that the folder lacks.

    The key is a column of the files, sorted in each: a folder for each recording would cost files and listings
    with their number, and readers of one recording skip by the files' statistics.
    """
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(key).distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        there = None
    new = df if there is None else df.join(there, key, "left_anti")
    new.sortWithinPartitions(key).write.mode("append").parquet(path)


ALIGNMENT_SCHEMA = "reference string, target string, lag_time double, slope double, sample_rate double, time_start double, time_end double"


def write_alignment(df: DataFrame, path: str) -> None:
    """One JSON object per target; targets without a lag are left out, missing values are real nulls."""
    df.filter("lag_time is not null").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALIGNMENT_SCHEMA).json(path)


def read_spikes(spark: SparkSession, path: str) -> DataFrame:
    """Spike times of ``.npy`` files (doubles, one dimension): unit from ``clusterN`` in the name, seconds."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for batch in batches:
            for unit, data in zip(batch.column("unit").to_pylist(), batch.column("content").to_pylist()):
                times = np.load(io.BytesIO(data), allow_pickle=False).astype("f8").ravel()
                yield pa.RecordBatch.from_arrays([pa.array([unit] * len(times), pa.int64()), pa.array(times)], names=["unit", "t"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    named = files.select(F.regexp_extract("path", r"cluster(\d+)", 1).cast("long").alias("unit"), "content")
    return named.mapInArrow(load, "unit long, t double")


def unit_table(units: DataFrame, session: str) -> DataFrame:
    """Units of a session by depth, names from their twelfth character."""
    return units.filter(F.col("session") == session).select("depth", F.expr("substring(name, 12)").alias("name")).orderBy("depth", "name")


def select_signals(df: DataFrame, kind: str, n_channels: int) -> DataFrame:
    """Channels by class: all but the last six are primary, then two auxiliary, two digital in, two digital out."""
    ends = {"primary": (0, n_channels - 6), "aux": (n_channels - 6, n_channels - 4), "digital_in": (n_channels - 4, n_channels - 2), "digital_out": (n_channels - 2, n_channels)}
    low, high = ends[kind]
    return df.filter((F.col("channel") >= low) & (F.col("channel") < high))


def cache_table(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, made from ``df`` if it isn't there."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


CALIBRATION = "map<string, struct<name: string, size: array<int>, matrix: array<array<double>>, distortions: array<double>, rotation: array<double>, translation: array<double>>>"


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """A row per camera of every JSON calibration in a folder: file, camera, width, height, fx, fy, cx, cy, rotation, translation, distortions."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", CALIBRATION).alias("c"))
    c = files.select("file", F.explode("c").alias("key", "c")).filter("c.matrix is not null")
    at = lambda i, j: F.get(F.get("c.matrix", F.lit(i)), F.lit(j))
    return c.select(
        F.element_at(F.split("file", "/"), -1).alias("file"), F.coalesce("c.name", "key").alias("camera"), F.get("c.size", F.lit(0)).alias("width"), F.get("c.size", F.lit(1)).alias("height"),
        at(0, 0).alias("fx"), at(1, 1).alias("fy"), at(0, 2).alias("cx"), at(1, 2).alias("cy"), "c.rotation", "c.translation", "c.distortions",
    )


def write_spikes(spikes: DataFrame, folder: str, part_seconds: int = 60) -> None:
    """Spike times (unit number, t in seconds) as ``.npy`` files in ``folder``, a URI, a file per unit and part of the session."""

    def each(group):
        import io

        import numpy as np
        from pyarrow.fs import FileSystem

        store, path = FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        data = io.BytesIO()
        np.save(data, np.sort(group["t"].to_numpy()))
        with store.open_output_stream(f"{path}/cluster{int(group['unit'].iloc[0])}-{int(group['part'].iloc[0]):06d}.npy") as out:
            out.write(data.getvalue())
        return group[["unit"]].head(1)

    parts = spikes.select(F.col("unit").cast("long"), F.col("t").cast("double"), F.floor(F.col("t") / part_seconds).alias("part"))
    parts.groupBy("unit", "part").applyInPandas(each, "unit long").write.format("noop").mode("overwrite").save()


def read_calibration(text: str) -> dict[str, dict]:
    """Cameras of a JSON calibration, by name."""
    found = json.loads(text)
    return {c.get("name", key): c for key, c in found.items() if isinstance(c, dict) and "matrix" in c}

