"""Tables of poses, signals, spikes and annotations, shaped by Spark from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posegrid.functions.measurements import KEYPOINTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("recording"), (F.row_number().over(order) - 1).alias("frame"), "embedding")


def pose_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per frame, three columns per keypoint."""
    columns = [
        (100 * F.get("embedding", F.lit((3 * k + i) % 64)).cast("double")).alias(f"{name}_{axis}")
        for k, name in enumerate(KEYPOINTS)
        for i, axis in enumerate("xyz")
    ]
    return frames(spark, sf_dir).select("recording", "frame", *columns)


def pose_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per frame and keypoint: recording, frame, kp, keypoint, x, y, z, score, ncams."""
    at = lambda i: (100 * F.get("embedding", F.pmod(3 * F.col("kp") + i, F.lit(64))).cast("double"))
    names = F.array(*map(F.lit, KEYPOINTS))
    rows = frames(spark, sf_dir).withColumn("kp", F.explode(F.sequence(F.lit(0), F.lit(len(KEYPOINTS) - 1))))
    rows = rows.select("recording", "frame", "kp", F.get(names, "kp").alias("keypoint"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    score = F.abs("x") / (F.abs("x") + F.abs("y") + 1e-9)
    return rows.withColumns({"score": score, "ncams": 1 + (F.col("frame") + F.col("kp")) % 6})


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, idx, v, event_id: one value series per event type."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("recording"), (F.row_number().over(order) - 1).alias("idx"), F.col("value").alias("v"), "event_id")


def series_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("v")))


def sync_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, idx, on: one binary signal per user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("recording"), (F.row_number().over(order) - 1).alias("idx"), (F.col("value") > 60).cast("int").alias("on"))


def sync_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference signal, late by ``recording % 7`` samples of zeros."""
    ref = sync_reference(spark, sf_dir)
    late = ref.select("recording", (F.col("idx") + F.col("recording") % 7).cast("int").alias("idx"), "on")
    zeros = ref.select("recording").distinct().withColumn("n", (F.col("recording") % 7).cast("int")).filter("n > 0")
    zeros = zeros.select("recording", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"), F.lit(0).alias("on"))
    return late.unionByName(zeros)


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, t_us: spike times of 0 to 600 s in whole microseconds."""
    e = table(spark, sf_dir, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = e.agg(F.min("us").alias("first"))
    return e.join(F.broadcast(first)).select(F.col("event_type").alias("unit"), F.expr("(us - first) div 4320").alias("t_us"))


def movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, v: a 100 Hz grid that spans the spikes."""
    last = spikes(spark, sf_dir).agg((F.expr("max(t_us) div 10000") + 1).alias("n"))
    grid = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("frame"))
    return grid.select("frame", (F.pmod(F.col("frame") * 37, F.lit(101)) / 101.0).alias("v"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, sample, v: eight sampled channels."""
    order = Window.partitionBy("channel").orderBy("event_id")
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 8).alias("channel"), "event_id", F.col("value").alias("v"))
    return e.select("channel", (F.row_number().over(order) - 1).alias("sample"), "v")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: file names that carry date, animal, type and view."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kind = F.when(key % 5 == 0, "cal").when(key % 2 == 0, "awake").otherwise("anes")
    views = F.array(*map(F.lit, ("TL", "TR", "L", "R", "TC", "BC")))
    name = F.concat(
        F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_B"), (F.col("o_custkey") % 50).cast("string"), F.lit("_chew_"), kind, F.lit("_000_"),
        F.get(views, (key % 6).cast("int")), F.lit("_fullres_12-00-00.avi"),
    )
    return o.select(name.alias("path"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filename, keypoint, x, y: labelled points of images, null where the point was not visible; one row per point."""
    line = table(spark, sf_dir, "lineitem")
    seen = F.col("l_returnflag") != "R"
    rows = line.select(
        F.concat(F.lit("img"), F.col("l_orderkey").cast("string"), F.lit(".png")).alias("filename"),
        F.concat(F.lit("kp"), F.col("l_linenumber").cast("string")).alias("keypoint"),
        F.when(seen, F.col("l_quantity")).alias("x"),
        F.when(seen, F.col("l_extendedprice") / 100).alias("y"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )
    return rows
