"""Queries on round trips through files, channel maps and cleaning, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from posegrid.functions.measurements import KEYPOINTS
from posegrid.operators import pose, series, spikes, sync, tables
from posegrid.sources import derived, readers
from posegrid.sources.scratch import scratch_folder

from .series import ALIGN, EDGES, INTERPOLATED, POSE, S, SPIKES, SYNC, W

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(run):
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


def _r(column, digits=4):
    return F.round(column, digits)


@query("s01_pose_csv", f"WITH {POSE} SELECT CAST(recording AS BIGINT) AS recording, CAST(frame AS BIGINT) AS frame, list_extract({list(KEYPOINTS)!r}, kp + 1) AS keypoint, round(x, 3) AS x, round(z, 3) AS z FROM pose")
def _(spark, sf):
    """Poses written as CSV files, one folder per recording, and read back long by their header."""
    folder = scratch_folder(spark, "pose-csv")
    names = KEYPOINTS
    wide = derived.pose_wide(spark, sf)
    columns = [_r(f"`{n}_{a}`", 3).alias(f"{n}_{a}") for n in names for a in "xyz"]
    wide.select(F.col("recording").alias("of"), "frame", *columns).write.partitionBy("of").option("header", True).csv(folder)
    long = readers.read_pose3d(spark, folder, list(names), layout="long", folder_key="of")
    return long.select(F.col("recording").cast("long").alias("recording"), "frame", "keypoint", "x", "z")


@query("s14_alignment_json", f"WITH {SYNC} SELECT 'ref' AS reference, 'u' || recording AS target, round((recording % 7) / 100.0, 4) AS lag_time, 1.0::DOUBLE AS slope FROM (SELECT DISTINCT recording FROM r) WHERE recording % 7 > 0")
def _(spark, sf):
    users = derived.sync_reference(spark, sf).select("recording").distinct()
    late = F.when(F.col("recording") % 7 > 0, F.col("recording") % 7 / 100.0)
    none = F.lit(None).cast("double")
    rows = users.select(
        F.lit("ref").alias("reference"), F.concat(F.lit("u"), F.col("recording").cast("string")).alias("target"), late.alias("lag_time"), F.lit(1.0).alias("slope"),
        F.lit(100.0).alias("sample_rate"), none.alias("time_start"), none.alias("time_end"),
    )
    folder = scratch_folder(spark, "alignment")
    readers.write_alignment(rows, folder)
    return readers.read_alignment(spark, folder).select("reference", "target", _r("lag_time").alias("lag_time"), "slope")


@query("s15_cached_table", f"WITH {S} SELECT recording, count(*) AS n, round(avg(v), 4) AS mean FROM s GROUP BY recording")
def _(spark, sf):
    folder = scratch_folder(spark, "cache")
    means = derived.series(spark, sf).groupBy("recording").agg(F.count("*").alias("n"), _r(F.avg("v")).alias("mean"))
    readers.cache_table(means, folder)
    return readers.cache_table(means.limit(0), folder)  # the second call finds the first one's table


@query(
    "s16_cameras",
    "SELECT 'cam' || n_nationkey AS camera, 1280 AS width, 800.0::DOUBLE + n_nationkey AS fx, 512.0::DOUBLE AS cy, n_regionkey / 10.0 AS turn FROM nation",
)
def _(spark, sf):
    """A calibration file per region, with a camera per nation, written and read."""
    n = derived.table(spark, sf, "nation")
    fx = F.lit(800.0) + F.col("n_nationkey")
    row = lambda *x: F.array(*(v if hasattr(v, "alias") else F.lit(float(v)) for v in x))
    camera = F.struct(
        F.concat(F.lit("cam"), F.col("n_nationkey").cast("string")).alias("name"), F.array(F.lit(1280), F.lit(1024)).alias("size"), F.array(row(fx, 0, 640), row(0, fx, 512), row(0, 0, 1)).alias("matrix"),
        row(0, 0, 0, 0, 0).alias("distortions"), row(F.col("n_regionkey") / 10.0, 0, 0).alias("rotation"), row(0, 0, 100).alias("translation"),
    )
    files = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")), camera))).alias("cameras"))
    folder = scratch_folder(spark, "calibration")
    files.select(F.to_json("cameras").alias("value"), F.concat(F.lit("calibration-"), F.col("n_regionkey").cast("string")).alias("name")).write.partitionBy("name").text(folder)
    read = readers.read_cameras(spark, folder + "/name=*")
    turn = F.get("rotation", F.lit(0)).alias("turn")
    return read.select("camera", "width", "fx", "cy", turn)


@query(
    "a12_interval_differences",
    f"""WITH {ALIGN}, {EDGES % 'r'}, a AS (SELECT recording, edge, row_number() OVER (PARTITION BY recording ORDER BY edge) AS k FROM e),
    e2 AS (SELECT recording, idx AS edge FROM (SELECT *, lead("on") {W}) AS nx FROM z) WHERE nx - "on" > 0), b AS (SELECT recording + 1 AS recording, edge, row_number() OVER (PARTITION BY recording ORDER BY edge) AS k FROM e2),
    d AS (SELECT a.recording, (b.edge - lag(b.edge) OVER p) - (a.edge - lag(a.edge) OVER p) AS v FROM a JOIN b USING (recording, k) WINDOW p AS (PARTITION BY a.recording ORDER BY a.k)),
    l AS (SELECT recording, v, min(v) OVER (PARTITION BY recording) AS lo, max(v) OVER (PARTITION BY recording) AS hi FROM d WHERE v IS NOT NULL)
    SELECT recording, least(CAST(floor(coalesce((v - lo) / nullif((hi - lo)::DOUBLE, 0), 0) * 50) AS BIGINT), 49) AS bin, count(*) AS n FROM l GROUP BY ALL""",
)
def _(spark, sf):
    from pyspark.sql import Window

    r = series.rising_edges(derived.sync_reference(spark, sf))
    t = series.rising_edges(derived.sync_target(spark, sf)).withColumn("recording", F.col("recording") + 1)
    over = Window.partitionBy("recording").orderBy("k")
    gap = lambda c: F.col(c) - F.lag(c).over(over)
    differences = sync.ordinal_pairs(r, t).withColumn("v", (gap("edge_t") - gap("edge_r")).cast("double")).filter("v is not null")
    return tables.equal_bins(differences, 50).groupBy("recording", "bin").agg(F.count("*").alias("n"))


@query(
    "j09_neighbour_channels",
    """WITH c AS (SELECT DISTINCT event_id % 8 AS channel FROM events), p AS (SELECT channel, channel % 2 AS shank, channel // 2 AS position FROM c)
    SELECT channel, neighbour, place FROM (SELECT a.channel, b.channel AS neighbour, row_number() OVER (PARTITION BY a.channel ORDER BY abs(a.position - b.position) + CASE WHEN a.shank <> b.shank THEN 0.5 ELSE 0 END, b.channel) AS place FROM p a, p b) WHERE place <= 5""",
)
def _(spark, sf):
    channels = derived.samples(spark, sf).select("channel").distinct()
    channels = channels.select("channel", (F.col("channel") % 2).alias("shank"), F.expr("channel div 2").alias("position"))
    return spikes.neighbour_channels(channels, 5)


@query(
    "g27_filter_pose2d",
    f"""WITH {POSE}, q AS (SELECT recording, kp, frame, x, y, abs(x) / (abs(x) + abs(y) + 1e-9) AS score, quantile_cont(x, 0.5) OVER w AS mx, quantile_cont(y, 0.5) OVER w AS my FROM pose
      WINDOW w AS (PARTITION BY recording, kp ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
    src AS (SELECT recording * 100 + kp AS recording, frame AS idx, CASE WHEN score >= 0.4 AND abs(x - mx) <= 5 AND abs(y - my) <= 5 THEN x END AS v FROM q), {INTERPOLATED}""",
)
def _(spark, sf):
    df = derived.pose_long(spark, sf).select((F.col("recording") * 100 + F.col("kp")).alias("recording"), "kp", "frame", "x", "y", "score")
    done = pose.filter_pose2d(df, 13, 5.0, 0.4, ("recording",))
    return done.select("recording", F.col("frame").alias("idx"), _r("x").alias("v"))


@query("o01_sorted", f"WITH {POSE} SELECT recording, frame, kp, row_number() OVER (PARTITION BY recording ORDER BY frame, kp) AS place FROM pose")
def _(spark, sf):
    from pyspark.sql import Window

    df = derived.pose_long(spark, sf).select("recording", "frame", "kp")
    return df.withColumn("place", F.row_number().over(Window.partitionBy("recording").orderBy("frame", "kp"))).sortWithinPartitions("recording", "place")


@query("s11_read_spikes", f"WITH {SPIKES}, n AS (SELECT unit, dense_rank() OVER (ORDER BY unit) AS cluster FROM sp GROUP BY unit) SELECT cluster AS unit, count(*) AS spikes, round(sum(t_us / 1e6), 3) AS total FROM sp JOIN n USING (unit) GROUP BY 1")
def _(spark, sf):
    """Spike times written as arrays, a file per unit and minute, and read."""
    from pyspark.sql import Window

    found = derived.spikes(spark, sf)
    numbers = found.select("unit").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("unit")))  # a row per unit
    folder = scratch_folder(spark, "spikes")
    readers.write_spikes(found.join(numbers, "unit").select(F.col("cluster").alias("unit"), (F.col("t_us") / 1e6).alias("t")), folder)
    return readers.read_spikes(spark, folder).groupBy("unit").agg(F.count("*").alias("spikes"), _r(F.sum("t"), 3).alias("total"))
