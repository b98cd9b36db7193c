"""Queries on joins, aggregates and jitter, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from posegrid.functions import measurements as m
from posegrid.operators import jitter, series, summaries, tables
from posegrid.sources import derived

from .geometry import SQL_LONG
from .series import G, INTERPOLATED, POSE, S, SPIKES, SYNC, W

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(run):
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


def _r(column, digits=4):
    return F.round(column, digits)


def _all(df, keys, digits=4):
    return df.select(*keys, *(_r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys))


# ---- joins


@query(
    "j01_two_sources",
    f"""WITH {SQL_LONG}, a AS (SELECT recording % 5 AS mouse, recording >= 5 AS scan, measurement_name, avg(value) AS v FROM ml GROUP BY ALL)
    SELECT r.mouse, r.measurement_name, round(r.v, 4) AS value_rig, round(s.v, 4) AS value_scan, round(abs(r.v - s.v), 4) AS abs_error, round(abs(r.v - s.v) / nullif(s.v, 0), 4) AS rel_error
    FROM a r JOIN a s ON r.mouse = s.mouse AND r.measurement_name = s.measurement_name AND NOT r.scan AND s.scan""",
)
def _(spark, sf):
    long = m.long(m.measurements(derived.pose_wide(spark, sf)))
    means = long.groupBy((F.col("recording") % 5).alias("mouse"), (F.col("recording") >= 5).alias("scan"), "measurement_name").agg(F.avg("value").alias("v"))
    rig = means.filter("not scan").select("mouse", "measurement_name", F.col("v").alias("value_rig"))
    scan = means.filter("scan").select("mouse", "measurement_name", F.col("v").alias("value_scan"))
    error = F.abs(F.col("value_rig") - F.col("value_scan"))
    both = rig.join(scan, ["mouse", "measurement_name"]).withColumns({"abs_error": error, "rel_error": F.try_divide(error, F.col("value_scan"))})
    return _all(both, ["mouse", "measurement_name"])


@query(
    "j04_ordinal_pairs",
    f"""WITH {SYNC}, e AS (SELECT recording, idx AS edge FROM (SELECT *, lead("on") {W}) AS nx FROM r) WHERE nx - "on" > 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY edge) AS k FROM e)
    SELECT a.recording, a.k, a.edge AS edge_a, b.edge AS edge_b FROM n a JOIN n b ON b.recording = a.recording + 1 AND a.k = b.k""",
)
def _(spark, sf):
    from posegrid.operators import sync

    edges = series.rising_edges(derived.sync_reference(spark, sf))
    other = edges.withColumn("recording", F.col("recording") - 1)
    return sync.ordinal_pairs(edges, other).select("recording", "k", F.col("edge_r").alias("edge_a"), F.col("edge_t").alias("edge_b"))


MOVE = f"{SPIKES}, mv AS (SELECT frame, ((frame * 37) % 101) / 101.0::DOUBLE AS v FROM (SELECT unnest(range((SELECT max(t_us) // 10000 + 2 FROM sp))) AS frame))"


@query("j05_spike_frames", f"WITH {MOVE} SELECT unit, t_us, mv.frame, round(v, 6) AS v FROM sp JOIN mv ON mv.frame = t_us // 10000")
def _(spark, sf):
    sp = derived.spikes(spark, sf).withColumn("frame", tables.frame_of(F.col("t_us")))
    return sp.join(derived.movement(spark, sf), "frame").select("unit", "t_us", "frame", _r("v", 6).alias("v"))


NEAR = f"""{SPIKES}, d AS (SELECT unit, t_us, min(t_us) AS s FROM sp GROUP BY unit, t_us),
 q AS (SELECT unit, (t_us + 777777) AS t FROM sp)"""


@query(
    "j07_nearest",
    f"""WITH {NEAR}, b AS (SELECT q.unit, q.t, s.t_us AS before FROM q ASOF LEFT JOIN d s ON q.unit = s.unit AND q.t >= s.t_us),
    a AS (SELECT q.unit, q.t, min(s.t_us) AS after FROM (SELECT DISTINCT unit, t FROM q) q LEFT JOIN d s ON s.unit = q.unit AND s.t_us >= q.t GROUP BY q.unit, q.t)
    SELECT b.unit, b.t, CASE WHEN before IS NULL OR after - b.t < b.t - before THEN after ELSE before END AS s FROM b JOIN a ON a.unit = b.unit AND a.t = b.t""",
)
def _(spark, sf):
    sp = derived.spikes(spark, sf)
    samples = sp.distinct().select("unit", F.col("t_us").alias("s"), F.lit(0.0).alias("v"))
    times = sp.select("unit", (F.col("t_us") + 777777).alias("t"))
    return tables.nearest(times, samples, "unit", 5_000_000).select("unit", "t", "s")


SAMPLES = "sm AS (SELECT event_id % 8 AS channel, CAST(row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) - 1 AS BIGINT) AS sample, value AS v FROM events)"


@query(
    "j08_waveforms",
    f"""WITH {SAMPLES}, k AS (SELECT channel, sample AS spike FROM sm WHERE v > 450)
    SELECT k.channel, off, count(*) AS n, round(avg(v), 4) AS mean_v FROM k, (SELECT unnest(range(-10, 10)) AS off) JOIN sm ON sm.channel = k.channel AND sm.sample = spike + off GROUP BY ALL""",
)
def _(spark, sf):
    from posegrid.operators import spikes

    sm = derived.samples(spark, sf)
    peaks = sm.filter("v > 450").select("channel", F.col("sample").alias("spike"))
    found = spikes.waveform_rows(peaks, sm)
    return found.groupBy("channel", "off").agg(F.count("*").alias("n"), _r(F.avg("v")).alias("mean_v"))


POST = f"""{POSE}, pre AS (SELECT recording AS mouse, kp % 6 AS view, kp, frame, x, y FROM pose), post AS (SELECT recording AS mouse, kp % 6 AS view, kp, frame, round(x, 1) AS x, round(y, 1) AS y FROM pose)"""


def _pre_post(spark, sf):
    pose = derived.pose_long(spark, sf).select(F.col("recording").alias("mouse"), (F.col("kp") % 6).alias("view"), "kp", "frame", "x", "y")
    return pose, pose.withColumns({"x": F.round("x", 1), "y": F.round("y", 1)})


@query(
    "j10_paired",
    f"""WITH {POST}, a AS (SELECT mouse, view, kp, stddev_pop(x) AS s FROM pre GROUP BY ALL), b AS (SELECT mouse, view, kp, stddev_pop(x) AS s FROM post GROUP BY ALL)
    SELECT mouse, view, kp, round(a.s, 4) AS before, round(b.s, 4) AS after FROM a JOIN b USING (mouse, view, kp)""",
)
def _(spark, sf):
    before, after = (d.groupBy("mouse", "view", "kp").agg(_r(F.stddev_pop("x")).alias(n)) for d, n in zip(_pre_post(spark, sf), ("before", "after")))
    return before.join(after, ["mouse", "view", "kp"])


@query("j11_common_views", f"WITH {POSE} SELECT DISTINCT kp, kp % 6 AS view FROM pose WHERE kp % 2 = 0 INTERSECT SELECT DISTINCT kp, kp % 6 FROM pose WHERE kp % 3 = 0")
def _(spark, sf):
    seen = derived.pose_long(spark, sf).select("kp", (F.col("kp") % 6).alias("view"))
    return seen.filter("kp % 2 = 0").intersect(seen.filter("kp % 3 = 0"))


PARTS = [(n, k) for n, ks in {"mouth-area-mm2": ("lowerlip", "upperlip(left)", "upperlip(right)"), "eye-height-left-mm": ("eye(top)(left)", "eye(bottom)(left)")}.items() for k in ks]
ART = f"""{POSE}, sc AS (SELECT *, abs(x) / (abs(x) + abs(y) + 1e-9) AS score, 1 + (frame + kp) % 6 AS ncams FROM pose),
  bad AS (SELECT recording, frame, kp FROM sc WHERE ncams <= 1 AND score < 0.8),
  parts(measurement_name, kp) AS (VALUES {", ".join(f"('{n}', {m.KEYPOINTS.index(k)})" for n, k in PARTS)}),
  art AS (SELECT DISTINCT recording, measurement_name, frame FROM bad JOIN parts USING (kp))"""


@query("d11_artefact_frames", f"WITH {ART} SELECT recording, frame, list_extract({list(m.KEYPOINTS)!r}, kp + 1) AS keypoint FROM bad")
def _(spark, sf):
    return jitter.artefact_frames(derived.pose_long(spark, sf))


def _artefacts(spark, sf):
    parts = spark.createDataFrame(PARTS, "measurement_name string, keypoint string")
    return jitter.artefacts_of(parts, jitter.artefact_frames(derived.pose_long(spark, sf)))


@query("j12_measurement_artefacts", f"WITH {ART} SELECT recording, measurement_name, frame FROM art")
def _(spark, sf):
    return _artefacts(spark, sf)


@query(
    "d12_clean_measurements",
    f"""WITH {SQL_LONG}, {ART.replace("f AS", "f_ AS", 1).replace("FROM f,", "FROM f_,")},
    sel AS (SELECT * FROM ml),
    fl AS (SELECT s.*, art.frame IS NOT NULL AS b FROM sel s LEFT JOIN art USING (recording, measurement_name, frame)),
    src AS (SELECT recording || '/' || measurement_name AS recording, frame AS idx, CASE WHEN max(CAST(b AS INTEGER)) OVER (PARTITION BY recording, measurement_name ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) = 0 THEN value END AS v FROM fl),
    {INTERPOLATED}""",
)
def _(spark, sf):
    long = m.long(m.measurements(derived.pose_wide(spark, sf)))
    done = jitter.clean_measurements(long, _artefacts(spark, sf), 2)
    return done.select(F.concat(F.col("recording").cast("string"), F.lit("/"), "measurement_name").alias("recording"), F.col("frame").alias("idx"), _r("value").alias("v"))


# ---- jitter and aggregates

LONGXYZ = f"{POSE}, l AS (UNPIVOT (SELECT recording, kp, frame, x, y, z FROM pose) ON x, y, z INTO NAME axis VALUE value)"


@query(
    "a01_point_jitter",
    f"""WITH {LONGXYZ}, d AS (SELECT recording, kp, axis, value, abs(value - lag(value) OVER (PARTITION BY recording, kp, axis ORDER BY frame)) * 100 AS sp, (value - avg(value) OVER (PARTITION BY recording, kp, axis)) * 1000 AS dev FROM l)
    SELECT recording, kp, axis, round(stddev_pop(value), 4) AS position_stddev, round(min(dev), 3) AS min_deviation, round(max(dev), 3) AS max_deviation, round(avg(sp), 4) AS velocity_mean, round(min(sp), 4) AS min_velocity, round(max(sp), 4) AS max_velocity FROM d GROUP BY ALL""",
)
def _(spark, sf):
    found = jitter.point_jitter(derived.pose_long(spark, sf), ("recording", "kp"))
    return found.select(
        "recording", "kp", "axis", *(_r(c, 3 if "deviation" in c else 4).alias(c) for c in found.columns[3:])
    )


VECTOR = """d AS (SELECT {k}, sqrt({step}) * 100 AS sp, sqrt({dev}) * 1000 AS dev FROM {src})
    SELECT {k}, round(stddev_pop(dev), 3) AS position_stddev, round(max(dev), 3) AS max_deviation, round(avg(sp), 4) AS velocity_mean, round(max(sp), 4) AS max_velocity, round(stddev_pop(sp), 4) AS velocity_stddev FROM d GROUP BY ALL"""


def _vector(keys, src, axes):
    step = " + ".join(f"pow({a} - lag({a}) OVER (PARTITION BY {keys} ORDER BY frame), 2)" for a in axes)
    dev = " + ".join(f"pow({a} - avg({a}) OVER (PARTITION BY {keys}), 2)" for a in axes)
    return VECTOR.format(k=keys, step=step, dev=dev, src=src)


def _rounded_vector(df, keys):
    return df.select(*keys, *(_r(c, 3 if c in ("position_stddev", "max_deviation") else 4).alias(c) for c in df.columns[len(keys) :]))


@query("a02_vector_jitter", f"WITH {POSE}, {_vector('recording, kp', 'pose', 'xyz')}")
def _(spark, sf):
    return _rounded_vector(jitter.vector_jitter(derived.pose_long(spark, sf), keys=("recording", "kp")), ["recording", "kp"])


@query("a03_pixel_jitter", f"WITH {POST}, {_vector('mouse, view, kp', 'post', 'xy')}")
def _(spark, sf):
    keys = ("mouse", "view", "kp")
    return _rounded_vector(jitter.vector_jitter(_pre_post(spark, sf)[1], ("x", "y"), keys), list(keys))


MJ = f"""{SQL_LONG}, d AS (SELECT recording, measurement_name, value, abs(value - lag(value) OVER (PARTITION BY recording, measurement_name ORDER BY frame)) * 100 AS sp,
   avg(value) OVER (PARTITION BY recording, measurement_name) AS mean FROM ml),
   j AS (SELECT recording, measurement_name, mean, stddev_pop(value) AS std, min(abs(value - mean)) AS min_deviation, max(abs(value - mean)) AS max_deviation, avg(sp) AS mean_speed,
     min(sp) AS min_speed, max(sp) AS max_speed, quantile_cont(sp, 0.999) AS high_speed FROM d GROUP BY ALL)"""


@query(
    "a04_measurement_jitter",
    f"""WITH {MJ} SELECT recording, measurement_name, round(mean, 3) AS mean, round(std, 3) AS std, round(min_deviation, 3) AS min_deviation, round(max_deviation, 3) AS max_deviation, round(mean_speed, 2) AS mean_speed,
    round(min_speed, 2) AS min_speed, round(max_speed, 2) AS max_speed, round(high_speed, 2) AS high_speed, round(std / nullif(mean, 0), 4) AS rel_std, round(high_speed / nullif(mean_speed, 0), 4) AS rel_high_speed FROM j""",
)
def _(spark, sf):
    found = jitter.measurement_jitter(m.long(m.measurements(derived.pose_wide(spark, sf))))
    digits = {"mean": 3, "std": 3, "min_deviation": 3, "max_deviation": 3, "mean_speed": 2, "min_speed": 2, "max_speed": 2, "high_speed": 2, "rel_std": 4, "rel_high_speed": 4}
    return found.select("recording", "measurement_name", *(_r(c, d).alias(c) for c, d in digits.items()))


@query(
    "d10_movement_events",
    f"""WITH {MJ.replace("0.999", "0.9")}, v AS (SELECT recording, measurement_name, frame, abs(value - lag(value) OVER (PARTITION BY recording, measurement_name ORDER BY frame)) * 100 AS sp FROM ml)
    SELECT recording, measurement_name, frame, round(sp, 2) AS speed FROM v JOIN j USING (recording, measurement_name) WHERE sp > high_speed""",
)
def _(spark, sf):
    long = m.long(m.measurements(derived.pose_wide(spark, sf)))
    found = jitter.movement_events(long, jitter.measurement_jitter(long, share=0.9))
    return found.select("recording", "measurement_name", "frame", _r("speed", 2).alias("speed"))


@query("a05_region_means", f"WITH {POST} SELECT view, kp // 9 AS region, round(avg(x), 4) AS mean_x FROM pre GROUP BY ALL")
def _(spark, sf):
    pre = _pre_post(spark, sf)[0].withColumn("region", F.floor(F.col("kp") / 9).cast("int"))
    return summaries.group_means(pre, ["view", "region"], "x").select("view", "region", _r("mean").alias("mean_x"))


@query(
    "a06_common_view_means",
    f"""WITH {POST}, c AS (SELECT DISTINCT view FROM pre WHERE kp < 10 INTERSECT SELECT DISTINCT view FROM post WHERE kp > 23), r AS (SELECT view, kp, avg(x) AS a FROM pre JOIN c USING (view) GROUP BY ALL)
    SELECT CASE WHEN kp <= 2 THEN 'nose' WHEN kp <= 7 THEN 'whiskers' WHEN kp <= 10 THEN 'mouth' WHEN kp <= 18 THEN 'eye' ELSE 'ear' END AS region, round(avg(a), 4) AS mean_x FROM r GROUP BY 1""",
)
def _(spark, sf):
    pre, post = _pre_post(spark, sf)
    common = summaries.common_views(pre.filter("kp < 10"), post.filter("kp > 23"))
    region = tables.region_of(F.get(F.array(*map(F.lit, m.KEYPOINTS)), "kp"))
    return summaries.common_view_means(pre, common, region).select("region", _r("mean").alias("mean_x"))


@query("a07_mean_trace", f"WITH {S} SELECT idx, count(*) AS n, round(avg(v), 4) AS mean_v FROM s GROUP BY idx")
def _(spark, sf):
    return summaries.mean_trace(derived.series(spark, sf)).select("idx", "n", _r("mean").alias("mean_v"))


@query("a08_thresholds", f"WITH {POSE} SELECT recording, kp, round(stddev_pop(x), 4) AS std FROM pose GROUP BY ALL HAVING stddev_pop(x) > 12.5")
def _(spark, sf):
    return summaries.groups_above(derived.pose_long(spark, sf), 12.5, "x", ["recording", "kp"]).select("recording", "kp", _r("std").alias("std"))


@query("a09_mean_std", f"WITH {S} SELECT recording, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, count(*) AS n FROM s GROUP BY recording")
def _(spark, sf):
    return summaries.mean_std(derived.series(spark, sf)).select("recording", _r("mean").alias("mean"), _r("std").alias("std"), "n")


@query(
    "a10_histogram",
    f"""WITH {S}, b AS (SELECT recording, CAST(floor((v - min(v) OVER (PARTITION BY recording)) / 25) AS BIGINT) AS bin FROM s)
    SELECT recording, bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY recording), 4) AS percent FROM b GROUP BY recording, bin""",
)
def _(spark, sf):
    return tables.histogram(derived.series(spark, sf), 25.0).select("recording", "bin", "n", _r("percent").alias("percent"))


BINS = "b AS (SELECT *, least(CAST(floor(coalesce((v - lo) / nullif(hi - lo, 0), 0) * {n}) AS BIGINT), {m}) AS bin FROM (SELECT *, min(v) OVER (PARTITION BY recording) AS lo, max(v) OVER (PARTITION BY recording) AS hi FROM {src}))"


@query("a11_equal_bins", f"WITH {S}, {BINS.format(n=50, m=49, src='s')} SELECT recording, bin, count(*) AS n FROM b GROUP BY ALL")
def _(spark, sf):
    return tables.equal_bins(derived.series(spark, sf), 50).groupBy("recording", "bin").agg(F.count("*").alias("n"))


@query(
    "a13_percentiles",
    f"""WITH {S}, q AS (SELECT recording, quantile_cont(v, 0.75) AS p75 FROM s WHERE v > 2 GROUP BY recording)
    SELECT recording, round(p75, 4) AS p75, round(quantile_cont(v, 0.9), 4) AS p90 FROM s JOIN q USING (recording) WHERE v >= p75 GROUP BY recording, p75""",
)
def _(spark, sf):
    df = derived.series(spark, sf)
    q = df.filter("v > 2").groupBy("recording").agg(F.percentile("v", F.lit(0.75)).alias("p75"))
    top = df.join(q, "recording").filter("v >= p75").groupBy("recording", "p75").agg(F.percentile("v", F.lit(0.9)).alias("p90"))
    return top.select("recording", _r("p75").alias("p75"), _r("p90").alias("p90"))


@query("a16_mean_per_run", f"WITH {S} SELECT recording, idx % 7 AS run, round(avg(v), 4) AS score FROM s WHERE event_id % 3 = 0 GROUP BY ALL")
def _(spark, sf):
    tested = derived.series(spark, sf).filter("event_id % 3 = 0").withColumn("run", F.col("idx") % 7)
    return summaries.group_means(tested, ["recording", "run"], "v", "score").select("recording", "run", _r("score").alias("score"))


@query("a18_extremes", f"WITH {S} SELECT min(v) AS least, max(v) AS most FROM s")
def _(spark, sf):
    return summaries.extremes(derived.series(spark, sf))


@query("a21_recording_length", f"WITH {S} SELECT recording, max(idx) + 1 AS frames FROM s GROUP BY recording")
def _(spark, sf):
    return summaries.recording_lengths(derived.series(spark, sf))


@query("a22_distinct_groups", f"WITH {SQL_LONG} SELECT split_part(measurement_name, '-', 1) AS grp, count(DISTINCT measurement_name) AS names FROM ml GROUP BY 1")
def _(spark, sf):
    return summaries.measurement_groups(m.long(m.measurements(derived.pose_wide(spark, sf))))


@query(
    "a23_peak_preserving",
    f"WITH {S} SELECT recording, idx // 20 AS bucket, min(v) AS lo, max(v) AS hi, arg_min(idx, v) AS at_lo, arg_max(idx, v) AS at_hi FROM (SELECT recording, idx, v + idx * 1e-7 AS v FROM s) GROUP BY ALL",
)
def _(spark, sf):
    df = derived.series(spark, sf).withColumn("v", F.col("v") + F.col("idx") * 1e-7)
    return summaries.peak_preserving(df, 20)


@query("a24_keypoints_per_view", f"WITH {POSE} SELECT kp % 6 AS view, count(DISTINCT kp) AS n, min(kp) AS first FROM pose GROUP BY 1")
def _(spark, sf):
    return summaries.keypoints_present(derived.pose_long(spark, sf).withColumn("view", F.col("kp") % 6), keypoint="kp")


@query(
    "a25_common_view_speed",
    f"""WITH {POST}, c AS (SELECT DISTINCT view FROM pre WHERE kp < 10 INTERSECT SELECT DISTINCT view FROM post WHERE kp > 23),
    u AS (SELECT 'pre' AS tracker, * FROM pre UNION ALL SELECT 'post', * FROM post), d AS (SELECT tracker, mouse, kp, view, sqrt(pow(x - lag(x) {'OVER w'}, 2) + pow(y - lag(y) OVER w, 2)) * 100 AS sp FROM u WINDOW w AS (PARTITION BY tracker, mouse, kp ORDER BY frame))
    SELECT kp, round(avg(sp) FILTER (WHERE tracker = 'pre'), 3) AS pre, round(avg(sp) FILTER (WHERE tracker = 'post'), 3) AS post FROM d JOIN c USING (view) GROUP BY kp""",
)
def _(spark, sf):
    pre, post = _pre_post(spark, sf)
    common = summaries.common_views(pre.filter("kp < 10"), post.filter("kp > 23"))
    found = summaries.common_view_speed({"pre": pre, "post": post}, common)
    return found.select("kp", _r("pre", 3).alias("pre"), _r("post", 3).alias("post"))


@query("o02_frame_union", f"WITH {POSE} SELECT recording, frame FROM pose WHERE kp = 1 AND x > 5 UNION SELECT recording, frame FROM pose WHERE kp = 2 AND x > 5")
def _(spark, sf):
    df = derived.pose_long(spark, sf).filter("x > 5")
    return summaries.frames_of_any(*(df.filter(F.col("kp") == k).select("recording", "frame") for k in (1, 2)))


@query("o03_view_intersection", f"WITH {POSE} SELECT recording, frame FROM pose WHERE kp = 1 AND x > 0 INTERSECT SELECT recording, frame FROM pose WHERE kp = 2 AND x > 0")
def _(spark, sf):
    df = derived.pose_long(spark, sf).filter("x > 0")
    return summaries.frames_of_all(*(df.filter(F.col("kp") == k).select("recording", "frame") for k in (1, 2)))


@query("o05_difference", f"WITH {POSE} SELECT recording, frame FROM pose WHERE kp = 1 AND x > 0 EXCEPT SELECT recording, frame FROM pose WHERE kp = 2 AND x > 0")
def _(spark, sf):
    df = derived.pose_long(spark, sf).filter("x > 0")
    return summaries.frames_of_first(*(df.filter(F.col("kp") == k).select("recording", "frame") for k in (1, 2)))


@query("o06_peak", f"WITH {S} SELECT recording, arg_max(idx, [v, -idx]) AS idx, max(v) AS v FROM s GROUP BY recording")
def _(spark, sf):
    return summaries.peaks(derived.series(spark, sf))


@query("d04_downsample_factor", f"WITH {S} SELECT recording, count(*) AS n, CAST(floor(100 / (count(*) / 600.0)) AS BIGINT) AS factor FROM s GROUP BY recording")
def _(spark, sf):
    return summaries.downsample_factor(derived.series(spark, sf), 600.0)
