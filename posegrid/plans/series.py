"""Queries on value series and on keyed tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from posegrid.operators import series as w
from posegrid.operators import tables as t
from posegrid.sources import derived

S = "s AS (SELECT event_type AS recording, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS idx, value AS v, event_id FROM events)"
G = S + ", g AS (SELECT recording, idx, CASE WHEN event_id % 7 <> 0 THEN v END AS v, event_id FROM s)"
SYNC = """r AS (SELECT user_id AS recording, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx, CAST(value > 60 AS INTEGER) AS "on" FROM events)"""
ALIGN = SYNC + """, z AS (SELECT recording, CAST(idx + recording % 7 AS INTEGER) AS idx, "on" FROM r
  UNION ALL SELECT recording, CAST(unnest(range(recording % 7)) AS INTEGER), 0 FROM (SELECT DISTINCT recording FROM r))"""
W = "OVER (PARTITION BY recording ORDER BY idx"

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(run):
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


def _r(column, digits=4):
    return F.round(column, digits)


@query("w01_velocity", f"WITH {S} SELECT recording, idx, round(abs(v - lag(v) {W})) * 100, 4) AS velocity FROM s")
def _(spark, sf):
    return w.velocity(derived.series(spark, sf)).select("recording", "idx", _r("velocity").alias("velocity"))


@query(
    "w02_moving_avg",
    f"""WITH {S}, m AS (SELECT recording, idx, avg(v) {W} ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS a, count(*) OVER (PARTITION BY recording) AS n FROM s)
    SELECT recording, idx, round(a, 6) AS smooth FROM m WHERE idx >= 8 AND idx < n - 8 AND (idx - 8) % 3 = 0""",
)
def _(spark, sf):
    return w.moving_avg(derived.series(spark, sf), 8, 3).select("recording", "idx", _r("smooth", 6).alias("smooth"))


@query(
    "w03_running_median",
    f"""WITH {S}, m AS (SELECT recording, idx, list(v) {W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS l FROM s)
    SELECT recording, idx, round(list_sort(list_concat(l, list_transform(range(13 - len(l)), lambda i: 0.0)))[7], 4) AS median FROM m""",
)
def _(spark, sf):
    return w.running_median(derived.series(spark, sf), 13).select("recording", "idx", _r("median").alias("median"))


@query(
    "w04_zscore",
    f"""WITH {S}, a AS (SELECT recording, avg(v) AS m, stddev_pop(v) AS d FROM s GROUP BY recording)
    SELECT recording, idx, round((v - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 4) AS z FROM s JOIN a USING (recording)""",
)
def _(spark, sf):
    return w.zscore(derived.series(spark, sf)).select("recording", "idx", _r("z").alias("z"))


@query("w04_unzscore", f"WITH {S} SELECT recording, idx, round(v, 4) AS v FROM s")
def _(spark, sf):
    df = derived.series(spark, sf)
    stats = df.groupBy("recording").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return w.unzscore(w.zscore(df).drop("v"), stats).select("recording", "idx", _r("v").alias("v"))


@query(
    "w05_minmax",
    f"WITH {S}, a AS (SELECT recording, min(v) AS lo, max(v) AS hi FROM s GROUP BY recording) SELECT recording, idx, round((v - lo) / nullif(hi - lo, 0), 4) AS scaled FROM s JOIN a USING (recording)",
)
def _(spark, sf):
    return w.minmax(derived.series(spark, sf)).select("recording", "idx", _r("scaled").alias("scaled"))


@query(
    "w06_scale_by_std",
    f"WITH {S}, a AS (SELECT recording, stddev_samp(v) AS d FROM s GROUP BY recording) SELECT recording, idx, round(v / d, 4) AS scaled FROM s JOIN a USING (recording)",
)
def _(spark, sf):
    return w.scale_by_std(derived.series(spark, sf)).select("recording", "idx", _r("scaled").alias("scaled"))


@query(
    "w07_mask_around",
    f"WITH {S}, f AS (SELECT *, max(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) {W} ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING) AS near FROM s) SELECT recording, idx, CASE WHEN near = 0 THEN round(v, 4) END AS v FROM f",
)
def _(spark, sf):
    return w.mask_around(derived.series(spark, sf), F.col("event_id") % 97 == 0).select("recording", "idx", _r("v").alias("v"))


INTERPOLATED = f"""l AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li,
   last_value(v IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv,
   first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri,
   first_value(v IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv FROM src)
   SELECT recording, idx, round(coalesce(v, lv + (rv - lv) * (idx - li) / nullif(ri - li, 0), lv, rv), 4) AS v FROM l"""


@query("w08_interpolate", f"WITH {G}, src AS (SELECT * FROM g), {INTERPOLATED}")
def _(spark, sf):
    return w.interpolate(derived.series_gappy(spark, sf)).select("recording", "idx", _r("v").alias("v"))


EDGES = f"""e AS (SELECT recording, idx AS edge FROM (SELECT *, lead("on") {W}) AS nx FROM %s) WHERE nx - "on" > 0)"""


@query("w09_rising_edges", f"WITH {SYNC}, {EDGES % 'r'} SELECT recording, edge FROM e")
def _(spark, sf):
    return w.rising_edges(derived.sync_reference(spark, sf))


RUNS = f"""c AS (SELECT *, CAST("on" <> lag("on", 1, 0) {W}) AS INTEGER) AS ch FROM r), u AS (SELECT *, sum(ch) {W}) AS run FROM c),
  seg AS (SELECT recording, min(idx) AS start, max(idx) AS "end" FROM u WHERE "on" = 1 GROUP BY recording, run),
  num AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY start) AS number, count(*) OVER (PARTITION BY recording) AS pulses FROM seg)"""


@query("w10_pulse_segments", f'WITH {SYNC}, {RUNS} SELECT recording, start, "end", number, pulses FROM num')
def _(spark, sf):
    return w.pulse_segments(derived.sync_reference(spark, sf))


@query("w10_middle_segment", f'WITH {SYNC}, {RUNS} SELECT recording, start, "end" FROM num WHERE number = pulses // 2 + 1')
def _(spark, sf):
    return w.chosen_segment(w.pulse_segments(derived.sync_reference(spark, sf)), "middle").select("recording", "start", "end")


@query(
    "w11_bipolar_to_level",
    f"""WITH {S}, c AS (SELECT *, coalesce((v > 100) <> lag(v > 100) {W}), false) AS o, coalesce((event_id % 10 > 7) <> lag(event_id % 10 > 7) {W}), false) AS cl FROM s)
    SELECT recording, idx, CAST(sum(CAST(o AS INTEGER)) {W}) > sum(CAST(cl AS INTEGER)) {W}) AS INTEGER) AS "on" FROM c""",
)
def _(spark, sf):
    df = derived.series(spark, sf).select("recording", "idx", F.col("v").alias("up"), F.when(F.col("event_id") % 10 > 7, 101.0).otherwise(0.0).alias("down"))
    return w.bipolar_to_level(df, 100.0).select("recording", "idx", "on")


@query(
    "w12_median_gap",
    f"WITH {SYNC}, {EDGES % 'r'}, d AS (SELECT recording, edge - lag(edge) OVER (PARTITION BY recording ORDER BY edge) AS g FROM e) SELECT recording, round(quantile_cont(g, 0.5), 4) AS gap, count(g) AS gaps FROM d GROUP BY recording",
)
def _(spark, sf):
    found = w.median_gap(w.rising_edges(derived.sync_reference(spark, sf)))
    return found.select("recording", _r("gap").alias("gap"), "gaps")


@query(
    "w13_lagged_features",
    f"""WITH {S} SELECT recording, idx, 1.0::DOUBLE AS bias, first_value(v) {W}) AS v_initial, lag(v, 2, 0) {W}) AS v_lag2, lag(v, 1, 0) {W}) AS v_lag1, v AS v_lag0 FROM s""",
)
def _(spark, sf):
    return w.lagged_features(derived.series(spark, sf), ["v"], 2, True, True)


@query(
    "w14_top_per_series",
    f"WITH {S} SELECT recording, idx, v FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY v DESC, idx) AS k FROM s) WHERE k <= 20",
)
def _(spark, sf):
    """The twenty largest samples of each series, a report."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("recording").orderBy(F.col("v").desc(), "idx"))
    return derived.series(spark, sf).withColumn("k", number).filter("k <= 20").select("recording", "idx", "v")


@query(
    "w15_avg_rank",
    f"""WITH {S} SELECT recording, idx, rank() OVER (PARTITION BY recording ORDER BY round(v, 0)) + (count(*) OVER (PARTITION BY recording, round(v, 0)) - 1) / 2.0 AS rank FROM s""",
)
def _(spark, sf):
    return w.avg_rank(derived.series(spark, sf).withColumn("q", F.round("v", 0)), "q", ("recording",)).select("recording", "idx", "rank")


@query("d05_poly_features", f"WITH {S} SELECT recording, idx, 1.0::DOUBLE AS one, v AS a, round(v / 2, 4) AS b, round(v * v, 6) AS aa, round(v * (v / 2), 6) AS ab, round((v / 2) * (v / 2), 6) AS bb FROM s")
def _(spark, sf):
    df = derived.series(spark, sf).select("recording", "idx", F.col("v").alias("a"), (F.col("v") / 2).alias("b"))
    found = w.poly_features(df, ["a", "b"], 2).toDF("recording", "idx", "a0", "b0", "one", "a", "b", "aa", "ab", "bb")
    return found.select("recording", "idx", "one", "a", _r("b").alias("b"), *(_r(c, 6).alias(c) for c in ("aa", "ab", "bb")))


# ---- filters and reshaping

POSE = """f AS (SELECT label AS recording, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame, embedding AS e FROM embeddings),
 pose AS (SELECT recording, frame, kp, 100 * CAST(e[(3 * kp) % 64 + 1] AS DOUBLE) AS x, 100 * CAST(e[(3 * kp + 1) % 64 + 1] AS DOUBLE) AS y,
  100 * CAST(e[(3 * kp + 2) % 64 + 1] AS DOUBLE) AS z FROM f, (SELECT CAST(unnest(range(27)) AS INTEGER) AS kp))"""


def _periods(poses):
    return poses.select("recording").distinct().select("recording", (F.col("recording") + 5).alias("start"), (F.col("recording") + 35).alias("end"))


@query("p01_in_periods", f"WITH {POSE} SELECT recording, frame, kp, round(x, 4) AS x FROM pose WHERE frame >= 5 + recording AND frame < 35 + recording")
def _(spark, sf):
    poses = derived.pose_long(spark, sf)
    return t.in_periods(poses, _periods(poses)).select("recording", "frame", "kp", _r("x").alias("x"))


SPIKES = "e0 AS (SELECT event_type AS unit, epoch_us(ts) AS us FROM events), sp AS (SELECT unit, (us - (SELECT min(us) FROM e0)) // 4320 AS t_us FROM e0)"


@query("p02_time_range", f"WITH {SPIKES} SELECT unit, t_us FROM sp WHERE t_us BETWEEN 100000000 AND 200000000")
def _(spark, sf):
    return derived.spikes(spark, sf).filter(F.col("t_us").between(100_000_000, 200_000_000))


@query(
    "p03_region",
    f"""WITH {POSE} SELECT CASE WHEN kp <= 2 THEN 'nose' WHEN kp <= 7 THEN 'whiskers' WHEN kp <= 10 THEN 'mouth' WHEN kp <= 14 THEN 'eye(left)' WHEN kp <= 18 THEN 'eye(right)'
      WHEN kp <= 22 THEN 'ear(left)' ELSE 'ear(right)' END AS region, count(*) AS n, round(avg(x), 4) AS mean_x FROM pose GROUP BY 1""",
)
def _(spark, sf):
    return derived.pose_long(spark, sf).groupBy(t.region_of(F.col("keypoint")).alias("region")).agg(F.count("*").alias("n"), _r(F.avg("x")).alias("mean_x"))


@query("p04_predicates", f"WITH {POSE} SELECT recording, frame, kp FROM pose WHERE (recording = 3 OR recording IN (5, 7)) AND kp BETWEEN 11 AND 18")
def _(spark, sf):
    df = derived.pose_long(spark, sf).filter(F.col("recording").isin(3, 5, 7) & F.col("keypoint").startswith("eye"))
    return df.select("recording", "frame", "kp")


@query("p05_key_tuples", f"WITH {POSE} SELECT recording, frame, kp FROM pose WHERE (recording, kp) IN ((1, 2), (2, 4), (9, 18))")
def _(spark, sf):
    keys = spark.createDataFrame([(1, 2), (2, 4), (9, 18)], "recording int, kp int")
    return t.of_keys(derived.pose_long(spark, sf), keys).select("recording", "frame", "kp")


@query("p06_drop_named", f"WITH {SPIKES} SELECT unit, count(*) AS n FROM sp WHERE NOT (contains(unit, 'ar') OR contains(unit, 'c')) GROUP BY unit")
def _(spark, sf):
    return t.without_names(derived.spikes(spark, sf), ["ar", "c"], "unit").groupBy("unit").agg(F.count("*").alias("n"))


@query("p07_rename", f"WITH {POSE} SELECT recording AS mouse, frame, CASE kp WHEN 0 THEN 'nb' WHEN 8 THEN 'lip' ELSE 'kp' || kp END AS landmark FROM pose")
def _(spark, sf):
    df = derived.pose_long(spark, sf).withColumnsRenamed({"recording": "mouse"})
    landmark = t.renamed_values(F.col("keypoint"), {"nose(bottom)": "nb", "lowerlip": "lip"}, F.concat(F.lit("kp"), F.col("kp").cast("string")))
    return df.select("mouse", "frame", landmark.alias("landmark"))


@query("p08_fill_missing", f"WITH {POSE} SELECT recording, frame, kp, CASE WHEN kp % 4 = 0 THEN 0 ELSE round(x, 4) END AS x FROM pose")
def _(spark, sf):
    poses = derived.pose_long(spark, sf)
    found = t.filled(poses.filter("kp % 4 <> 0"), poses.select("recording", "frame", "kp"), {"x": 0.0})
    return found.select("recording", "frame", "kp", _r("x").alias("x"))


@query("p09_unpivot", f"WITH {POSE} SELECT recording, frame, kp, axis, round(value, 4) AS value FROM (UNPIVOT (SELECT recording, frame, kp, x, y, z FROM pose) ON x, y, z INTO NAME axis VALUE value)")
def _(spark, sf):
    long = t.axes_long(derived.pose_long(spark, sf), ["recording", "frame", "kp"])
    return long.select("recording", "frame", "kp", "axis", _r("value").alias("value"))


PIVOTED = range(27)


@query(
    "p10_pivot",
    f"WITH {POSE} SELECT recording, frame, " + ", ".join(f'round(max(CASE WHEN kp = {k} THEN {a} END), 4) AS "k{k}/{a}"' for k in PIVOTED for a in "xy") + " FROM pose GROUP BY recording, frame",
)
def _(spark, sf):
    df = derived.pose_long(spark, sf).select("recording", "frame", F.concat(F.lit("k"), F.col("kp").cast("string")).alias("k"), _r("x").alias("x"), _r("y").alias("y"))
    return t.values_wide(df, ["recording", "frame"], "k", [f"k{k}" for k in PIVOTED], ["x", "y"])


@query("p11_explode_arrays", "SELECT vec_id, i - 1 AS i, round(embedding[i]::DOUBLE, 5) AS a, round(embedding[i]::DOUBLE * 2, 5) AS b FROM embeddings, unnest(range(1, 65)) AS u(i)")
def _(spark, sf):
    e = derived.table(spark, sf, "embeddings")
    e = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"), F.transform("embedding", lambda x: x.cast("double") * 2).alias("b"))
    return t.exploded(e, ["vec_id"], ["a", "b"]).select("vec_id", "i", _r("a", 5).alias("a"), _r("b", 5).alias("b"))


@query("p12_union", f"WITH {S} SELECT recording, idx, v, -1 AS event_id FROM s WHERE idx % 2 = 0 UNION ALL SELECT recording, idx, v, event_id FROM s WHERE idx % 2 = 1")
def _(spark, sf):
    df = derived.series(spark, sf)
    both = t.all_rows(df.filter("idx % 2 = 0").drop("event_id"), df.filter("idx % 2 = 1"))
    return both.select("recording", "idx", "v", F.coalesce("event_id", F.lit(-1)).cast("long").alias("event_id"))


@query(
    "p13_keep_first",
    "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
)
def _(spark, sf):
    return t.keep_first(derived.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("p14_drop_missing", f"WITH {G} SELECT recording, idx, v FROM g WHERE v IS NOT NULL")
def _(spark, sf):
    return derived.series_gappy(spark, sf).dropna(subset=["v"]).select("recording", "idx", "v")


@query("p15_strided", f"WITH {S} SELECT recording, idx, v FROM s WHERE (idx + 5 - 3) % 5 = 0")
def _(spark, sf):
    return t.strided(derived.series(spark, sf), 5, 3).select("recording", "idx", "v")


@query("p16_custom_order", "SELECT event_type, coalesce(list_position(['view', 'click', 'purchase'], event_type), 0) AS place, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    place = t.custom_order(F.col("event_type"), ["view", "click", "purchase"])
    n = derived.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", place.cast("int").alias("place"), "n").orderBy("place", "event_type")


@query(
    "p17_feature_order",
    f"""WITH {POSE}, k AS (SELECT DISTINCT kp, CASE WHEN kp BETWEEN 11 AND 14 OR kp BETWEEN 19 AND 22 OR kp IN (3, 4, 9) THEN 0 WHEN kp BETWEEN 15 AND 18 OR kp >= 23 OR kp IN (5, 6, 10) THEN 1 ELSE 2 END AS side FROM pose)
    SELECT kp, side, row_number() OVER (ORDER BY side, kp) AS place FROM k""",
)
def _(spark, sf):
    from pyspark.sql import Window

    k = derived.pose_long(spark, sf).select("kp", t.side_rank(F.col("keypoint")).alias("side")).distinct()
    # A row per keypoint of the configuration: one window over all of them.
    return k.select("kp", "side", F.row_number().over(Window.orderBy("side", "kp")).alias("place"))


@query("p18_numeric_text", "SELECT event_id, try_cast(regexp_extract(props, '[0-9.]+') AS DOUBLE) AS number, user_id FROM events")
def _(spark, sf):
    e = derived.table(spark, sf, "events")
    return e.select("event_id", t.numeric_text(F.col("props")).alias("number"), "user_id")


@query(
    "p19_time_origin",
    f"""WITH {S}, n AS (SELECT recording, max(idx) + 1 AS n FROM s WHERE recording < 'd' GROUP BY recording), a AS (SELECT recording, idx - n AS t, v FROM s JOIN n USING (recording)),
    b AS (SELECT recording, idx + 30 AS t, v FROM s WHERE recording >= 'd'), z AS (SELECT DISTINCT recording FROM s)
    SELECT recording, CAST(t AS BIGINT) AS t, v FROM a UNION ALL SELECT recording, CAST(t AS BIGINT), v FROM b UNION ALL SELECT recording, unnest(range(30)), 0 FROM z""",
)
def _(spark, sf):
    """Series of one condition end at zero and go on with 30 zeros; the others start after 30 zeros."""
    return t.condition_origin(derived.series(spark, sf), F.col("recording") < "d", 30)


@query(
    "p20_common_origin",
    f"WITH {S}, o AS (SELECT recording, min(idx) FILTER (WHERE v > 480) AS o FROM s GROUP BY recording) SELECT recording, idx - o AS t, v FROM s JOIN o USING (recording) WHERE idx >= o AND idx - o < 450",
)
def _(spark, sf):
    df = derived.series(spark, sf)
    return t.common_origin(df, F.col("v") > 480, 450).select("recording", "t", "v")


@query(
    "p21_shift_frames",
    f"""WITH {S}, n AS (SELECT recording, max(idx) AS n FROM s GROUP BY recording)
    SELECT 'later' AS way, recording, idx - 4 AS idx, v FROM s WHERE idx >= 4 UNION ALL
    SELECT 'earlier', a.recording, i, v FROM n JOIN (SELECT unnest(range(0, 100000)) AS i) r ON i <= n JOIN s a ON a.recording = n.recording AND a.idx = greatest(i - 3, 0)""",
)
def _(spark, sf):
    df = derived.series(spark, sf)
    later, earlier = t.shift_frames(df, 4), t.shift_frames(df, -3)
    both = later.withColumn("way", F.lit("later")).unionByName(earlier.withColumn("way", F.lit("earlier")))
    return both.select("way", "recording", "idx", "v")
