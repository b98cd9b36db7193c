"""Queries on spectra, regression and tests, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from posegrid.functions import measurements as m
from posegrid.operators import model, paired, recursive, series, spectral
from posegrid.sources import derived, readers
from posegrid.sources.scratch import scratch_folder, settled

from .geometry import SQL_MEASUREMENTS
from .series import POSE, SYNC, S

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def _r(column, digits=4):
    return F.round(column, digits)


#: A low-pass of order four at a tenth of the rate.
SOS = [[0.00482434, 0.00964869, 0.00482434, 1.0, -1.04859958, 0.29614036], [1.0, 2.0, 1.0, 1.0, -1.32091343, 0.63273879]]


def _sos_sql(sections):
    """One step of the recursion: what each section gives, and its two states."""
    steps, enters = [], "s.v"
    for i, (b0, b1, b2, a0, a1, a2) in enumerate(sections):
        b0, b1, b2, a1, a2 = (float(x / a0) for x in (b0, b1, b2, a1, a2))
        leaves = f"({b0!r} * {enters} + coalesce(p{i}, 0.0))"
        steps.append((leaves, f"{b1!r} * {enters} - {a1!r} * {leaves} + coalesce(q{i}, 0.0)", f"{b2!r} * {enters} - {a2!r} * {leaves}"))
        enters = leaves
    names = ", ".join(f"{p}::DOUBLE AS p{i}, {q}::DOUBLE AS q{i}" for i, (_, p, q) in enumerate(steps))
    return f"s.recording, s.idx, {steps[-1][0]}::DOUBLE AS v, {names}"


@query(
    "d01_sos_filter",
    f"""WITH RECURSIVE {S}, f AS (SELECT {_sos_sql(SOS).replace("coalesce(p0, 0.0)", "0.0").replace("coalesce(q0, 0.0)", "0.0").replace("coalesce(p1, 0.0)", "0.0").replace("coalesce(q1, 0.0)", "0.0")} FROM s WHERE idx = 0
    UNION ALL SELECT {_sos_sql(SOS)} FROM f JOIN s ON s.recording = f.recording AND s.idx = f.idx + 1) SELECT recording, idx::BIGINT AS idx, round(v, 4) AS v FROM f""",
)
def _(spark, sf):
    done = recursive.sos_filter(derived.series(spark, sf), SOS, chunk=1024)
    return done.select("recording", "idx", _r("v").alias("v"))


SPECTRUM = f"""{S}, n AS (SELECT recording, count(*) AS n FROM s GROUP BY 1), sg AS (SELECT recording, unnest(range((n - 400) // 350 + 1)) AS seg FROM n WHERE n >= 400),
 x AS (SELECT sg.recording, seg, idx - seg * 350 AS i, v - avg(v) OVER (PARTITION BY sg.recording, seg) AS v FROM sg JOIN s ON s.recording = sg.recording AND idx >= seg * 350 AND idx < seg * 350 + 400),
 wn AS (SELECT i, 0.5 * (1 - cos(pi() * least(least(i / 400.0, 1 - i / 400.0) / 0.125, 1))) AS w FROM (SELECT unnest(range(400)) AS i)),
 sp AS (SELECT recording, seg, k, sqrt(pow(sum(v * w * cos(2 * pi() * k * i / 400)), 2) + pow(sum(v * w * sin(2 * pi() * k * i / 400)), 2)) / (SELECT sum(w) FROM wn) AS power
   FROM (SELECT * FROM x JOIN wn USING (i)), (SELECT unnest(range(201)) AS k) GROUP BY ALL)"""


@query("d02_spectrogram", f"WITH {SPECTRUM} SELECT recording, seg, round((200 + seg * 350) / 100.0, 4) AS t, round(k / 4.0, 4) AS freq, round(power, 4) AS power FROM sp")
def _(spark, sf):
    found = spectral.spectrogram(derived.series(spark, sf), 100.0, 400)
    return found.select("recording", "seg", _r("t").alias("t"), _r("freq").alias("freq"), _r("power").alias("power"))


@query(
    "a17_band_powers",
    f"""WITH {SPECTRUM} SELECT recording, seg, round((200 + seg * 350) / 100.0, 4) AS t, round(avg(power) FILTER (WHERE k / 4.0 < 1), 4) AS low,
    round(avg(power) FILTER (WHERE k / 4.0 BETWEEN 1 AND 4), 4) AS delta, round(avg(power) FILTER (WHERE k / 4.0 BETWEEN 5 AND 10), 4) AS theta FROM sp GROUP BY recording, seg""",
)
def _(spark, sf):
    found = spectral.band_powers(spectral.spectrogram(derived.series(spark, sf), 100.0, 400))
    return found.select("recording", "seg", _r("t").alias("t"), *(_r(c).alias(c) for c in ("low", "delta", "theta")))


D03 = SPECTRUM.replace("400", "64").replace("350", "56").replace("range(201)", "range(33)").replace("(n - 64) // 56", "(n - 64) // 56")


@query(
    "d03_band_series",
    f"""WITH {D03}, bp AS (SELECT recording, seg, (32 + seg * 56) / 100.0 AS t, avg(power) FILTER (WHERE k * 100 / 64.0 < 1) AS low, avg(power) FILTER (WHERE k * 100 / 64.0 BETWEEN 1 AND 4) AS delta, avg(power) FILTER (WHERE k * 100 / 64.0 BETWEEN 5 AND 10) AS theta FROM sp GROUP BY recording, seg),
    l AS (UNPIVOT bp ON low, delta, theta INTO NAME band VALUE v), o AS (SELECT *, count(*) OVER (PARTITION BY recording, band) AS n, avg(v) OVER (PARTITION BY recording, band ORDER BY seg ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM l),
    kk AS (SELECT * FROM o WHERE seg >= 2 AND seg < n - 2) SELECT recording, band, seg AS idx, round(t, 4) AS t, round((s - avg(s) OVER p) / CASE WHEN stddev_pop(s) OVER p = 0 THEN 1 ELSE stddev_pop(s) OVER p END, 4) AS z FROM kk WINDOW p AS (PARTITION BY recording, band)""",
)
def _(spark, sf):
    found = spectral.band_series(spectral.band_powers(spectral.spectrogram(derived.series(spark, sf), 100.0, 64)), 2)
    return found.select("recording", "band", "idx", _r("t").alias("t"), _r("z").alias("z"))


@query("s06_seconds_of_day", "SELECT event_id, round(extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60 + extract('microsecond' FROM ts) / 1e6, 6) AS seconds FROM events")
def _(spark, sf):
    e = derived.table(spark, sf, "events")
    text = F.date_format(F.col("ts"), "H:m:s:SSSSSS")
    return e.select("event_id", _r(readers.seconds_of(text), 6).alias("seconds"))


@query(
    "s07_sample_rate",
    f"""WITH {S}, x AS (SELECT event_type AS recording, extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60 + extract('microsecond' FROM ts) / 1e6 AS sec FROM events),
    q AS (SELECT recording, (count(*) - 1) / (max(sec) - min(sec)) AS rate FROM x GROUP BY 1) SELECT recording, round(CASE WHEN abs(rate - 0.02) > 0.002 THEN rate ELSE 0.02 END, 6) AS rate FROM q""",
)
def _(spark, sf):
    e = derived.table(spark, sf, "events")
    df = e.select(F.col("event_type").alias("recording"), readers.seconds_of(F.date_format(F.col("ts"), "H:m:s:SSSSSS")).alias("seconds"))
    return readers.estimate_sample_rate(df, 0.02).select("recording", _r("rate", 6).alias("rate"))


@query(
    "s08_trim_leading_zeros",
    f"""WITH {S}, z AS (SELECT recording, idx, CASE WHEN idx < 3 OR event_id % 9 = 0 THEN 0 ELSE v END AS v FROM s), f AS (SELECT recording, min(idx) AS o FROM z WHERE v <> 0 GROUP BY 1)
    SELECT recording, idx - o AS idx, v, round(o / 100.0, 4) AS "offset" FROM z JOIN f USING (recording) WHERE idx >= o""",
)
def _(spark, sf):
    quiet = (F.col("idx") < 3) | (F.col("event_id") % 9 == 0)
    df = derived.series(spark, sf).withColumn("v", F.when(F.col("idx") == 1, F.lit(float("nan"))).when(~quiet, F.col("v")))
    return readers.trim_leading_zeros(df, 100.0).select("recording", "idx", "v", _r("offset").alias("offset"))


@query("s10_select_signals", "WITH sm AS (SELECT event_id % 8 AS channel, value AS v FROM events) SELECT channel, count(*) AS n, round(sum(v), 2) AS total FROM sm WHERE channel IN (2, 3) GROUP BY 1")
def _(spark, sf):
    aux = readers.select_signals(derived.samples(spark, sf), "aux", 8)
    return aux.groupBy("channel").agg(F.count("*").alias("n"), _r(F.sum("v"), 2).alias("total"))


@query("s12_unit_table", "SELECT s_suppkey AS depth, substr(s_name, 12) AS name FROM supplier WHERE s_nationkey = 7")
def _(spark, sf):
    units = derived.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("session"), F.col("s_suppkey").alias("depth"), F.col("s_name").alias("name"))
    return readers.unit_table(units, "7")


@query("s13_new_recordings", f"WITH {SYNC}, a AS (SELECT DISTINCT recording FROM r) SELECT recording, count(*) AS n FROM r WHERE recording % 3 <> 0 GROUP BY 1")
def _(spark, sf):
    """Recordings that an earlier run has not written."""
    df = derived.sync_reference(spark, sf)
    folder = scratch_folder(spark, "features")
    readers.write_features(df.filter("recording % 3 = 0"), folder)
    # The second run writes the rest only: what is there stays as it is.
    readers.write_features(df.withColumn("idx", F.col("idx") + 1_000_000), folder)
    return spark.read.parquet(folder).filter("idx >= 1000000").groupBy(F.col("recording").cast("long")).agg(F.count("*").alias("n"))


# ---- regression of time on features

FEATURES = list(SQL_MEASUREMENTS)
SHORT = [f"f{i}" for i in range(len(FEATURES))]
SQUARES = [f"q{i}" for i in range(len(FEATURES))]
NAMES = [*SHORT, *SQUARES]
SQL_FEATURES = ", ".join(f"({SQL_MEASUREMENTS[f]}) AS {n}" for n, f in zip(SHORT, FEATURES))
FRAME_SQL = "f AS (SELECT label AS recording, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame, embedding AS e FROM embeddings)"
D6 = f"""{FRAME_SQL}, w AS (SELECT recording, frame, {SQL_FEATURES} FROM f), o AS (SELECT *, count(*) OVER p AS n, """ + ", ".join(
    f"avg({n}) OVER (PARTITION BY recording ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s{n}" for n in SHORT
) + """ FROM w WINDOW p AS (PARTITION BY recording)), k AS (SELECT * FROM o WHERE frame >= 4 AND frame < n - 4 AND frame % 2 = 0)"""
D6Z = D6 + ", z AS (SELECT recording, frame, frame / 100.0 AS minutes, " + ", ".join(
    f"(s{n} - avg(s{n}) OVER p) / stddev_pop(s{n}) OVER p AS z{n[1:]}" for n in SHORT
) + " FROM k WINDOW p AS (PARTITION BY recording))"


def _time_features(spark, sf):
    """All measurements, smoothed, strided and z-scored, with their squares; target: time."""
    wide = m.measurements(derived.pose_wide(spark, sf)).select("recording", "frame", *(F.col(f"`{f}`").alias(n) for n, f in zip(SHORT, FEATURES)))
    long = wide.unpivot(["recording", "frame"], SHORT, "name", "v").withColumnRenamed("frame", "idx")
    smooth = series.moving_avg(long, 4, 2, keys=("recording", "name"))
    scored = series.zscore(smooth, "smooth", ("recording", "name"))
    z = scored.groupBy("recording", "idx").pivot("name", SHORT).agg(F.first("z"))
    squares = series.poly_features(z, SHORT, 2, False).toDF("session", "frame", *SHORT, "one", *(f"same_{n}" for n in SHORT), *SQUARES)
    return squares.select("session", "frame", (F.col("frame") / 100.0).alias("minutes"), *NAMES)


@query("d06_time_features", f"WITH {D6Z} SELECT recording AS session, frame, round(minutes, 4) AS minutes, " + ", ".join(f"round(z{n[1:]}, 4) AS {n}, round(z{n[1:]} * z{n[1:]}, 4) AS q{n[1:]}" for n in SHORT) + " FROM z")
def _(spark, sf):
    return _time_features(spark, sf).select("session", "frame", *(_r(c).alias(c) for c in ("minutes", *NAMES)))


@query(
    "d07_holdout_splits",
    "WITH s AS (SELECT DISTINCT label AS x FROM embeddings) SELECT a.x || '+' || b.x || '+' || c.x AS split, d.x AS fold FROM s a JOIN s b ON a.x < b.x JOIN s c ON b.x < c.x JOIN s d ON d.x NOT IN (a.x, b.x, c.x)",
)
def _(spark, sf):
    sessions = derived.table(spark, sf, "embeddings").select(F.col("label").alias("session")).distinct()
    return model.loso_folds(model.holdout_splits(sessions), sessions).select("split", "fold")


_COLUMNS = ["1.0::DOUBLE", *(f"z{n[1:]}" for n in SHORT), *(f"z{n[1:]} * z{n[1:]}" for n in SHORT), "minutes::DOUBLE"]


@query(
    "d08_gram",
    f"""WITH {D6Z}, c AS (SELECT recording, frame, unnest([{", ".join(_COLUMNS)}]) AS x, unnest(range({len(_COLUMNS)})) AS i FROM z)
    SELECT a.recording AS session, a.i::INTEGER AS i, b.i::INTEGER AS j, round(sum(a.x * b.x), 3) AS total FROM c a JOIN c b ON a.recording = b.recording AND a.frame = b.frame AND a.i <= b.i GROUP BY ALL""",
)
def _(spark, sf):
    grams = model.gram(_time_features(spark, sf), NAMES, "minutes")
    width = len(NAMES) + 2
    places = spark.createDataFrame([(k, i, j) for k, (i, j) in enumerate((i, j) for i in range(width) for j in range(i, width))], "at int, i int, j int")
    entries = grams.select("session", F.posexplode("gram").alias("at", "total")).join(F.broadcast(places), "at")
    return entries.select("session", "i", "j", (_r("total", 3) + F.lit(0.0)).alias("total"))


def _models(spark, sf):
    rows = settled(_time_features(spark, sf), "time-features")
    sessions = rows.select("session").distinct()
    splits = model.holdout_splits(sessions)
    folds = model.loso_folds(splits, sessions)
    alphas = [10 ** (-1 + 3 * i / 99) for i in range(100)]
    return splits, model.lasso_grid(model.gram(rows, NAMES, "minutes"), folds, len(NAMES), alphas)


@query("d08_lasso_grid")
def _(spark, sf):
    """A proven fit of each split: the gap is within a billionth of the target's variance."""
    found = _models(spark, sf)[1]
    return found.select("split", _r("alpha", 6).alias("alpha"), _r("score").alias("score"), _r("intercept").alias("intercept"), _r("gap", 6).alias("gap"))


@query("d09_session_scores")
def _(spark, sf):
    splits, models = _models(spark, sf)
    return model.session_scores(models, splits).select("split", "session", "set", _r("rmse").alias("rmse"))


# ---- tests


@query("t01_wilcoxon")
def _(spark, sf):
    pose = derived.pose_long(spark, sf)
    both = pose.select(F.col("recording").alias("mouse"), "kp", _r("x", 3).alias("before"), _r("y", 3).alias("after"))
    return paired.wilcoxon(both, "before", "after", ["kp"]).select("kp", "n", "w", _r("p", 8).alias("p"))


@query(
    "t01_rank_sums",
    f"""WITH {POSE}, d AS (SELECT kp, round(y, 3) - round(x, 3) AS d FROM pose WHERE round(y, 3) <> round(x, 3)), r AS (SELECT kp, d, rank() OVER (PARTITION BY kp ORDER BY abs(d)) + (count(*) OVER (PARTITION BY kp, abs(d)) - 1) / 2.0 AS rk FROM d)
    SELECT kp, count(*) AS n, coalesce(sum(rk) FILTER (WHERE d > 0), 0)::DOUBLE AS w FROM r GROUP BY kp""",
)
def _(spark, sf):
    pose = derived.pose_long(spark, sf)
    both = pose.select("kp", _r("x", 3).alias("before"), _r("y", 3).alias("after"))
    return paired.wilcoxon(both, "before", "after", ["kp"]).select("kp", "n", "w")


@query("t02_cv_ttest", f"WITH {S}, g AS (SELECT recording, idx % 20 AS run, avg(v) - 50 AS d FROM s GROUP BY ALL) SELECT recording, count(*) AS runs, round(avg(d) / sqrt(var_samp(d) * (1.0 / count(*) + 0.25)), 4) AS t FROM g GROUP BY recording")
def _(spark, sf):
    runs = derived.series(spark, sf).groupBy("recording", (F.col("idx") % 20).alias("run")).agg((F.avg("v") - 50).alias("d"))
    return paired.cv_ttest(runs, "d", ["recording"], 0.25).select("recording", "runs", _r("t").alias("t"))
