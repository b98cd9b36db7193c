"""Queries on synchronisation and spikes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from posegrid.operators import permutations, series, spikes, sync, tables
from posegrid.sources import derived

from .aggregates import BINS, MOVE
from .series import ALIGN, EDGES, SPIKES, SYNC, S, W

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


@query("j02_star_pairs", f"WITH {SYNC}, u AS (SELECT DISTINCT recording FROM r) SELECT a.recording // 6 AS session, a.recording AS reference, b.recording AS target FROM u a JOIN u b ON a.recording // 6 = b.recording // 6 AND a.recording % 6 = 0 AND b.recording <> a.recording")
def _(spark, sf):
    u = derived.sync_reference(spark, sf).select("recording").distinct().withColumn("session", F.expr("recording div 6"))
    ref = u.filter("recording % 6 = 0").withColumnRenamed("recording", "reference")
    return ref.join(u.withColumnRenamed("recording", "target"), "session").filter("target <> reference").select("session", "reference", "target")


@query("j03_session_pairs", f"WITH {SYNC}, u AS (SELECT recording, count(*) AS n FROM r GROUP BY 1) SELECT u.recording, u.n, v.recording AS other FROM u JOIN u v ON u.recording // 10 = v.recording // 10 AND v.recording % 10 = 0")
def _(spark, sf):
    u = derived.sync_reference(spark, sf).groupBy("recording").agg(F.count("*").alias("n")).withColumn("s", F.expr("recording div 10"))
    other = u.filter("recording % 10 = 0").select("s", F.col("recording").alias("other"))
    return u.join(other, "s").select("recording", "n", "other")


@query("j06_corrected_time", f"WITH {SYNC} SELECT recording, idx, round(idx / 100.0 + (recording % 7) / 100.0, 6) AS time FROM r")
def _(spark, sf):
    df = derived.sync_reference(spark, sf)
    params = df.select("recording").distinct().select("recording", (F.col("recording") % 7 / 100.0).alias("lag"), F.lit(100.0).alias("sample_rate"))
    return sync.apply_alignment(df, params).select("recording", "idx", _r("time", 6).alias("time"))


PIXELS = "px AS (SELECT l_suppkey AS recording, CASE WHEN l_linenumber % 2 = 0 THEN 'L' ELSE 'R' END AS view, l_orderkey % 50 AS frame, l_partkey % 64 AS px, l_linenumber AS py, l_quantity AS red, l_quantity * 2 AS green, l_tax * 100 AS blue FROM lineitem)"


@query(
    "y01_crop_brightness",
    f"WITH {PIXELS} SELECT recording, view, frame, round(avg(0.299 * red + 0.587 * green + 0.114 * blue), 6) AS v FROM px WHERE (view = 'L' AND px >= 10 AND px < 50) OR (view = 'R' AND py >= 2) GROUP BY ALL",
)
def _(spark, sf):
    line = derived.table(spark, sf, "lineitem")
    c = F.col
    view = F.when(c("l_linenumber") % 2 == 0, "L").otherwise("R")
    pixels = line.select(
        c("l_suppkey").alias("recording"), view.alias("view"), (c("l_orderkey") % 50).alias("frame"), (c("l_partkey") % 64).alias("px"), c("l_linenumber").alias("py"),
        c("l_quantity").alias("red"), (c("l_quantity") * 2).alias("green"), (c("l_tax") * 100).alias("blue"),
    )
    crops = spark.createDataFrame([("L", 10, 50, None, None), ("R", None, None, 2, None)], "view string, sx int, ex int, sy int, ey int")
    return sync.crop_brightness(pixels, crops).select("recording", "view", "frame", _r("v", 6).alias("v"))


@query(
    "y02_led_signal",
    f"""WITH {S}, {BINS.format(n=100, m=99, src='s')}, c AS (SELECT recording, lo, hi, bin, count(*) AS n FROM b GROUP BY ALL),
    f AS (SELECT recording, arg_max(lo + (bin + 1) * (hi - lo) / 100, [n, -bin]) AS base FROM c GROUP BY recording),
    a AS (SELECT s.recording, idx, v - base AS above FROM s JOIN f USING (recording)), p AS (SELECT recording, quantile_cont(above, 0.75) AS p75 FROM a WHERE above > 2 GROUP BY 1),
    k AS (SELECT recording, quantile_cont(above, 0.9) AS p90 FROM a JOIN p USING (recording) WHERE above >= p75 GROUP BY 1), mx AS (SELECT recording, max(above) AS most FROM a GROUP BY 1)
    SELECT recording, idx, CAST(above > 0.9 * coalesce(p90, most) AS INTEGER) AS "on" FROM a JOIN mx USING (recording) LEFT JOIN k USING (recording)""",
)
def _(spark, sf):
    return sync.led_signal(derived.series(spark, sf)).select("recording", "idx", "on")


@query("y03_threshold", f'WITH {S} SELECT recording, idx, CAST(v > 60.5 AS INTEGER) AS "on" FROM s')
def _(spark, sf):
    return sync.threshold_signal(derived.series(spark, sf), 60.5).select("recording", "idx", "on")


@query("y04_crop_edges", f"WITH {SYNC}, {EDGES % 'r'} SELECT recording, edge - recording % 5 AS edge FROM e WHERE edge >= recording % 5")
def _(spark, sf):
    return sync.crop_edges(series.rising_edges(derived.sync_reference(spark, sf)), F.col("recording") % 5)


@query(
    "y05_resample",
    f"""WITH {SYNC} SELECT 'down' AS way, recording, idx // 3 AS idx, "on" FROM r WHERE idx % 3 = 0 UNION ALL SELECT 'up', recording, idx * 2 + k, "on" FROM r, (SELECT unnest(range(2)) AS k)""",
)
def _(spark, sf):
    df = derived.sync_reference(spark, sf)
    down = sync.resample(df, 300, 100).withColumn("way", F.lit("down"))
    return down.unionByName(sync.resample(df, 100, 200).withColumn("way", F.lit("up"))).select("way", "recording", "idx", "on")


CROSS = """prs AS (SELECT r.recording, r.idx - z.idx AS lag, count(*) AS corr FROM r JOIN z ON r.recording = z.recording AND r."on" = 1 AND z."on" = 1 GROUP BY ALL),
 best AS (SELECT recording, corr, lag FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY corr DESC, abs(lag - 1), lag) AS k FROM prs) WHERE k = 1)"""


@query(
    "y06_crosscorr",
    f"""WITH {ALIGN}, {CROSS}, {EDGES % 'r'}, er AS (SELECT recording, count(*) AS n FROM e GROUP BY 1),
    e2 AS (SELECT recording, idx AS edge FROM (SELECT *, lead("on") {W}) AS nx FROM z) WHERE nx - "on" > 0), et AS (SELECT recording, count(*) AS n FROM e2 GROUP BY 1)
    SELECT recording, lag, round(lag / 100.0, 6) AS lag_time, corr, corr = least(coalesce(er.n, 0), coalesce(et.n, 0)) AS good FROM best LEFT JOIN er USING (recording) LEFT JOIN et USING (recording)""",
)
def _(spark, sf):
    found = sync.crosscorr_align(derived.sync_reference(spark, sf), derived.sync_target(spark, sf), 100.0)
    return found.select("recording", "lag", _r("lag_time", 6).alias("lag_time"), "corr", "good")


REGRESS = f"""{EDGES % 'r'}, a AS (SELECT recording, edge / 100.0 AS x, row_number() OVER (PARTITION BY recording ORDER BY edge) AS k FROM e),
 e2 AS (SELECT recording, idx AS edge FROM (SELECT *, lead("on") {W}) AS nx FROM z) WHERE nx - "on" > 0), b AS (SELECT recording, edge / 100.0 AS y, row_number() OVER (PARTITION BY recording ORDER BY edge) AS k FROM e2),
 pr AS (SELECT recording, x, y FROM a JOIN b USING (recording, k)), ln AS (SELECT recording, regr_slope(y, x) AS slope, regr_intercept(y, x) AS ic, count(*) AS pairs FROM pr GROUP BY 1)"""


@query(
    "y07_regression",
    f"""WITH {ALIGN}, {REGRESS}, er AS (SELECT recording, sqrt(avg(pow(y - slope * x - ic, 2))) AS rmse FROM pr JOIN ln USING (recording) GROUP BY 1)
    SELECT recording, round(slope, 4) AS slope, round(slope * (0 - ic), 4) + 0 AS lag, pairs, coalesce(rmse < 0.05, false) AS good FROM ln JOIN er USING (recording) WHERE pairs > 1""",
)
def _(spark, sf):
    r, z = (series.rising_edges(d(spark, sf)) for d in (derived.sync_reference, derived.sync_target))
    found = sync.regression_align(r, z, 100.0, 100.0, 0.05).filter("pairs > 1")
    return found.select("recording", _r("slope").alias("slope"), (_r("lag") + F.lit(0.0)).alias("lag"), "pairs", "good")


E2 = """e2 AS (SELECT recording, idx AS edge FROM (SELECT *, lead("on") OVER (PARTITION BY recording ORDER BY idx) AS nx FROM z) WHERE nx - "on" > 0)"""
NUMBERED = "row_number() OVER (PARTITION BY recording ORDER BY edge) AS k"


@query(
    "y08_samplerate",
    f"""WITH {ALIGN}, {EDGES % 'r'}, {E2}, p AS (SELECT recording, k, a.edge AS x, b.edge AS y FROM (SELECT *, {NUMBERED} FROM e) a JOIN (SELECT *, {NUMBERED} FROM e2) b USING (recording, k)),
    g AS (SELECT recording, x - lag(x) OVER w AS x, y - lag(y) OVER w AS y FROM p WINDOW w AS (PARTITION BY recording ORDER BY k)), m AS (SELECT recording, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM g GROUP BY 1)
    SELECT recording, round((y / 110.0) / nullif(x / 100.0, 0), 4) AS ratio, round(110 * (y / 110.0) / nullif(x / 100.0, 0), 3) AS sample_rate FROM m WHERE x IS NOT NULL AND y IS NOT NULL""",
)
def _(spark, sf):
    r, z = (series.rising_edges(d(spark, sf)) for d in (derived.sync_reference, derived.sync_target))
    found = sync.samplerate_align(r, z, 100.0, 110.0).filter("good")
    return found.select("recording", _r("ratio").alias("ratio"), _r("sample_rate", 3).alias("sample_rate"))


def _cropped_sql(edges, state, cut):
    return f"SELECT recording, k, edge - cut AS edge FROM (SELECT recording, edge, cut, row_number() OVER (PARTITION BY recording ORDER BY edge) AS k FROM {edges} JOIN (SELECT recording, {cut} AS cut FROM {state}) USING (recording) WHERE edge >= cut)"


CUT_T, CUT_R = "CASE WHEN lag > 0 THEN CAST(trunc(lag * rate) AS INTEGER) ELSE 0 END", "CASE WHEN lag < 0 THEN CAST(trunc(-lag * 100.0) AS INTEGER) ELSE 0 END"


@query(
    "y09_align_stages",
    f"""WITH {ALIGN}, {EDGES % 'r'}, {E2}, zz AS (SELECT recording, idx // 2 AS idx, "on" FROM z WHERE idx % 2 = 0), {CROSS.replace('JOIN z ON r.recording = z.recording', 'JOIN zz z ON r.recording = z.recording')},
    nr AS (SELECT recording, count(*) AS n FROM e GROUP BY 1), nt AS (SELECT recording, count(*) AS n FROM e2 GROUP BY 1),
    s1 AS (SELECT u.recording, CASE WHEN corr = least(coalesce(nr.n, 0), coalesce(nt.n, 0)) THEN best.lag / 200.0 END AS lag, 1.0::DOUBLE AS slope, 200.0::DOUBLE AS rate, coalesce(corr = least(coalesce(nr.n, 0), coalesce(nt.n, 0)), false) AS good
      FROM (SELECT DISTINCT recording FROM z) u LEFT JOIN best USING (recording) LEFT JOIN nr USING (recording) LEFT JOIN nt USING (recording)),
    p AS (SELECT recording, a.edge / 100.0 AS x, b.edge / rate AS y FROM ({_cropped_sql('e', 's1', CUT_R)}) a JOIN ({_cropped_sql('e2', 's1', CUT_T)}) b USING (recording, k) JOIN s1 USING (recording)),
    ln AS (SELECT recording, regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic FROM p GROUP BY 1), er AS (SELECT recording, sqrt(avg(pow(y - sl * x - ic, 2))) AS rmse FROM p JOIN ln USING (recording) GROUP BY 1),
    s2 AS (SELECT recording, CASE WHEN rmse < 0.05 THEN sl * (coalesce(lag, 0) - ic) ELSE lag END AS lag, CASE WHEN rmse < 0.05 THEN sl ELSE slope END AS slope, CASE WHEN rmse < 0.05 THEN sl * rate ELSE rate END AS rate, good OR coalesce(rmse < 0.05, false) AS good
      FROM s1 LEFT JOIN ln USING (recording) LEFT JOIN er USING (recording)),
    q AS (SELECT recording, k, a.edge AS x, b.edge AS y FROM ({_cropped_sql('e', 's2', CUT_R)}) a JOIN ({_cropped_sql('e2', 's2', CUT_T)}) b USING (recording, k)),
    g AS (SELECT recording, x - lag(x) OVER w AS x, y - lag(y) OVER w AS y FROM q WINDOW w AS (PARTITION BY recording ORDER BY k)),
    m AS (SELECT recording, (quantile_cont(y, 0.5) / rate) / nullif(quantile_cont(x, 0.5) / 100.0, 0) AS ratio FROM g JOIN s2 USING (recording) GROUP BY recording, rate)
    SELECT recording, round(CASE WHEN ratio IS NOT NULL THEN coalesce(lag, 0) * ratio ELSE lag END, 4) + 0 AS lag, round(slope, 4) AS slope, round(rate * coalesce(ratio, 1), 3) AS sample_rate, good OR ratio IS NOT NULL AS good FROM s2 LEFT JOIN m USING (recording)""",
)
def _(spark, sf):
    found = sync.align(derived.sync_reference(spark, sf), derived.sync_target(spark, sf), 100.0, 200.0)
    return found.select("recording", (_r("lag", 4) + F.lit(0.0)).alias("lag"), _r("slope", 4).alias("slope"), _r("sample_rate", 3).alias("sample_rate"), "good")


@query(
    "y10_apply_alignment",
    f"""WITH {ALIGN}, {CROSS} SELECT z.recording, z.idx, round(z.idx / 100.0 + best.lag / 100.0, 6) AS time, r."on" = z."on" AS same
    FROM z JOIN best USING (recording) JOIN r ON r.recording = z.recording AND r.idx = z.idx + best.lag""",
)
def _(spark, sf):
    ref, target = derived.sync_reference(spark, sf), derived.sync_target(spark, sf)
    params = sync.crosscorr_align(ref, target, 100.0).select("recording", F.col("lag_time").alias("lag"), F.lit(100.0).alias("sample_rate"))
    timed = sync.apply_alignment(target, params).withColumn("at", F.round(F.col("time") * 100).cast("int"))
    both = timed.join(ref.select("recording", F.col("idx").alias("at"), F.col("on").alias("other")), ["recording", "at"])
    return both.select("recording", "idx", _r("time", 6).alias("time"), (F.col("on") == F.col("other")).alias("same"))


# ---- spikes


@query(
    "a14_firing_rate",
    f"""WITH {SPIKES}, b AS (SELECT unit, t_us // 1000000 AS bin, count(*) AS n FROM sp GROUP BY ALL), g AS (SELECT unit, unnest(range((SELECT max(bin) + 1 FROM b))) AS bin FROM (SELECT DISTINCT unit FROM b))
    SELECT unit, g.bin, coalesce(n, 0) * 1.0::DOUBLE AS rate FROM g LEFT JOIN b USING (unit, bin)""",
)
def _(spark, sf):
    return spikes.firing_rate(derived.spikes(spark, sf), 1_000_000)


def _binned_movement(spark, sf):
    moves = derived.movement(spark, sf).withColumn("k", F.lit(1))
    return tables.equal_bins(moves, 20, "v", ("k",)).select("frame", F.col("bin").cast("int").alias("bin"))


TUNE = f"""{MOVE}, mb AS (SELECT frame, least(CAST(floor(v / (SELECT max(v) FROM mv) * 20) AS INTEGER), 19) AS bin FROM mv), tb AS (SELECT bin, count(*) / 100.0 AS seconds FROM mb GROUP BY 1)"""


@query(
    "a15_tuning_curve",
    f"""WITH {TUNE}, h AS (SELECT unit, bin, count(*) AS spikes FROM sp JOIN mb ON mb.frame = t_us // 10000 GROUP BY ALL), u AS (SELECT DISTINCT unit FROM sp)
    SELECT unit, bin, coalesce(spikes, 0) AS spikes, round(seconds, 4) AS seconds, round(coalesce(spikes, 0) / seconds, 4) AS rate FROM (SELECT * FROM u, tb) g LEFT JOIN h USING (unit, bin)""",
)
def _(spark, sf):
    framed = derived.spikes(spark, sf).select("unit", tables.frame_of(F.col("t_us")).alias("frame"))
    found = spikes.tuning_curve(framed, _binned_movement(spark, sf))
    return found.select("unit", "bin", "spikes", _r("seconds").alias("seconds"), _r("rate").alias("rate"))


SAMPLES = "sm AS (SELECT event_id % 8 AS channel, CAST(row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) - 1 AS BIGINT) AS sample, value AS v FROM events)"


@query(
    "a19_mean_waveform",
    f"""WITH {SAMPLES}, k AS (SELECT channel, sample AS spike FROM sm WHERE v > 300), m AS (SELECT k.channel, off, count(*) AS n, avg(v) AS a FROM k, (SELECT unnest(range(-10, 10)) AS off) JOIN sm ON sm.channel = k.channel AND sm.sample = spike + off GROUP BY ALL)
    SELECT channel, off, n, round(a - arg_min(a, off) OVER (PARTITION BY channel), 4) AS v FROM m""",
)
def _(spark, sf):
    sm = derived.samples(spark, sf)
    rows = spikes.waveform_rows(sm.filter("v > 300").select("channel", F.col("sample").alias("spike")), sm)
    return spikes.mean_waveform(rows).select("channel", "off", "n", _r("v").alias("v"))


@query("a20_sampled_spikes", f"WITH {SPIKES} SELECT unit, t_us FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY md5('0:' || t_us), t_us) AS k FROM sp) WHERE k <= 100")
def _(spark, sf):
    return spikes.sampled_spikes(derived.spikes(spark, sf), 100)


@query("t03_spike_train", f"WITH {SPIKES} SELECT DISTINCT unit, t_us // 1000 AS ms, (t_us // 1000) * 1000 AS t_us FROM sp")
def _(spark, sf):
    train = spikes.spike_train(derived.spikes(spark, sf))
    return train.select("unit", "ms", (F.col("ms") * 1000).alias("t_us"))


#: Permutations of a spike train.
SHUFFLES = 1000


PERM = f"""{SPIKES}, tr AS (SELECT DISTINCT unit, t_us // 1000 AS ms FROM sp), pm AS (SELECT id AS perm, CASE WHEN d < 45000 THEN d + 15000 ELSE d - 105000 END AS shift FROM (SELECT id, ('0x' || substr(md5('0:' || id), 1, 12))::BIGINT % 90000 AS d FROM (SELECT unnest(range({SHUFFLES})) AS id))),
 sh AS (SELECT unit, perm, (((ms + shift) % 600001) + 600001) % 600001 AS ms FROM tr, pm)"""


@query("t04_cyclic_shuffle", f"WITH {PERM} SELECT unit, perm, count(DISTINCT ms) AS n, min(ms) AS first FROM sh GROUP BY ALL")
def _(spark, sf):
    train = spikes.spike_train(derived.spikes(spark, sf))
    return permutations.shuffled_trains(train, 600_001, SHUFFLES)


@query(
    "t05_tuning_envelope",
    f"""WITH {PERM}, {TUNE[len(SPIKES) + 2:]}, h AS (SELECT unit, perm, bin, count(*) AS n FROM sh JOIN mb ON mb.frame = ms // 10 GROUP BY ALL), g AS (SELECT unit, perm, bin, seconds FROM (SELECT DISTINCT unit FROM tr), (SELECT perm FROM pm), tb),
    c AS (SELECT unit, perm, bin, coalesce(n, 0) / seconds AS rate FROM g LEFT JOIN h USING (unit, perm, bin)) SELECT unit, bin, round(quantile_cont(rate, 0.025), 4) AS low, round(quantile_cont(rate, 0.975), 4) AS high FROM c GROUP BY ALL""",
)
def _(spark, sf):
    train = spikes.spike_train(derived.spikes(spark, sf))
    found = permutations.tuning_envelope(train, _binned_movement(spark, sf), 600_001, SHUFFLES)
    return found.select("unit", "bin", _r("low").alias("low"), _r("high").alias("high"))


def _by_session(df):
    """Spikes dealt to three sessions by their millisecond; two of these have movements."""
    return df.withColumn("session", F.concat(F.lit("s"), F.expr("ms % 3").cast("string")))


def _session_moves(spark, sf):
    """Two features of two sessions, of different length."""
    moves = derived.movement(spark, sf).select("frame", "v", F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("session"))
    moves = moves.filter("session = 's0' or frame % 5 < 4").select("session", "frame", F.explode(F.array(F.lit("fast"), F.lit("slow"))).alias("feature"), "v")
    return moves.withColumn("v", F.when(F.col("feature") == "slow", F.pmod(F.expr("frame div 50"), F.lit(40)) / 40.0).otherwise(F.col("v")))


SESSIONS = f"""{MOVE}, tr AS (SELECT DISTINCT unit, t_us // 1000 AS ms FROM sp), tq AS (SELECT 's' || (ms % 3) AS session, unit, ms FROM tr),
 mf AS (SELECT session, feature, frame, CASE feature WHEN 'slow' THEN ((frame // 50) % 40) / 40.0 ELSE v END::DOUBLE AS v
   FROM mv, (VALUES ('s0'), ('s1')) AS a(session), (VALUES ('fast'), ('slow')) AS b(feature) WHERE session = 's0' OR frame % 5 < 4)"""


@query(
    "t05_session_envelopes",
    f"""WITH {SESSIONS}, pm AS (SELECT id AS perm, CASE WHEN d < 45000 THEN d + 15000 ELSE d - 105000 END AS shift FROM (SELECT id, ('0x' || substr(md5('7:' || id), 1, 12))::BIGINT % 90000 AS d FROM (SELECT unnest(range(200)) AS id))),
    mb AS (SELECT session, feature, frame, least(CAST(floor(v / max(v) OVER (PARTITION BY session, feature) * 20) AS INTEGER), 19) AS bin FROM mf), tb AS (SELECT session, feature, bin, count(*) / 100.0 AS seconds FROM mb GROUP BY ALL),
    sh AS (SELECT session, unit, perm, ((ms + shift) % 600001 + 600001) % 600001 // 10 AS frame FROM tq, pm), h AS (SELECT session, feature, unit, perm, bin, count(*) AS n FROM sh JOIN mb USING (session, frame) GROUP BY ALL),
    g AS (SELECT u.session, unit, feature, perm, bin, seconds FROM (SELECT DISTINCT session, unit FROM tq) u JOIN tb USING (session), (SELECT perm FROM pm)),
    c AS (SELECT session, unit, feature, bin, perm, coalesce(n, 0) / seconds AS rate FROM g LEFT JOIN h USING (session, unit, feature, perm, bin))
    SELECT session, unit, feature, bin, round(quantile_cont(rate, 0.025), 4) AS low, round(quantile_cont(rate, 0.975), 4) AS high FROM c GROUP BY ALL""",
)
def _(spark, sf):
    """Envelopes of 200 shuffles for every unit and feature of every session that has movements."""
    train = _by_session(spikes.spike_train(derived.spikes(spark, sf)))
    bins = tables.equal_bins(_session_moves(spark, sf), 20, "v", ("session", "feature"))
    found = permutations.tuning_envelope(train, bins, 600_001, 200, 7, session=["session"], feature=["feature"])
    return found.select("session", "unit", "feature", "bin", _r("low").alias("low"), _r("high").alias("high"))


XC = f"""{MOVE}, fr AS (SELECT unit, t_us // 10000 AS frame FROM sp), lg AS (SELECT unnest(range(-500, 500)) AS lag),
 xc AS (SELECT unit, lag, sum(v) AS corr FROM (SELECT unit, frame - lag AS frame, lag FROM fr, lg) q JOIN mv USING (frame) GROUP BY ALL)"""
BACKGROUND = "lag BETWEEN -500 AND -201 OR lag >= 200"


def _xcorr(spark, sf):
    train = derived.spikes(spark, sf).select("unit", F.expr("t_us div 1000").alias("ms"))
    return permutations.spike_xcorr(train, derived.movement(spark, sf), 600_010)


@query("t06_spike_xcorr", f"WITH {XC}, bg AS (SELECT unit, avg(corr) AS b FROM xc WHERE {BACKGROUND} GROUP BY 1) SELECT unit, lag, round(corr - b, 4) AS corr FROM xc JOIN bg USING (unit)")
def _(spark, sf):
    xc = _xcorr(spark, sf)
    background = xc.filter(BACKGROUND).groupBy("unit").agg(F.avg("corr").alias("b"))
    return xc.join(background, "unit").select("unit", "lag", _r(F.col("corr") - F.col("b")).alias("corr"))


@query(
    "t07_xcorr_peak",
    f"WITH {XC}, c AS (SELECT unit, lag, round(corr, 4) AS corr FROM xc WHERE lag BETWEEN -50 AND 49) SELECT unit, arg_max(lag, [corr, -lag]) AS peak_lag, max(corr) AS peak, arg_min(lag, [corr, lag]) AS trough_lag, min(corr) AS trough FROM c GROUP BY unit",
)
def _(spark, sf):
    return spikes.xcorr_peaks(_xcorr(spark, sf).withColumn("corr", _r("corr")))


@query("t07_xcorr_significance")
def _(spark, sf):
    """Peaks outside of the envelope of a thousand shuffles, at lags of -0.1 s to 0."""
    train = spikes.spike_train(derived.spikes(spark, sf))
    envelope = permutations.xcorr_envelope(train, derived.movement(spark, sf), 600_001, SHUFFLES)
    return spikes.xcorr_significance(_xcorr(spark, sf).withColumn("corr", _r("corr")), envelope)


@query(
    "t07_session_peaks",
    f"""WITH {SESSIONS}, lg AS (SELECT unnest(range(-50, 50)) AS lag), xc AS (SELECT session, unit, feature, lag, round(sum(v), 4) AS corr FROM (SELECT session, unit, ms // 10 - lag AS frame, lag FROM tq, lg) q JOIN mf USING (session, frame) GROUP BY ALL)
    SELECT session, unit, feature, arg_max(lag, [corr, -lag]) AS peak_lag, max(corr) AS peak, arg_min(lag, [corr, lag]) AS trough_lag, min(corr) AS trough FROM xc GROUP BY ALL""",
)
def _(spark, sf):
    """Peaks of every unit and feature of every session, each against the movements of its own session."""
    train = _by_session(spikes.spike_train(derived.spikes(spark, sf)))
    found = permutations.spike_xcorr(train, _session_moves(spark, sf), 600_010, (-50, 49), ["session"], feature=["feature"])
    return spikes.xcorr_peaks(found.withColumn("corr", _r("corr")), keys=("session", "unit", "feature"))
