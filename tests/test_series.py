import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.operators import jitter, model, paired, recursive, series, spectral, spikes, sync, tables


def signal(spark, values, name="v", key="r"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], f"recording string, idx int, {name} {'int' if name == 'on' else 'double'}")


def column(df, name, order="idx"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_moving_average_example(spark):
    df = series.moving_avg(signal(spark, [float(i) for i in range(12)]), 1, 2)
    assert column(df, "smooth") == [1, 3, 5, 7, 9]


@pytest.mark.parametrize("w", [3, 8])
def test_moving_average_equals_convolution(spark, w):
    v = np.random.default_rng(w).random(60)
    got = column(series.moving_avg(signal(spark, v.tolist()), w), "smooth")
    assert got == pytest.approx(np.convolve(v, np.ones(w) / w, "same")[w:-w].tolist())


def test_lag_matrix_example(spark):
    rows = series.lagged_features(signal(spark, [float(i) for i in range(10)]), ["v"], 0, bias=False, initial=True).orderBy("idx").collect()
    assert [(r.v_initial, r.v_lag0) for r in rows] == [(0.0, float(i)) for i in range(10)]


def test_edges_and_segments(spark):
    df = signal(spark, [0, 0, 1, 1, 0, 1], "on")
    assert column(series.rising_edges(df), "edge", "edge") == [1, 4]
    assert [(r.start, r.end) for r in series.pulse_segments(df).orderBy("start").collect()] == [(2, 3), (5, 5)]
    assert series.rising_edges(signal(spark, [1, 1, 0], "on")).count() == 0


def test_constant_series(spark):
    df = signal(spark, [2.0, 2.0, 2.0])
    assert column(series.zscore(df), "z") == [0, 0, 0]
    assert column(series.minmax(df), "scaled") == [None, None, None]


def test_interpolation_ends_and_gaps(spark):
    got = column(series.interpolate(signal(spark, [None, 1.0, None, None, 4.0, None])), "v")
    assert got == pytest.approx([1, 1, 2, 3, 4, 4])


def test_running_median_pads_with_zeros(spark):
    assert column(series.running_median(signal(spark, [5.0, 6.0, 7.0, 8.0]), 3), "median") == [5, 6, 7, 7]


def test_mask_around(spark):
    df = signal(spark, [1.0] * 30)
    got = column(series.mask_around(df, F.col("idx") == 15, 3), "v")
    assert [i for i, v in enumerate(got) if v is None] == [12, 13, 14, 15, 16, 17]


def test_crosscorr_finds_shift_and_clock(spark):
    rng = np.random.default_rng(2)
    on = np.zeros(400, int)
    for at in rng.choice(np.arange(20, 380, 12), 12, replace=False):
        on[at] = 1  # a pulse of one sample; longer ones coincide in more pairs than there are edges
    ref, late = signal(spark, on.tolist(), "on"), signal(spark, ([0] * 7 + on.tolist())[:400], "on")
    found = sync.crosscorr_align(ref, late, 100.0).first()
    assert (found.lag, found.good) == (-7, True)
    edges = spark.createDataFrame([("r", 100 * k) for k in range(1, 9)], "recording string, edge int")
    slow = spark.createDataFrame([("r", 101 * k) for k in range(1, 9)], "recording string, edge int")
    line = sync.regression_align(edges, slow, 100.0, 100.0, 0.01).first()
    assert line.slope == pytest.approx(1.01) and line.rmse == pytest.approx(0, abs=1e-9) and line.good
    # The rule of the cut moves equal edges apart, so the regression adds twice the lag; the other side doesn't.
    assert sync.align(ref, late, 100.0, 100.0).first().lag == pytest.approx(-0.21)
    both = sync.align(ref, late, 100.0, 100.0, aligned=True).first()
    assert both.good and both.lag == pytest.approx(-0.07) and both.sample_rate == pytest.approx(100)


def test_runs_count_the_same_lags_as_samples(spark):
    """Cross-correlation by runs against all pairs of ones, with plateaus and a bound on the lag."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for n in range(12):
        r, t = (np.repeat(rng.integers(0, 2, 12), rng.integers(1, 9, 12)) for _ in range(2))
        rows.append((r, t))
        lags = np.subtract.outer(np.flatnonzero(r), np.flatnonzero(t)).ravel()
        for most in (None, 5):
            near = lags if most is None else lags[np.abs(lags) <= most]
            if len(near):
                found, counts = np.unique(near, return_counts=True)
                want[n, most] = min((-c, abs(x - 1), x) for x, c in zip(found.tolist(), counts.tolist()))
    frame = lambda side: spark.createDataFrame([(n, i, int(v)) for n, pair in enumerate(rows) for i, v in enumerate(pair[side])], "recording int, idx int, on int")
    for most in (None, 5):
        got = {r.recording: (-r.corr, abs(r.lag - 1), r.lag) for r in sync.crosscorr_align(frame(0), frame(1), 100.0, most).collect()}
        assert got == {n: w for (n, m), w in want.items() if m == most}


def test_partial_match_and_reports(spark):
    from posegrid.operators import manifest

    rows = lambda *x: spark.createDataFrame(list(x), "session string, name string, attributes map<string,string>")
    recordings = rows(("s", "b", {"k": "1"}), ("s", "a", {}), ("t", "c", {"k": "2"}))
    files = rows(("s", "f2", {"k": "1"}), ("s", "f1", {"k": "1", "z": "0"}), ("t", "f3", {"k": "1"}))
    assert sorted(map(tuple, manifest.match_ephys_partial(recordings, files).collect())) == [("s", "a", "f1"), ("s", "b", "f2")]
    matched = manifest.match_calibration(recordings, files)
    assert [tuple(r) for r in manifest.uncalibrated(recordings, matched).collect()] == [("t", "c")]


def test_shuffled_correlations_equal_the_join_session_by_session(spark):
    from posegrid.operators import permutations

    rng = np.random.default_rng(6)
    length = 30_001
    rows = [(s, u, int(m)) for s in ("one", "two") for u in ("a", "b") for m in np.unique(np.concatenate([rng.integers(0, length, 150), [0, 5, length - 1]]))]
    train = spark.createDataFrame(rows, "session string, unit string, ms long")
    moves = [(s, f, i, float(rng.random())) for s in ("one", "two") for f in ("x", "y") for i in range(3001 if s == "one" else 2000)]
    frames = spark.createDataFrame(moves, "session string, feature string, frame long, v double")
    shifts = permutations.drawn_shifts(9)
    assert shifts.tolist() == [r.shift for r in spikes.permutations(spark, 9).orderBy("perm").collect()]
    on = ("session", "unit", "feature")
    got = {tuple(r)[:4]: (r.low, r.high) for r in permutations.xcorr_envelope(train, frames, length, 9, 0, (-50, 49), 0.1, 9, ["session"], ["unit"], ["feature"]).collect()}
    shuffled = spikes.cyclic_shuffle(train.withColumn("unit", F.struct("session", "unit")), spikes.permutations(spark, 9), length)
    moved = shuffled.select("unit.session", "unit.unit", "perm", F.expr("ms div 10").alias("frame"))
    joined = spikes.spike_xcorr(moved, frames, 50, ("unit", "feature", "perm"), ("session",)).filter("lag < 50").collect()
    want = {}
    for r in joined:
        want.setdefault((r.session, r.unit, r.feature, r.lag), []).append(r.corr)
    assert got.keys() == want.keys()
    for key, values in want.items():
        values += [0.0] * (9 - len(values))
        assert np.allclose(got[key], np.quantile(values, [0.1, 0.9]), atol=1e-6)
    # Without a shuffle, and each spike counted: equal times of a unit are two spikes.
    twice = train.union(train)
    whole = {(r.session, r.unit, r.feature, r.lag): r.corr for r in permutations.spike_xcorr(twice, frames, 30_010, (-50, 49), ["session"], ["unit"], ["feature"]).collect()}
    framed = twice.select("session", "unit", F.expr("ms div 10").alias("frame"))
    for r in spikes.spike_xcorr(framed, frames, 50, ("unit", "feature"), ("session",)).filter("lag < 50").collect():
        assert abs(whole[r.session, r.unit, r.feature, r.lag] - r.corr) < 1e-6
    assert permutations.tuning_envelope(train.limit(0), frames.select("session", "frame", F.lit(0).alias("bin")), length, 3, session=["session"]).count() == 0
    peaks = spikes.xcorr_significance(
        permutations.spike_xcorr(train, frames, 30_010, session=["session"], feature=["feature"]), permutations.xcorr_envelope(train, frames, length, 9, session=["session"], feature=["feature"]), keys=on
    )
    assert peaks.count() == 8


def test_align_without_pulses_and_with_unknown_stage(spark):
    quiet = signal(spark, [0] * 10, "on")
    found = sync.align(quiet, quiet, 100.0, 50.0).first()
    assert found.lag is None and found.sample_rate == 50 and not found.good
    with pytest.raises(ValueError):
        sync.align(quiet, quiet, 1.0, 1.0, stages=("sample_rate",))


def test_nearest_and_ties(spark):
    times = spark.createDataFrame([("a", t) for t in (0, 5, 10, 14, 999)], "k string, t long")
    samples = spark.createDataFrame([("a", s, float(s)) for s in (0, 10, 20, 40)], "k string, s long, v double")
    for bucket in (7, 1000):
        got = {r.t: r.s for r in tables.nearest(times, samples, "k", bucket).collect()}
        assert got == {0: 0, 5: 0, 10: 10, 14: 10, 999: 40}


def test_shift_frames(spark):
    df = signal(spark, [1.0, 2.0, 3.0])
    assert column(tables.shift_frames(df, 1), "v") == [2, 3]
    assert column(tables.shift_frames(df, -2), "v") == [1, 1, 1]


def test_region_rules(spark):
    names = {"nose(tip)": "nose", "pad(top)(left)": "whiskers", "upperlip(left)": "mouth", "eye(top)(right)": "eye(right)", "ref(head-post)": None}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", tables.region_of(F.col("n")).alias("r")).collect()
    assert {r.n: r.r for r in got} == names
    with pytest.raises(Exception, match="no region"):
        spark.createDataFrame([("tail",)], "n string").select(tables.region_of(F.col("n"))).collect()


def test_sine_is_in_the_delta_band(spark):
    v = np.sin(2 * np.pi * 3 * np.arange(2000) / 100)
    bands = spectral.band_powers(spectral.spectrogram(signal(spark, v.tolist()), 100.0, 400)).collect()
    assert len(bands) == 5 and all(b.delta > 10 * b.low and b.delta > 10 * b.theta for b in bands)


def test_filter_passes_steps(spark):
    sections = [[0.2, 0.2, 0.0, 1.0, -0.6, 0.0]]
    got = column(recursive.sos_filter(signal(spark, [1.0] * 60), sections), "v")
    assert got[0] == pytest.approx(0.2) and got[-1] == pytest.approx(1.0)


def test_shuffle_keeps_spikes(spark):
    train = spark.createDataFrame([("u", int(t)) for t in np.random.default_rng(1).choice(600_000, 500, replace=False)], "unit string, ms long")
    shifts = spikes.permutations(spark, 40)
    assert all(15_000 <= abs(r.shift) <= 60_000 for r in shifts.collect())
    counts = spikes.cyclic_shuffle(train, shifts, 600_000).distinct().groupBy("perm").count().collect()
    assert {r["count"] for r in counts} == {500}


def test_wilcoxon_exact_and_ties(spark):
    rows = [("a", 0.0, float(d)) for d in (1, 2, 3, -4, 5, 0)] + [("b", 0.0, 1.0)] * 60
    got = {r.k: r for r in paired.wilcoxon(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]).collect()}
    assert (got["a"].n, got["a"].w) == (5, 11) and got["a"].p == pytest.approx(7 / 32)
    assert got["b"].p < 1e-10


def test_t_tail():
    assert paired._t_tail(0.0, 5) == pytest.approx(0.5)
    assert paired._t_tail(2.015048, 5) == pytest.approx(0.05, abs=1e-5)


def test_lasso_on_grams_equals_plain_descent(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(4):
        x = rng.normal(size=(30, 2))
        y = 2 * x[:, 0] + 0.1 * rng.normal(size=30) + 1
        rows += [(f"s{s}", float(a), float(b), float(c)) for (a, b), c in zip(x, y)]
    df = spark.createDataFrame(rows, "session string, a double, b double, y double")
    sessions = df.select("session").distinct()
    splits = model.holdout_splits(sessions, 1)
    assert splits.count() == 4
    models = model.lasso_grid(model.gram(df, ["a", "b"], "y"), model.loso_folds(splits, sessions), 2, [0.01, 1.0, 10.0])
    for r in models.collect():
        train = np.array([x[1:] for x in rows if x[0] != r.split])
        assert r.alpha == 0.01 and r.weights[0] == pytest.approx(1.99, abs=0.1) and abs(r.weights[1]) < 0.05
        # optimality: the gradient of the squared error is within alpha
        rest = train[:, 2] - r.intercept - train[:, :2] @ np.array(r.weights)
        assert np.all(np.abs(train[:, :2].T @ rest / len(train)) <= 0.01 + 1e-6)
        assert 0 <= r.gap <= 1e-8
    asked = df.join(splits.select("split"))
    scored = {(s.split, s.session): (s.rmse, s.set) for s in model.score_sessions(model.predict_time(asked, models, ["a", "b"]), splits, "y").collect()}
    assert len(scored) == 16 and all(rmse < 0.3 for rmse, _ in scored.values()) and sum(kind == "Test" for _, kind in scored.values()) == 4
    by_gram = {(s.split, s.session): (s.rmse, s.set) for s in model.session_scores(models, splits).collect()}
    assert by_gram.keys() == scored.keys()
    for key, (rmse, kind) in scored.items():
        assert by_gram[key][1] == kind and abs(by_gram[key][0] - rmse) < 1e-9


def test_lasso_path_is_proven_at_every_alpha():
    rng = np.random.default_rng(5)
    for n, p in ((40, 6), (60, 34), (200, 34)):
        x = rng.normal(size=(n, p))
        x[:, 1] = x[:, 0] + 1e-3 * x[:, 1]
        x[:, p - 1] = x[:, 2]  # a repeated feature
        y = x[:, 0] - 2 * x[:, 3] + 0.3 * rng.normal(size=n)
        x, y = x - x.mean(0), y - y.mean()
        a, b, c = x.T @ x / n, x.T @ y / n, y @ y / n
        alphas = [10 ** (1 - 4 * i / 99) for i in range(100)]
        for alpha, w in zip(alphas, model.lasso_path(a, b, alphas)):
            w, gap = model.proven(a, b, c, alpha, w, 1e-9)
            assert gap <= 1e-9 * c and np.abs(x.T @ (y - x @ w) / n).max() <= alpha * (1 + 1e-3) + 1e-6
    with pytest.raises(ArithmeticError):
        model.proven(a, b, c, 1e-3, np.zeros(p), 1e-15, steps=1)


def test_gram_leaves_out_rows_with_missing_values(spark):
    rows = [("s", 1.0, 2.0), ("s", None, 5.0), ("s", 3.0, 1.0), (None, 2.0, 2.0), ("t", None, 1.0)]
    found = {r.session: r.gram for r in model.gram(spark.createDataFrame(rows, "session string, a double, y double"), ["a"], "y").collect()}
    assert found == {"s": [2.0, 4.0, 3.0, 10.0, 5.0, 5.0], None: [1.0, 2.0, 2.0, 4.0, 4.0, 4.0]}


def test_jitter_of_a_line(spark):
    rows = [("r", "k", i, float(i), 0.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "recording string, keypoint string, frame int, x double, y double, z double")
    got = {r.axis: r for r in jitter.point_jitter(df).collect()}
    assert got["x"].velocity_mean == 100 and got["x"].max_deviation == 2000 and got["y"].position_stddev == 0
    assert jitter.vector_jitter(df).first().velocity_mean == 100


def test_envelope_of_a_thousand_shuffles(spark):
    import numpy as np

    from posegrid.operators import spikes
    from posegrid.plans import catalogue, signals
    from posegrid.sources import derived

    sf = "/root/testdata/sf0.001"
    bins = {r.frame: r.bin for r in signals._binned_movement(spark, sf).collect()}
    seconds = {b: sum(x == b for x in bins.values()) / 100 for b in set(bins.values())}
    shifts = [r["shift"] for r in spikes.permutations(spark, 1000).collect()]
    train = {}
    for r in spikes.spike_train(derived.spikes(spark, sf)).collect():
        train.setdefault(r.unit, []).append(r.ms)
    got = {(r.unit, r.bin): (r.low, r.high) for r in catalogue.queries()["t05_tuning_envelope"](spark, sf).collect()}
    assert set(got) == {(u, b) for u in train for b in seconds}
    place = np.full(60_001, -1)
    for frame, b in bins.items():
        place[frame] = b
    for unit, ms in train.items():
        hit = [place[(np.array(ms) + shift) % 600_001 // 10] for shift in shifts]
        for b, s in seconds.items():
            low, high = np.percentile([(h == b).sum() / s for h in hit], [2.5, 97.5])
            assert abs(got[unit, b][0] - low) < 1e-3 and abs(got[unit, b][1] - high) < 1e-3


def test_lines_take_their_pairs_in_order(spark):
    """Slope and intercept are the same to the last bit however rows are dealt, and those of SQL over rows in order."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(6)
    rows = []
    for name, n in (("a", 15), ("b", 400), ("one", 1), ("level", 5), ("gap", 9)):
        edges = np.cumsum(rng.integers(1, 9, n))
        rows += [(name, k, 0.5 if name == "level" else int(e) / 100.0, None if (name, k) == ("gap", 4) else int(e + 3) / 200.0) for k, e in enumerate(edges)]
    values = ", ".join(f"('{r}', {k}, {x!r}::DOUBLE, {'NULL' if y is None else repr(y)}::DOUBLE)" for r, k, x, y in rows)
    sql = f"SELECT r, regr_slope(y, x ORDER BY k), regr_intercept(y, x ORDER BY k), count(*) FROM (VALUES {values}) AS v(r, k, x, y) GROUP BY r"
    # One point, or one value of x, gives no line; the SQL has NaN.
    want = sorted((r, None, None, n) if r in ("one", "level") else (r, slope, ic, n) for r, slope, ic, n in duckdb.connect().execute(sql).fetchall())
    for parts in (1, 3, 11):
        dealt = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "recording string, k int, x double, y double").repartition(parts)
        assert sorted(map(tuple, sync.ordered_lines(dealt).collect())) == want


def test_stages_cut_as_their_sql_does(spark, tmp_path):
    """Recordings whose lag is a whole number of samples, so that the last bit of the slope decides the next cut."""
    duckdb = pytest.importorskip("duckdb")
    from posegrid.plans import signals

    events, chosen = "/root/testdata/sf0.1/events.parquet", (305, 340, 389)
    spark.read.parquet(events).filter(F.col("user_id").isin(*chosen)).write.parquet(f"{tmp_path}/events.parquet")
    found = signals.QUERIES["y09_align_stages"](spark, str(tmp_path)).collect()
    own = duckdb.connect()
    own.execute(f"CREATE VIEW events AS SELECT * FROM '{events}'")
    # The SQL reads the whole table: on three recordings alone its joins deal pairs in another order, and 389 has another line.
    want = [r for r in own.execute(signals.ORACLES["y09_align_stages"]).fetchall() if r[0] in chosen]
    assert sorted(map(tuple, found)) == sorted(want)
