"""Operators for long recordings: each equals its namesake over whole series, or a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.operators import chunks, pose, quantiles, recursive, series, sync, tables


@pytest.fixture(scope="module")
def long(spark):
    """Three series, one with gaps in its index, one with null as its key, one shorter than a chunk."""
    rng = np.random.default_rng(2)
    rows = []
    for key, index in (("a", range(200)), ("b", np.unique(rng.integers(0, 900, 150)).tolist()), (None, range(90)), ("c", range(3))):
        for i in index:
            v = float(rng.normal())
            rows.append((key, int(i), v, None if rng.random() < 0.5 or 40 < i < 90 else v, int(rng.random() < 0.3), int(rng.random() < 0.6)))
    return spark.createDataFrame(rows, "recording string, idx long, v double, g double, flag int, on int").repartition(3).cache()


def same(a, b):
    assert a.columns == b.columns
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    for x, y in zip(sorted(map(tuple, a.collect()), key=key), sorted(map(tuple, b.collect()), key=key), strict=True):
        assert x[:2] == y[:2] and all((p is None) == (q is None) and (p is None or p == pytest.approx(q)) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_chunked_windows_equal_whole_ones(long, chunk):
    dense = long.filter("recording in ('a', 'c') or recording is null")
    cut = {"chunk": chunk}
    same(chunks.velocity(long, **cut), series.velocity(long))
    same(chunks.velocity(dense, first=0.0, dense=True, **cut), series.velocity(dense, first=0.0))
    same(chunks.moving_avg(long, 8, 3, **cut), series.moving_avg(long, 8, 3))
    same(chunks.running_median(long.select("recording", "idx", "v"), 5, **cut), series.running_median(long.select("recording", "idx", "v"), 5))
    same(chunks.mask_around(long, F.col("flag") == 1, 3, **cut), series.mask_around(long, F.col("flag") == 1, 3))
    same(chunks.interpolate(long, "g", **cut), series.interpolate(long, "g"))
    same(chunks.rising_edges(long, **cut), series.rising_edges(long))
    same(chunks.lagged_features(long, ["v", "on"], 3, True, True, **cut), series.lagged_features(long, ["v", "on"], 3, True, True))


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_chunked_runs_and_counts_equal_whole_ones(long, chunk):
    same(chunks.pulse_segments(long, chunk=chunk), series.pulse_segments(long))
    both = long.select("recording", "idx", F.col("v").alias("up"), (F.col("v") * (F.col("flag") - 0.5)).alias("down"))
    same(chunks.bipolar_to_level(both, 0.1, chunk=chunk), series.bipolar_to_level(both, 0.1))
    edges = series.rising_edges(long)
    gaps = [r.gap for r in chunks.gaps(edges.filter("recording = 'a'"), chunk=chunk).orderBy("edge").collect()]
    at = [r.edge for r in edges.filter("recording = 'a'").orderBy("edge").collect()]
    assert gaps == [None, *np.diff(at).tolist()]


def test_chunks_of_nothing(long):
    assert chunks.interpolate(long.limit(0), "g").count() == 0 and chunks.pulse_segments(long.limit(0)).count() == 0


def test_exact_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(8)
    groups = {"n": rng.normal(size=3000), "ties": rng.integers(0, 3, 3000).astype(float), "two": np.repeat([0.0, 5.0], 1500), "one": np.array([4.0]), None: rng.exponential(size=777)}
    groups["wild"] = np.array([np.nan, -np.inf, np.inf, 1.0, 2.0])
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("n", None), ("empty", None)]
    df = spark.createDataFrame(rows, "recording string, v double").repartition(5)
    shares = [0.0, 0.025, 0.5, 0.9, 0.999, 1.0]
    for few in (5, 200_000):
        got = {(r.recording, r.share): (r.n, r.percentile) for r in quantiles.percentiles(df, "v", shares, few=few, accuracy=100).collect()}
        assert len(got) == 6 * len(groups)
        for k, v in groups.items():
            for s in shares:
                if k != "wild":
                    assert got[k, s] == (len(v), pytest.approx(np.quantile(v, s), abs=1e-12))
        assert got["wild", 0.0][1] == -np.inf and np.isnan(got["wild", 1.0][1]) and got["wild", 0.5][1] == 2.0
    assert quantiles.percentiles(df.limit(0), "v", shares).count() == 0


SECTIONS = [[0.2, 0.3, 0.1, 2.0, -1.9, 0.95], [1.0, -1.2, 1.0, 1.0, -0.3, 0.5], [0.5, 0.1, 0.0, 1.0, 0.7, 0.0]]


def plain_filter(x):
    x = list(x)
    for b0, b1, b2, a0, a1, a2 in SECTIONS:
        z1 = z2 = 0.0
        for i, v in enumerate(x):
            y = (b0 * v + z1) / a0
            z1, z2, x[i] = b1 * v - a1 * y + z2, b2 * v - a2 * y, y
    return x


def test_recursive_filter_equals_the_loop(spark):
    rng = np.random.default_rng(1)
    signals = {"a": rng.normal(size=2500), "b": rng.normal(size=64), "c": rng.normal(size=1), None: rng.normal(size=300)}
    rows = [(k, 2 * i if k == "a" else i, float(v)) for k, x in signals.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "recording string, idx long, v double").repartition(4)
    for chunk in (100, 129, 1 << 16):
        got = {}
        for r in recursive.sos_filter(df, SECTIONS, chunk=chunk).orderBy("idx").collect():
            got.setdefault(r.recording, []).append(r.v)
        assert got.keys() == signals.keys()
        for k, x in signals.items():
            assert np.allclose(got[k], plain_filter(x), rtol=1e-9, atol=1e-9)


def test_recursive_filter_stops_at_missing_samples(spark):
    values = [1.0] * 300
    values[210] = None
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "recording string, idx long, v double")
    got = [r.v for r in recursive.sos_filter(df, SECTIONS, chunk=50).orderBy("idx").collect()]
    assert np.allclose(got[:210], plain_filter(values[:210])) and got[210:] == [None] * 90
    assert recursive.sos_filter(df.limit(0), SECTIONS).count() == 0


def test_a_long_signal_is_many_tasks(spark):
    """Two million samples in 31 chunks, as one pass of NumPy over the whole signal gives them."""
    n = 2_000_000
    df = spark.range(n).select(F.lit(1).alias("recording"), F.col("id").alias("idx"), F.sin(F.col("id") * F.lit(0.7) + F.col("id") % 13).alias("v"))
    i = np.arange(n)
    want = recursive.run(recursive._rows(SECTIONS), np.sin(i * 0.7 + i % 13), np.zeros(6))[0]
    assert np.allclose(want[:500], plain_filter(np.sin(i * 0.7 + i % 13)[:500]))
    probe = [0, 65_535, 65_536, 1_000_003, n - 1]
    got = {r.idx: r.v for r in recursive.sos_filter(df, SECTIONS).filter(F.col("idx").isin(probe)).collect()}
    assert all(abs(got[p] - want[p]) < 1e-9 for p in probe)


def test_events_on_uneven_frames(spark):
    rng = np.random.default_rng(3)
    times = {k: np.sort(rng.choice(2000, 40, replace=False) + 300) for k in ("a", "b")}
    frames = spark.createDataFrame([(k, i, int(t)) for k, v in times.items() for i, t in enumerate(v)], "session string, frame int, t_us long")
    asked = [(k, int(t), "x") for k in ("a", "b", "none") for t in [0, 5000, *rng.integers(0, 2600, 200), *times["a"][:5]]]
    events = spark.createDataFrame(asked, "session string, t_us long, _f string")
    for width in (50, 700, 10**9):
        got = sorted(map(tuple, tables.frame_at(events, frames, width=width).collect()), key=str)
        want = [(k, t, x, None if k not in times else int(np.clip(np.digitize(t, times[k]) - 1, 0, 39))) for k, t, x in asked]
        assert got == sorted(want, key=str)


@pytest.mark.parametrize("max_lag", [None, 3, 40])
def test_dense_correlation_equals_numpy(spark, max_lag):
    rng = np.random.default_rng(4)
    x, y = {"r": rng.normal(size=150), "s": rng.normal(size=20)}, {"r": rng.normal(size=90), "s": rng.normal(size=130)}
    frame = lambda d: spark.createDataFrame([(k, i, float(v)) for k, a in d.items() for i, v in enumerate(a)], "recording string, idx long, on double")
    got = {(r.recording, r.lag): r.corr for r in sync.dense_lag_sums(frame(x), frame(y), max_lag, block=32).collect()}
    want = {}
    for k in x:
        full = np.correlate(x[k], y[k], "full")
        want |= {(k, lag): c for lag, c in zip(range(-len(y[k]) + 1, len(x[k])), full) if max_lag is None or abs(lag) <= max_lag}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_dense_alignment_equals_that_of_runs(spark):
    rng = np.random.default_rng(7)
    on = (rng.random(400) < 0.5).astype(int)
    ref = spark.createDataFrame([("r", i, int(v)) for i, v in enumerate(on)], "recording string, idx long, on int")
    late = ref.withColumn("idx", F.col("idx") + 9)
    a, b = sync.crosscorr_align(ref, late, 100.0).first(), sync.dense_crosscorr_align(ref, late, 100.0).first()
    assert (a.lag, a.lag_time, a.corr) == (b.lag, b.lag_time, b.corr) == (-9, -0.09, int(on.sum()))


def test_triangulation_undoes_strong_lenses_and_tells_its_error(spark):
    rng = np.random.default_rng(9)
    cameras = {
        f"c{i}": {"matrix": [[700.0, 0, 320], [0, 710.0, 240], [0, 0, 1]], "rotation": [0.1 * i, -0.2 * i, 0.05], "translation": [5.0 * i, -3.0, 60.0], "size": [640, 480],
                  "distortions": [-0.25, 0.08, 0.002, -0.003, 0.01]}
        for i in range(3)
    }
    table = pose.cameras_df(spark, cameras)
    points = spark.createDataFrame([("r", k, "p", *map(float, rng.uniform(-12, 12, 3))) for k in range(30)], "recording string, frame int, keypoint string, x double, y double, z double")
    seen = pose.project_points(points, table).drop("x", "y", "z").withColumn("score", F.lit(0.95))
    got = {r.frame: r for r in pose.triangulate(seen, table).collect()}
    for p in points.collect():
        assert np.allclose([got[p.frame].x, got[p.frame].y, got[p.frame].z], [p.x, p.y, p.z], atol=1e-6) and got[p.frame].error < 1e-6 and got[p.frame].ncams == 3
    # A view that is off by some pixels: the error is the mean distance of the views from the projected point.
    moved = seen.withColumn("u", F.col("u") + F.when(F.col("camera") == "c1", 4.0).otherwise(0.0))
    found = pose.triangulate(moved, table)
    again = pose.project_points(found.select("recording", "frame", "keypoint", "x", "y", "z"), table).select("frame", "camera", F.col("u").alias("pu"), F.col("v").alias("pv"))
    want = moved.join(again, ["frame", "camera"]).groupBy("frame").agg(F.avg(F.sqrt((F.col("u") - F.col("pu")) ** 2 + (F.col("v") - F.col("pv")) ** 2)).alias("e"))
    errors = {r.frame: r.error for r in found.collect()}
    assert all(abs(errors[r.frame] - r.e) < 1e-9 and r.e > 0.1 for r in want.collect())


def test_labels_of_measurements(spark):
    from posegrid.functions import measurements as m

    names = ["eye-height-left-mm", "ear-width-right-mm", "ear-angle-left-deg", "mouth-area-mm2", "nose-bulge-volume-mm3", "snout"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", m.units_of(F.col("n")), m.kind_of(F.col("n"))).collect()
    assert [tuple(r)[1:] for r in rows] == [("mm", "distance"), ("mm", "distance"), ("deg", "angle"), ("mm^2", "area"), ("mm^3", "volume"), (None, "unknown")]


def test_average_ranks_with_and_without_keys(spark):
    rng = np.random.default_rng(5)
    rows = [(k, None if rng.random() < 0.05 else float(v)) for k, v in zip(rng.choice(["a", "b"], 300).tolist(), rng.integers(0, 40, 300))] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)

    def brute(values):
        ordered = sorted(-np.inf if v is None else v for v in values)
        return lambda v: (ordered.index(-np.inf if v is None else v) + 1) + (ordered.count(-np.inf if v is None else v) - 1) / 2

    whole = brute([v for _, v in rows])
    assert sorted(map(str, (tuple(r) for r in series.avg_rank(df, "v").collect()))) == sorted(str((k, v, whole(v))) for k, v in rows)
    own = {k: brute([v for kk, v in rows if kk == k]) for k in ("a", "b", None)}
    assert sorted(map(str, (tuple(r) for r in series.avg_rank(df, "v", ("k",)).collect()))) == sorted(str((k, v, own[k](v))) for k, v in rows)
    assert series.avg_rank(df.limit(0), "v").count() == 0


def test_shuffled_trains(spark):
    """Number and first millisecond of every shuffle, also of trains beyond the window, against shuffling."""
    from posegrid.operators import permutations

    rng = np.random.default_rng(4)
    trains = {"a": rng.integers(0, 100_000, 500), "b": np.array([0, 99_999, 100_000, 250_000]), "c": np.array([5])}
    frame = spark.createDataFrame([(u, int(m)) for u, ms in trains.items() for m in ms], "unit string, ms long")
    got = {(r.unit, r.perm): (r.n, r.first) for r in permutations.shuffled_trains(frame, 100_000, 50).collect()}
    shifts = permutations.drawn_shifts(50)
    want = {(u, p): (len(set(m)), min(m)) for u, ms in trains.items() for p, s in enumerate(shifts) for m in [((ms + s) % 100_000).tolist()]}
    assert got == want


def test_new_recordings_make_no_folders(spark, tmp_path):
    from posegrid.sources import readers

    for n in (40, 60):
        readers.write_features(spark.range(n).select(F.col("id").alias("recording"), F.lit(n).alias("v")), str(tmp_path / "f"))
    assert not [p for p in (tmp_path / "f").iterdir() if p.is_dir()]
    found = {r.recording: r.v for r in spark.read.parquet(str(tmp_path / "f")).collect()}
    assert found == {i: 40 if i < 40 else 60 for i in range(60)}


def test_dense_lag_sums_of_short_signals(spark):
    """A signal of a few samples late in a large block costs a transform of its own length: 2000 of them in seconds."""
    import time

    rows = spark.range(2000).select(F.col("id").alias("recording"), F.explode(F.sequence(F.lit(60_000), F.lit(60_009))).alias("idx"))
    late = rows.select("recording", (F.col("idx") + 3).alias("idx"), F.pmod("idx", F.lit(4)).alias("on"))
    begin = time.time()
    best = sync.dense_crosscorr_align(rows.withColumn("on", F.pmod("idx", F.lit(4))), late, 100.0).select("lag").distinct().collect()
    assert [r.lag for r in best] == [-3] and time.time() - begin < 8


def test_partial_match_of_many_files(spark):
    """Files of a session with different sets of attributes, against all pairs; 3000 a side in seconds."""
    import random
    import time

    from posegrid.operators import manifest

    rng = random.Random(1)

    def files(n, tag):
        names = [f"{tag}{i:05d}" for i in rng.sample(range(99_999), n)]
        return [("s", name, {k: str(rng.randrange(9)) for k in rng.sample(["day", "rig", "mouse"], rng.randrange(4))}) for name in names]

    def brute(ours, theirs):
        used, out = set(), []
        for _, name, has in sorted(ours, key=lambda f: f[1]):
            for _, other, own in sorted(theirs, key=lambda f: f[1]):
                if other not in used and all(has[k] == own[k] for k in has.keys() & own.keys()):
                    used.add(other)
                    out.append((name, other))
                    break
        return sorted(out)

    for n in (150, 3000):
        ours, theirs = files(n, "r"), files(n, "e")
        begin = time.time()
        frames = (spark.createDataFrame(x, "session string, name string, attributes map<string,string>") for x in (ours, theirs))
        got = sorted((r.recording, r.ephys) for r in manifest.match_ephys_partial(*frames).collect())
        assert time.time() - begin < 8 and (n > 150 or got == brute(ours, theirs))


def test_spectrogram_over_runs_and_gaps(spark):
    """Segments are the same whatever runs they are dealt to; one that lacks a sample has no rows."""
    from posegrid.operators import spectral

    v = np.random.default_rng(2).normal(size=400)
    frame = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v) if i != 200], "recording string, idx int, v double")
    got = {s: {(r.seg, r.freq): r.power for r in spectral.spectrogram(frame, 100.0, 64, samples=s).collect()} for s in (56, 112, 1 << 18)}
    window = spectral.tukey(64)
    want = {}
    for seg in range(7):
        part = v[seg * 56 : seg * 56 + 64]
        if len(part) == 64 and not seg * 56 <= 200 < seg * 56 + 64:
            want |= {(seg, k * 100.0 / 64): p for k, p in enumerate(np.abs(np.fft.rfft((part - part.mean()) * window)) / window.sum())}
    for found in got.values():
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
