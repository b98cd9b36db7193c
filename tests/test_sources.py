import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.operators import annotations, manifest
from posegrid.sources import readers


def test_pose_csv(spark, tmp_path):
    (tmp_path / "rec a.csv").write_text("frame,k(1)_x,k(1)_y,k(1)_z,k(1)_score\n0,1,2,3,0.5\n1,4,5,6,\n")
    wide = readers.read_pose3d(spark, str(tmp_path), ["k(1)"], ("score",))
    assert wide.columns == ["recording", "frame", "k(1)_x", "k(1)_y", "k(1)_z", "k(1)_score"] and wide.count() == 2
    long = readers.read_pose3d(spark, str(tmp_path), ["k(1)"], ("score",), "long").orderBy("frame").collect()
    assert [tuple(r) for r in long] == [("rec a", 0, "k(1)", 1, 2, 3, 0.5), ("rec a", 1, "k(1)", 4, 5, 6, None)]
    assert readers.keypoints_of(["a_x", "a_y", "a_z", "b_x", "b_y", "frame"]) == ["a"]


def test_signal_text(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("10:00:00:5\t0\n10:00:01:25\t1.5\n")
    rows = readers.read_signal_tsv(spark, str(tmp_path)).orderBy("seconds").collect()
    assert [(r.recording, r.seconds, r.v) for r in rows] == [("s", 36000.5, 0), ("s", 36001.25, 1.5)]
    rate = readers.estimate_sample_rate(spark.createDataFrame([("s", 0.0), ("s", 0.5), ("s", 1.0)], "recording string, seconds double"), 5.0).first()
    assert rate.rate == 2


def test_features_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "features")
    readers.write_features(spark.createDataFrame([("a", 1)], "recording string, v int"), path)
    readers.write_features(spark.createDataFrame([("a", 2), ("b", 3)], "recording string, v int"), path)
    assert sorted((r.recording, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_alignment_round_trip(spark, tmp_path):
    path = str(tmp_path / "align")
    rows = [("r", "t1", 0.5, 1.0, 100.0, None, None), ("r", "t2", None, 1.0, 100.0, 0.0, 1.0)]
    readers.write_alignment(spark.createDataFrame(rows, readers.ALIGNMENT_SCHEMA), path)
    assert [tuple(r) for r in readers.read_alignment(spark, path).collect()] == [rows[0]]


def test_spikes(spark, tmp_path):
    np.save(tmp_path / "cluster12_x.npy", np.array([0.5, 1.5]))
    assert [tuple(r) for r in readers.read_spikes(spark, str(tmp_path)).orderBy("t").collect()] == [(12, 0.5), (12, 1.5)]


def raw_recording(folder, name, n, channels, first=100, rate=50.0, lost=0):
    values = np.arange(n * channels, dtype="<f4").reshape(n, channels)
    values.tofile(folder / f"{name}_data.xdat")
    np.arange(first, first + n - lost, dtype="<i8").tofile(folder / f"{name}_timestamp.xdat")
    status = {"samp_freq": rate, "timestamp_range": [first, first + n], "t_range": [first / rate, (first + n) / rate], "signals": {"total": channels}}
    (folder / f"{name}.xdat.json").write_text(json.dumps({"status": status}))
    return values


def test_raw_recordings(spark, tmp_path, monkeypatch):
    from posegrid.sources import xdat

    values = {"a": raw_recording(tmp_path, "a", 1003, 5), "b 1": raw_recording(tmp_path, "b 1", 64, 5, 0)}
    first = {"a": 100, "b 1": 0}
    want = sorted((k, c, first[k] + i, first[k] + i, (first[k] + i) / 50, float(v[i, c])) for k, v in values.items() for i in range(len(v)) for c in range(5))
    whole = xdat.read_xdat(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == want
    # Blocks of 100 samples: eleven parts of the first, the last of three samples.
    cut = spark.read.format("xdat").option("block", 100).load(f"file://{tmp_path}/a")
    assert cut.rdd.getNumPartitions() == 11 and sorted(map(tuple, cut.collect())) == [w for w in want if w[0] == "a"]
    some = xdat.read_xdat(spark, f"{tmp_path}/a", 2.5, 3.0, [4, 1])
    assert sorted(map(tuple, some.collect())) == [w for w in want if w[0] == "a" and 125 <= w[2] < 150 and w[1] in (1, 4)]
    assert xdat.read_xdat(spark, f"{tmp_path}/a", 3.0, 3.0).count() == 0


def test_raw_recordings_filters_narrow_the_read(spark, tmp_path):
    from posegrid.sources import xdat

    raw_recording(tmp_path, "a", 1000, 3)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = xdat.read_xdat(spark, str(tmp_path)).filter("sample >= 300 and sample < 310 and channel = 2")
        assert [(r.channel, r.sample) for r in rows.orderBy("sample").collect()] == [(2, s) for s in range(300, 310)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    reader = xdat.PushedXdatReader({"path": str(tmp_path)})
    asked = [GreaterThanOrEqual(("sample",), 300), LessThan(("sample",), 310), EqualTo(("channel",), 2)]
    assert list(reader.pushFilters(asked)) == asked
    (part,) = reader.partitions()
    assert (part.low, part.high, reader.channels) == (200, 211, [2])


def test_raw_recordings_that_are_wrong_raise(spark, tmp_path):
    from posegrid.sources import xdat

    raw_recording(tmp_path, "a", 100, 2)
    raw_recording(tmp_path, "short", 100, 2, lost=-5)
    for start, end, said in ((1.0, 3.0, "before"), (2.0, 9.0, "after")):
        with pytest.raises(Exception, match=said):
            xdat.read_xdat(spark, f"{tmp_path}/a", start, end).collect()
    with pytest.raises(Exception, match="no channels"):
        xdat.read_xdat(spark, f"{tmp_path}/a", channels=[2]).collect()
    with pytest.raises(Exception, match="metadata"):
        xdat.read_xdat(spark, f"{tmp_path}/none").collect()
    with pytest.raises(Exception, match="100 samples of signals, 105 time stamps"):
        xdat.read_xdat(spark, f"{tmp_path}/short", 2.0, 4.06).collect()


def test_raw_recordings_round_trip(spark, tmp_path):
    from posegrid.sources import xdat

    rows = [(k, i, 7 + i, [float(i), None if i == 2 else -float(i)]) for k in "xyz" for i in range(3, 40)]
    xdat.write_xdat(spark.createDataFrame(rows, "recording string, sample long, timestamp long, v array<float>"), f"file://{tmp_path}/raw", 10.0, 2)
    got = {(r.recording, r.channel, r.sample): (r.timestamp, r.v) for r in xdat.read_xdat(spark, f"{tmp_path}/raw").collect()}
    assert got == {(k, c, i): (7 + i, v[c]) for k, i, _, v in rows for c in (0, 1)}
    with pytest.raises(Exception, match="does not follow"):
        xdat.write_xdat(spark.createDataFrame([("q", 0, 0, [1.0]), ("q", 2, 2, [1.0])], "recording string, sample long, timestamp long, v array<float>"), f"file://{tmp_path}/bad", 10.0, 1)


def test_cache_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert readers.cache_table(spark.range(3), path).count() == 3
    assert readers.cache_table(spark.range(9), path).count() == 3


def test_calibration_text():
    text = json.dumps({"cam_0": {"name": "TL", "matrix": [[1, 0, 0], [0, 1, 0], [0, 0, 1]]}, "metadata": {"error": 1}})
    assert list(readers.read_calibration(text)) == ["TL"]


def test_regex_of_a_specification(spark):
    spec = {"_path_": "(x)?{{name}}_{{view}}", "name": "[a-z]+", "view": "L|R"}
    pattern = manifest.build_regex(spec)
    files = spark.createDataFrame([("xab_L.avi",), ("9",)], "path string")
    assert [(r.name, r.view) for r in manifest.parse_paths(files, pattern).collect()] == [("ab", "L")]
    with pytest.raises(ValueError):
        manifest.build_regex({"_path_": "x"})


def test_nested_annotations_keep_the_first(spark):
    rows = [("f", "k", 2.0, 1.0), ("f", "k", 1.0, 9.0), ("g", "k", None, None)]
    nested = annotations.annotations_nested(spark.createDataFrame(rows, "filename string, keypoint string, x double, y double"))
    got = {r.filename: (r.x, r.y) for r in annotations.annotations_long(nested).collect()}
    assert got == {"f": (1.0, 9.0), "g": (None, None)}


def test_entry_without_the_optional_part(spark, monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(entry, "find_spec", lambda name: None if name in ("posegrid.llm", "corpus_pipeline") else real(name))
    assert "g16_measurements" in entry.queries() and not any(n.startswith("op1") for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).filter(F.col("count") > 0).count() == 170
