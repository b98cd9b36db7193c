"""Cases with known answers, and random ones against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.functions import geometry as g
from posegrid.functions import measurements as m
from posegrid.operators import pose
from posegrid.sources import derived


def lit(*xyz):
    return tuple(F.lit(float(v)) for v in xyz)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_known_answers(spark):
    o, x, y, z = lit(0, 0, 0), lit(1, 0, 0), lit(0, 1, 0), lit(0, 0, 1)
    assert value(spark, g.tetra_volume(o, x, y, z)) == pytest.approx(1 / 6)
    assert value(spark, g.hull_volume(o, x, y, z, lit(0.1, 0.1, 0.1))) == pytest.approx(1 / 6)
    assert value(spark, g.hull_volume(o, x, y, lit(1, 1, 0), z)) == pytest.approx(1 / 3)
    assert value(spark, g.triangle_area(lit(3, 0, 0), lit(0, 4, 0), o)) == pytest.approx(6)
    assert value(spark, g.angle_at(o, lit(3, 0, 0), lit(0, 4, 0))) == pytest.approx(90)
    assert value(spark, g.ellipse_area((lit(-2, 0, 0), lit(2, 0, 0)), (lit(0, -1, 0), lit(0, 1, 0)))) == pytest.approx(2 * math.pi)
    assert [value(spark, c) for c in g.project_vector(x, o)] == [0, 0, 0]
    assert value(spark, g.angle(o, x)) is None
    assert value(spark, g.dist(o, tuple(F.lit(None).cast("double") for _ in range(3)))) is None
    with pytest.raises(ValueError):
        g.hull_volume(o, x, y, z, o, x)


def test_rotation_is_orthogonal():
    r = np.array(pose.rotation((0.3, -0.5, 0.9)))
    assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1)
    assert pose.rotation((0, 0, 0)) == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_triangulation_undoes_projection(spark):
    cameras = pose.cameras_df(
        spark,
        {
            n: {"matrix": [[500, 0, 300], [0, 500, 200], [0, 0, 1]], "rotation": [0.1 * i, 0.2 * i, 0], "translation": [i, 0, 50], "size": [600, 400]}
            for i, n in enumerate("abc")
        },
    )
    points = spark.createDataFrame([(1, 0, "p", 1.0, 2.0, 3.0), (1, 1, "p", -4.0, 0.5, 9.0)], "recording int, frame int, keypoint string, x double, y double, z double")
    seen = pose.project_points(points, cameras).drop("x", "y", "z").withColumn("score", F.when(F.col("camera") == "c", 0.1).otherwise(1.0))
    back = {r.frame: (r.x, r.y, r.z, r.ncams) for r in pose.triangulate(seen, cameras).collect()}
    assert back[0][:3] == pytest.approx((1, 2, 3)) and back[1][:3] == pytest.approx((-4, 0.5, 9)) and back[0][3] == 2


def test_measurement_exclusion_and_missing(spark):
    wide = derived.pose_wide(spark, "/root/testdata/sf0.001")
    assert len(m.measurements(wide).columns) == 19
    assert len(m.measurements(wide, exclude=("mouth-area-mm2",)).columns) == 18
    assert m.missing_keypoints(wide) == []
    assert m.missing_keypoints(wide.drop("lowerlip_x")) == ["lowerlip"]


def test_camera_code(spark):
    names = {"rec_TL_x": "TL", "cam-r": "R", "viewBC": "BC", "x_L_y": "L", "nothing9": None}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", pose.camera_code(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in rows} == names


def test_filter_pose2d_fills_outliers(spark):
    rows = [("a", "L", "k", i, float(i), 0.0, 0.1 if i == 5 else 1.0) for i in range(12)]
    rows[8] = ("a", "L", "k", 8, 500.0, 0.0, 1.0)
    df = spark.createDataFrame(rows, "recording string, view string, keypoint string, frame int, x double, y double, score double")
    got = {r.frame: r.x for r in pose.filter_pose2d(df, 5).collect()}
    assert got[5] == pytest.approx(5) and got[8] == pytest.approx(8)


def test_hull_of_many_points(spark):
    from posegrid.operators.hull import hull_volumes

    corners = [(x, y, z) for x in (0, 2) for y in (0, 1) for z in (0, 3)] + [(1, 0.5, 1)]
    names = [f"p{i}" for i in range(len(corners))]
    columns = ["recording int", "frame int", *(f"{n}_{a} double" for n in names for a in "xyz")]
    flat = [float(v) for c in corners for v in c]
    rows = [(1, 0, *flat), (1, 1, None, *flat[1:])]
    got = {r.frame: r.volume for r in hull_volumes(spark.createDataFrame(rows, ", ".join(columns)), names).collect()}
    assert got[0] == pytest.approx(6, rel=1e-6) and got[1] is None
    wide = derived.pose_wide(spark, "/root/testdata/sf0.001").limit(50)
    five = list(m.KEYPOINTS[7:12])
    both = hull_volumes(wide, five).join(wide.select("recording", "frame", g.hull_volume(*map(g.point, five)).alias("v")), ["recording", "frame"])
    assert all(r.volume == pytest.approx(r.v, rel=1e-5, abs=1e-6) for r in both.collect())
