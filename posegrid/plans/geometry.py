"""Queries on poses and their SQL twins. Doubles are rounded on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from posegrid.functions import geometry as g
from posegrid.functions import measurements as m
from posegrid.operators import pose
from posegrid.sources import derived

# ---- SQL side: points as triples of expressions over the embedding e of a frame

FRAMES = "f AS (SELECT label AS recording, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame, embedding AS e FROM embeddings)"
LONG = FRAMES + """, pose AS (SELECT recording, frame, kp, 100 * CAST(e[(3 * kp) % 64 + 1] AS DOUBLE) AS x, 100 * CAST(e[(3 * kp + 1) % 64 + 1] AS DOUBLE) AS y,
  100 * CAST(e[(3 * kp + 2) % 64 + 1] AS DOUBLE) AS z FROM f, (SELECT CAST(unnest(range(27)) AS INTEGER) AS kp))"""


def _p(name):
    k = m.KEYPOINTS.index(name)
    return tuple(f"(100 * CAST(e[{(3 * k + i) % 64 + 1}] AS DOUBLE))" for i in range(3))


def _minus(a, b):
    return tuple(f"({p} - {q})" for p, q in zip(a, b))


def _mid(a, b):
    return tuple(f"(({p} + {q}) / 2)" for p, q in zip(a, b))


def _dot(a, b):
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b)) + ")"


def _cross(a, b):
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def _norm(a):
    return f"sqrt({_dot(a, a)})"


def _dist(a, b):
    return _norm(_minus(a, b))


def _angle(corner, a, b):
    u, v = _minus(a, corner), _minus(b, corner)
    return f"degrees(acos(greatest(-1, least(1, {_dot(u, v)} / nullif({_norm(u)} * {_norm(v)}, 0)))))"


def _area(a, b, c):
    return f"({_norm(_cross(_minus(a, c), _minus(b, c)))} / 2)"


def _tetra(a, b, c, d):
    return f"(abs({_dot(_minus(a, d), _cross(_minus(b, d), _minus(c, d)))}) / 6)"


def _hull5(*ps):
    return "((" + " + ".join(_tetra(*(p for j, p in enumerate(ps) if j != i)) for i in range(5)) + ") / 2)"


def _ellipse(a, b, c, d):
    mid = _mid(a, b)
    return f"(pi() / 4 * {_dist(b, a)} * ({_dist(d, mid)} + {_dist(c, mid)}))"


def _sql_measurements():
    out = {}
    for s in ("left", "right"):
        eye = [_p(f"eye({x})({s})") for x in ("front", "back", "top", "bottom")]
        ear = [_p(f"ear({x})({s})") for x in ("base", "tip", "top", "bottom")]
        out |= {
            f"eye-height-{s}-mm": _dist(eye[2], eye[3]),
            f"eye-width-{s}-mm": _dist(eye[0], eye[1]),
            f"eye-area-{s}-mm2": _ellipse(*eye),
            f"ear-height-{s}-mm": _dist(ear[1], ear[0]),
            f"ear-width-{s}-mm": _dist(ear[2], ear[3]),
            f"ear-angle-{s}-deg": _angle(ear[0], ear[1], _p("pad(center)")),
            f"ear-area-{s}-mm2": _ellipse(*ear),
        }
    out["mouth-area-mm2"] = _area(_p("upperlip(left)"), _p("upperlip(right)"), _p("lowerlip"))
    out["nose-bulge-volume-mm3"] = _tetra(_mid(_p("eye(front)(left)"), _p("eye(front)(right)")), _p("nose(top)"), _p("pad(top)(left)"), _p("pad(top)(right)"))
    out["cheek-bulge-volume-mm3"] = _hull5(*map(_p, ("nose(bottom)", "pad(top)(left)", "pad(top)(right)", "pad(side)(left)", "pad(side)(right)")))
    return out


SQL_MEASUREMENTS = _sql_measurements()
SQL_LONG = FRAMES + ", w AS (SELECT recording, frame, " + ", ".join(f'{e} AS "{n}"' for n, e in SQL_MEASUREMENTS.items()) + """ FROM f),
 ml AS (UNPIVOT w ON COLUMNS(* EXCLUDE (recording, frame)) INTO NAME measurement_name VALUE value)"""


def _rounded(columns):
    return [F.round(c, 4).alias(n) for n, c in columns.items()]


def _query(columns, sql):
    """A projection of wide poses, and the same in SQL."""

    def run(spark, sf_dir):
        return derived.pose_wide(spark, sf_dir).select("recording", "frame", *_rounded(columns()))

    return run, f"WITH {FRAMES} SELECT recording, frame, " + ", ".join(f"round({e}, 4) AS {n}" for n, e in sql.items()) + " FROM f"


_EYE = ("eye(front)(left)", "eye(back)(left)", "eye(top)(left)", "eye(bottom)(left)")


def _sql_project(a, b):
    share = f"(CASE WHEN {_dot(b, b)} > 0 THEN {_dot(a, b)} / {_dot(b, b)} ELSE 0 END)"
    return tuple(f"({share} * {x})" for x in b)


def _sql_proptosis():
    front, back, top, bottom = map(_p, _EYE)
    along = _sql_project(back, _cross(_minus(bottom, back), _minus(top, back)))
    return _dot(along, along)


_NOSE = ("nose(tip)", "nose(top)", "nose(bottom)")

PROJECTIONS = {
    "g01_distance": (lambda: {"d": g.dist(g.point("nose(tip)"), g.point("pad(center)"))}, {"d": _dist(_p("nose(tip)"), _p("pad(center)"))}),
    "g02_project_vector": (
        lambda: dict(zip(("px", "py", "pz"), g.project_vector(g.point("nose(tip)"), g.point("lowerlip")))),
        dict(zip(("px", "py", "pz"), _sql_project(_p("nose(tip)"), _p("lowerlip")))),
    ),
    "g03_normal": (
        lambda: dict(zip(("nx", "ny", "nz"), g.normal(*map(g.point, _NOSE)))),
        dict(zip(("nx", "ny", "nz"), _cross(_minus(_p(_NOSE[0]), _p(_NOSE[2])), _minus(_p(_NOSE[1]), _p(_NOSE[2]))))),
    ),
    "g04_angle": (
        lambda: {"a": g.angle(g.point("nose(tip)"), g.point("lowerlip"))},
        {"a": _angle(("0", "0", "0"), _p("nose(tip)"), _p("lowerlip"))},
    ),
    "g05_triangle_area": (lambda: {"a": g.triangle_area(*map(g.point, _NOSE))}, {"a": _area(*map(_p, _NOSE))}),
    "g06_tetra_volume": (lambda: {"v": g.tetra_volume(*map(g.point, _EYE))}, {"v": _tetra(*map(_p, _EYE))}),
    "g07_hull_volume": (lambda: {"v": g.hull_volume(*map(g.point, m.KEYPOINTS[7:12]))}, {"v": _hull5(*map(_p, m.KEYPOINTS[7:12]))}),
    "g08_ellipse_area": (lambda: {"a": g.ellipse_area(tuple(map(g.point, _EYE[:2])), tuple(map(g.point, _EYE[2:])))}, {"a": _ellipse(*map(_p, _EYE))}),
    "g09_mouth": (
        lambda: {
            "side_left": g.dist(g.point("upperlip(left)"), g.point("lowerlip")),
            "side_right": g.dist(g.point("upperlip(right)"), g.point("lowerlip")),
            "area": g.triangle_area(g.point("upperlip(left)"), g.point("upperlip(right)"), g.point("lowerlip")),
        },
        {
            "side_left": _dist(_p("upperlip(left)"), _p("lowerlip")),
            "side_right": _dist(_p("upperlip(right)"), _p("lowerlip")),
            "area": _area(_p("upperlip(left)"), _p("upperlip(right)"), _p("lowerlip")),
        },
    ),
    "g10_eye": (
        lambda: {"h": m.expressions()["eye-height-left-mm"], "w": m.expressions()["eye-width-left-mm"], "a": m.expressions()["eye-area-left-mm2"]},
        {"h": SQL_MEASUREMENTS["eye-height-left-mm"], "w": SQL_MEASUREMENTS["eye-width-left-mm"], "a": SQL_MEASUREMENTS["eye-area-left-mm2"]},
    ),
    "g11_proptosis": (lambda: {"p": g.proptosis(*map(g.point, _EYE))}, {"p": _sql_proptosis()}),
    "g12_nose": (
        lambda: {
            "height": g.dist(g.point("nose(top)"), g.point("nose(bottom)")),
            "angle": g.angle_at(*map(g.point, _NOSE)),
            "bulge": m.expressions()["nose-bulge-volume-mm3"],
        },
        {"height": _dist(_p("nose(top)"), _p("nose(bottom)")), "angle": _angle(*map(_p, _NOSE)), "bulge": SQL_MEASUREMENTS["nose-bulge-volume-mm3"]},
    ),
    "g13_pad_angle": (
        lambda: {"a": g.angle_at(g.point("pad(center)"), g.point("pad(top)(left)"), g.point("pad(side)(left)"))},
        {"a": _angle(_p("pad(center)"), _p("pad(top)(left)"), _p("pad(side)(left)"))},
    ),
    "g14_cheek_bulge": (lambda: {"v": m.expressions()["cheek-bulge-volume-mm3"]}, {"v": SQL_MEASUREMENTS["cheek-bulge-volume-mm3"]}),
    "g15_ear": (
        lambda: {k: m.expressions()[f"ear-{k}-right-{u}"] for k, u in (("height", "mm"), ("width", "mm"), ("angle", "deg"), ("area", "mm2"))},
        {k: SQL_MEASUREMENTS[f"ear-{k}-right-{u}"] for k, u in (("height", "mm"), ("width", "mm"), ("angle", "deg"), ("area", "mm2"))},
    ),
}


def g16_measurements(spark, sf_dir):
    wide = m.measurements(derived.pose_wide(spark, sf_dir))
    return wide.select("recording", "frame", *(F.round(f"`{c}`", 4).alias(c) for c in wide.columns[2:]))


G16 = f"WITH {FRAMES} SELECT recording, frame, " + ", ".join(f'round({e}, 4) AS "{n}"' for n, e in SQL_MEASUREMENTS.items()) + " FROM f"


def g17_measurement_summary(spark, sf_dir):
    found = m.summary(m.long(m.measurements(derived.pose_wide(spark, sf_dir))))
    return found.select(
        "recording", "measurement_group", "measurement_name", "measurement_units", "measurement_type", F.round("measurement_value", 4).alias("measurement_value"),
        F.round("std", 4).alias("std"), "count",
    ).orderBy("recording", "measurement_name")


G17 = f"""WITH {SQL_LONG}
SELECT recording, split_part(measurement_name, '-', 1) AS measurement_group, measurement_name,
  CASE split_part(measurement_name, '-', -1) WHEN 'mm2' THEN 'mm^2' WHEN 'mm3' THEN 'mm^3' ELSE split_part(measurement_name, '-', -1) END AS measurement_units,
  CASE split_part(measurement_name, '-', -1) WHEN 'mm' THEN 'distance' WHEN 'deg' THEN 'angle' WHEN 'mm2' THEN 'area' ELSE 'volume' END AS measurement_type,
  round(avg(value), 4) AS measurement_value, round(stddev_pop(value), 4) AS std, count(*) AS count
FROM ml GROUP BY recording, measurement_name"""


def g18_missing_keypoints(spark, sf_dir):
    """Per recording, the configured keypoints of which every second is tracked that have no row."""
    poses = derived.pose_long(spark, sf_dir)
    tracked = poses.filter(F.col("kp") % 2 == F.col("recording") % 2).select("recording", "keypoint").distinct()
    default = poses.select("recording", "keypoint").distinct()
    return default.join(tracked, ["recording", "keypoint"], "left_anti")


def _names(kp):
    return f"list_extract({list(m.KEYPOINTS)!r}, {kp} + 1)"


G18 = f"WITH {LONG} SELECT DISTINCT recording, {_names('kp')} AS keypoint FROM pose WHERE kp % 2 <> recording % 2"

_TURN = pose.rotation((0.1, -0.2, 0.3))


def g19_head_to_world(spark, sf_dir):
    frame = F.col("frame").cast("double")
    rows = derived.pose_long(spark, sf_dir).withColumns({f"M_{i}{j}": F.lit(_TURN[i][j]) for i in range(3) for j in range(3)})
    rows = rows.withColumns({f"center_{k}": frame / (k + 2) for k in range(3)})
    plus = pose.head_to_world(rows)
    return plus.select("recording", "frame", "kp", *(F.round(a, 4).alias(a) for a in "xyz"))


G19 = f"WITH {LONG}, s AS (SELECT recording, frame, kp, x + frame / 2 AS x, y + frame / 3 AS y, z + frame / 4 AS z FROM pose) SELECT recording, frame, kp, " + ", ".join(
    f"round({_TURN[0][i]!r} * x + {_TURN[1][i]!r} * y + {_TURN[2][i]!r} * z, 4) AS {a}" for i, a in enumerate("xyz")
) + " FROM s"

CAMERAS = {
    name: {
        "matrix": [[800.0 + 10 * i, 0, 640.0], [0, 790.0 + 10 * i, 512.0], [0, 0, 1]],
        "rotation": [0.05 * i, -0.04 * i, 0.02 * i],
        "translation": [1.0 * i, -2.0 * i, 1000.0 + 5 * i],
        "distortions": [0.01 * i, -0.002 * i, 0.0005 * i, -0.0004 * i, 0.0001 * i],
        "size": [1280, 1024],
    }
    for i, name in enumerate(("TL", "TR", "L", "R", "TC", "BC"))
}


def g20_project_points(spark, sf_dir):
    points = pose.valid_points(derived.pose_long(spark, sf_dir))
    seen = pose.project_points(points, pose.cameras_df(spark, CAMERAS), (640, 512))
    return seen.select("recording", "frame", "kp", "camera", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


def _camera_rows():
    rows = []
    for name, c in CAMERAS.items():
        r = pose.rotation(tuple(c["rotation"]))
        mat = c["matrix"]
        rows.append("('" + name + "', " + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in (mat[0][0], mat[1][1], mat[0][2], mat[1][2], *sum(r, []), *c["translation"], *c["distortions"])) + ")")
    names = "camera, fx, fy, cx, cy, r00, r01, r02, r10, r11, r12, r20, r21, r22, t0, t1, t2, k1, k2, p1, p2, k3"
    return f"c({names}) AS (VALUES {', '.join(rows)})"


G20 = f"""WITH {LONG}, {_camera_rows()},
s AS (SELECT *, r00 * x + r01 * y + r02 * z + t0 AS sx, r10 * x + r11 * y + r12 * z + t1 AS sy, r20 * x + r21 * y + r22 * z + t2 AS sz FROM pose, c),
n AS (SELECT *, sx / sz AS a, sy / sz AS b FROM s), q AS (SELECT *, a * a + b * b AS r2 FROM n),
d AS (SELECT *, 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2 AS rad FROM q)
SELECT recording, frame, kp, camera, round(fx * 0.5 * (a * rad + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)) + cx * 0.5, 4) AS u,
  round(fy * 0.5 * (b * rad + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b) + cy * 0.5, 4) AS v FROM d"""


def g21_camera_code(spark, sf_dir):
    named = derived.files(spark, sf_dir)
    return named.groupBy(pose.camera_code(F.col("path")).alias("code")).agg(F.count("*").alias("files"))


G21 = "SELECT list_extract(['TL', 'TR', 'L', 'R', 'TC', 'BC'], CAST(o_orderkey % 6 AS INTEGER) + 1) AS code, count(*) AS files FROM orders GROUP BY 1"


def g22_valid_points(spark, sf_dir):
    rows = derived.pose_long(spark, sf_dir)
    broken = rows.withColumn("x", F.when(F.col("kp") == 3, F.lit(float("nan"))).when(F.col("kp") == 5, None).otherwise(F.col("x")))
    named = broken.withColumn("keypoint", F.when(F.col("kp") == 7, "ref(head-post)").otherwise(F.col("keypoint")))
    return pose.valid_points(named).select("recording", "frame", "kp", F.round("x", 4).alias("x"))


G22 = f"WITH {LONG} SELECT recording, frame, kp, round(x, 4) AS x FROM pose WHERE kp NOT IN (3, 5, 7)"


def _groups(spark):
    return spark.createDataFrame(list(m.GROUPS.items()), "name string, keypoints array<string>")


def g23_skeleton_segments(spark, sf_dir):
    points = derived.pose_long(spark, sf_dir).filter((F.col("frame") + F.col("kp")) % 5 > 0)
    segments = pose.skeleton_segments(points, pose.group_edges(_groups(spark)))
    return segments.select("recording", "frame", "a", "b", F.round("a_x", 4).alias("a_x"), F.round("b_z", 4).alias("b_z"))


def _edge_rows():
    place = {k: i for i, k in enumerate(m.KEYPOINTS)}
    rows = [(n, i, a, ks[(i + 1) % len(ks)]) for n, ks in m.GROUPS.items() for i, a in enumerate(ks)]
    values = ", ".join(f"('{n}', {i}, '{a}', '{b}', {place.get(a, -1)}, {place.get(b, -1)})" for n, i, a, b in rows)
    return f"edges(name, edge, a, b, ka, kb) AS (VALUES {values})"


G23 = f"""WITH {LONG}, {_edge_rows()}, p AS MATERIALIZED (SELECT recording, frame, kp, x, z FROM pose WHERE (frame + kp) % 5 > 0), u AS (SELECT p.*, a, b, kb FROM p JOIN edges ON kp = ka)
SELECT u.recording, u.frame, a, b, round(u.x, 4) AS a_x, round(v.z, 4) AS b_z FROM u JOIN p v ON v.kp = kb AND v.recording = u.recording AND v.frame = u.frame"""


def g24_group_edges(spark, sf_dir):
    """Edges of the groups whose keypoints are tracked, with the frames that have both ends."""
    edges = pose.group_edges(_groups(spark))
    segments = pose.skeleton_segments(derived.pose_long(spark, sf_dir), edges)
    return segments.groupBy("a", "b").agg(F.count("*").alias("frames"))


G24 = f"""WITH {LONG}, {_edge_rows()}, p AS (SELECT *, {_names('kp')} AS keypoint FROM pose)
SELECT a, b, count(*) AS frames FROM edges JOIN p u ON u.keypoint = a JOIN p v ON v.keypoint = b AND v.recording = u.recording AND v.frame = u.frame GROUP BY a, b"""


def g25_triangulate(spark, sf_dir):
    """Points that were projected into six cameras, distortion included, come back from their pixels."""
    cameras = pose.cameras_df(spark, CAMERAS)
    points = derived.pose_long(spark, sf_dir).select("recording", "frame", "kp", "x", "y", "z")
    seen = pose.project_points(points, cameras).drop("x", "y", "z")
    weak = (F.col("frame") + F.col("kp") + F.length("camera")) % 3 == 0
    scored = seen.withColumn("score", F.when(weak, 0.5).otherwise(0.95))
    found = pose.triangulate(scored, cameras, 0.9, ("recording", "frame", "kp"))
    return found.select("recording", "frame", "kp", *(F.round(a, 3).alias(a) for a in "xyz"), "ncams", F.round("error", 3).alias("error"))


G25 = f"""WITH {LONG}, n AS (SELECT *, (CASE WHEN (frame + kp + 2) % 3 = 0 THEN 0 ELSE 4 END) + (CASE WHEN (frame + kp + 1) % 3 = 0 THEN 0 ELSE 2 END) AS ncams FROM pose)
SELECT recording, frame, kp, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, CAST(ncams AS BIGINT) AS ncams, 0.0::DOUBLE AS error FROM n WHERE ncams >= 2"""


def g26_reorient(spark, sf_dir):
    wide = derived.pose_wide(spark, sf_dir)
    turned = pose.reorient(wide, "nose(tip)", ("lowerlip", "nose(top)"), ("nose(bottom)", "pad(center)"), ("nose(top)", "eye(top)(left)"))
    return turned.select("recording", "frame", *(F.round(f"`{c}`", 3).alias(n) for c, n in zip(turned.columns[2:], ("ax", "ay", "az", "bx", "by", "bz"))))


def _g26():
    means = ", ".join(
        f"avg({_p(k)[i]}) AS {n}{a}" for n, k in (("o", "nose(tip)"), ("z0", "lowerlip"), ("z1", "nose(top)"), ("x0", "nose(bottom)"), ("x1", "pad(center)")) for i, a in enumerate("xyz")
    )
    at = lambda n: tuple(f"{n}{a}" for a in "xyz")
    z, r = _minus(at("z1"), at("z0")), _minus(at("x1"), at("x0"))
    ez, ex = at("ez"), at("ex")
    rest = _minus(at("r"), tuple(f"({_dot(at('r'), ez)} * {c})" for c in ez))
    out = []
    for n, k in (("a", "nose(top)"), ("b", "eye(top)(left)")):
        moved = _minus(_p(k), at("o"))
        out += [f"round({_dot(moved, axis)}, 3) AS {n}{a}" for a, axis in zip("xyz", (ex, at("ey"), ez))]
    return f"""WITH {FRAMES}, m AS (SELECT recording AS rec, {means} FROM f GROUP BY recording),
    a1 AS (SELECT *, {", ".join(f"{c} / {_norm(z)} AS ez{a}" for a, c in zip("xyz", z))}, {", ".join(f"{c} AS r{a}" for a, c in zip("xyz", r))} FROM m),
    a2 AS (SELECT *, {", ".join(f"{c} / {_norm(rest)} AS ex{a}" for a, c in zip("xyz", rest))} FROM a1),
    a3 AS (SELECT *, {", ".join(f"{c} AS ey{a}" for a, c in zip("xyz", _cross(ez, ex)))} FROM a2)
    SELECT recording, frame, {", ".join(out)} FROM f JOIN a3 ON rec = recording"""


def g07_hull_many(spark, sf_dir):
    """Hulls of the nine keypoints of snout and mouth, beyond what an expression can say."""
    from posegrid.operators.hull import hull_volumes

    found = hull_volumes(derived.pose_wide(spark, sf_dir), list(m.KEYPOINTS[:9]))
    return found.select("recording", "frame", F.round("volume", 2).alias("volume"))


QUERIES, ORACLES = {"g07_hull_many": g07_hull_many}, {}
for _name, (_columns, _sql) in PROJECTIONS.items():
    QUERIES[_name], ORACLES[_name] = _query(_columns, _sql)
for _run, _sql in (
    (g16_measurements, G16), (g17_measurement_summary, G17), (g18_missing_keypoints, G18), (g19_head_to_world, G19), (g20_project_points, G20),
    (g21_camera_code, G21), (g22_valid_points, G22), (g23_skeleton_segments, G23), (g24_group_edges, G24), (g25_triangulate, G25), (g26_reorient, _g26()),
):
    QUERIES[_run.__name__], ORACLES[_run.__name__] = _run, _sql
