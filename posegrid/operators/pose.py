"""Operators on pose tables: frames of reference, projection, triangulation, segments, cleaning."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posegrid.functions import geometry as g

CAMERA_SCHEMA = "camera string, width int, height int, " + ", ".join(
    f"{n} double" for n in ("fx", "fy", "cx", "cy", *(f"r{i}{j}" for i in range(3) for j in range(3)), "t0", "t1", "t2", "k1", "k2", "p1", "p2", "k3")
)


def rotation(rvec: tuple[float, float, float]) -> list[list[float]]:
    """Matrix of a rotation vector (axis times angle)."""
    turn = math.sqrt(sum(x * x for x in rvec))
    if turn == 0:
        return [[float(i == j) for j in range(3)] for i in range(3)]
    x, y, z = (v / turn for v in rvec)
    c, s = math.cos(turn), math.sin(turn)
    v = 1 - c
    return [[c + x * x * v, x * y * v - z * s, x * z * v + y * s], [y * x * v + z * s, c + y * y * v, y * z * v - x * s], [z * x * v - y * s, z * y * v + x * s, c + z * z * v]]


def cameras_df(spark: SparkSession, cameras: dict[str, dict]) -> DataFrame:
    """A row per camera of a calibration: matrix, rotation, translation, distortions, size."""
    rows = []
    for name, c in cameras.items():
        m, r = c["matrix"], rotation(tuple(c["rotation"]))
        bent = [*c.get("distortions", []), 0.0, 0.0, 0.0, 0.0, 0.0][:5]
        rows.append((name, *c["size"], m[0][0], m[1][1], m[0][2], m[1][2], *(x for row in r for x in row), *c["translation"], *bent))
    return spark.createDataFrame([tuple(x if isinstance(x, (str, int)) and i < 3 else float(x) for i, x in enumerate(r)) for r in rows], CAMERA_SCHEMA)


def head_to_world(df: DataFrame, sign: int = 1) -> DataFrame:
    """x, y, z turned by the transposed matrix M_ij of the frame and shifted by center_k; as it is where they are absent."""
    if "M_00" not in df.columns:
        return df
    shifted = [F.col(a) + sign * F.col(f"center_{k}") for k, a in enumerate("xyz")]
    turned = {a: sum((F.col(f"M_{k}{i}") * shifted[k] for k in range(1, 3)), F.col(f"M_0{i}") * shifted[0]) for i, a in enumerate("xyz")}
    return df.withColumns(turned)


def _bent(a: Column, b: Column) -> tuple[Column, Column]:
    """A ray (a, b) after the camera's radial and tangential distortion."""
    c = F.col
    r2 = a * a + b * b
    radial = 1 + c("k1") * r2 + c("k2") * r2 * r2 + c("k3") * r2 * r2 * r2
    return a * radial + 2 * c("p1") * a * b + c("p2") * (r2 + 2 * a * a), b * radial + c("p1") * (r2 + 2 * b * b) + 2 * c("p2") * a * b


def _pixels(joined: DataFrame, video_size: tuple[int, int] | None = None) -> tuple[DataFrame, Column, Column]:
    """Rows of points with their cameras, rays added, and the pixel's u and v."""
    c = F.col
    scale_x = F.lit(video_size[0]) / c("width") if video_size else F.lit(1.0)
    scale_y = F.lit(video_size[1]) / c("height") if video_size else F.lit(1.0)
    seen = [c(f"r{i}0") * c("x") + c(f"r{i}1") * c("y") + c(f"r{i}2") * c("z") + c(f"t{i}") for i in range(3)]
    flat = joined.withColumns({"_a": F.try_divide(seen[0], seen[2]), "_b": F.try_divide(seen[1], seen[2])})
    u, v = _bent(c("_a"), c("_b"))
    return flat, c("fx") * scale_x * u + c("cx") * scale_x, c("fy") * scale_y * v + c("cy") * scale_y


def project_points(points: DataFrame, cameras: DataFrame, video_size: tuple[int, int] | None = None) -> DataFrame:
    """Pixel u, v of every point in every camera: pinhole with radial and tangential distortion.

    ``cameras`` is a calibration, a handful of rows whatever the recordings, and is broadcast.
    """
    flat, u, v = _pixels(points.join(F.broadcast(cameras)), video_size)
    return flat.select(*points.columns, "camera", u.alias("u"), v.alias("v"))


def with_straight_rays(df: DataFrame, steps: int = 50) -> DataFrame:
    """Rows of pixels with their cameras, and ``_a``, ``_b``: the ray of each pixel with the camera's distortion undone.

    A fixed point of: the bent ray less the tangential shift at the last guess, over the radial factor there; each batch is
    iterated until no ray moves by 1e-13. As column expressions, eight steps make a method too long for the JVM's compiler
    (7.0 s for 324 000 pixels); batches of arrays take 1 s.
    """
    import numpy as np

    def straight(a0: pd.Series, b0: pd.Series, k1: pd.Series, k2: pd.Series, p1: pd.Series, p2: pd.Series, k3: pd.Series) -> pd.DataFrame:
        a0, b0, k1, k2, p1, p2, k3 = (x.to_numpy(float) for x in (a0, b0, k1, k2, p1, p2, k3))
        a, b = a0, b0
        with np.errstate(all="ignore"):
            for _ in range(steps):
                r2 = a * a + b * b
                radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
                x = (a0 - 2 * p1 * a * b - p2 * (r2 + 2 * a * a)) / radial
                y = (b0 - p1 * (r2 + 2 * b * b) - 2 * p2 * a * b) / radial
                moved = np.nanmax(np.abs(x - a) + np.abs(y - b), initial=0.0)
                a, b = x, y
                if moved < 1e-13:
                    break
        found = np.isfinite(a) & np.isfinite(b)
        return pd.DataFrame({"a": np.where(found, a, np.nan), "b": np.where(found, b, np.nan)})

    c = F.col
    ray = F.pandas_udf(straight, "a double, b double")((c("u") - c("cx")) / c("fx"), (c("v") - c("cy")) / c("fy"), *map(c, ("k1", "k2", "p1", "p2", "k3")))
    return df.withColumn("_ray", ray).select(*(c(f"`{n}`") for n in df.columns), c("_ray.a").alias("_a"), c("_ray.b").alias("_b"))


def camera_code(name: Column) -> Column:
    """Two-letter code of a camera from a free-form name; the shorter one-letter codes where no longer one fits."""
    upper = F.upper(name)
    return F.coalesce(
        F.nullif(F.regexp_extract(upper, r"(?:^|[^A-Z])(TL|TR|TC|BC)(?:$|[^A-Z])", 1), F.lit("")),
        F.nullif(F.regexp_extract(upper, r"(?:^|[^A-Z])(L|R)(?:$|[^A-Z])", 1), F.lit("")),
        F.nullif(F.regexp_extract(upper, r"(TL|TR|TC|BC|L|R)$", 1), F.lit("")),
    )


def valid_points(df: DataFrame) -> DataFrame:
    """Points with all coordinates that are no reference posts."""
    there = F.lit(True)
    for a in "xyz":
        there = there & F.col(a).isNotNull() & ~F.isnan(a)
    return df.filter(there & ~F.col("keypoint").like("ref(%"))


def group_edges(groups: DataFrame) -> DataFrame:
    """Closed loop of edges (name, a, b) of each group's list ``keypoints``: each to the next, the last to the first."""
    size = F.size("keypoints")
    placed = groups.select("name", "keypoints", F.posexplode("keypoints").alias("i", "a"))
    return placed.select("name", F.col("i").alias("edge"), "a", F.get("keypoints", (F.col("i") + 1) % size).alias("b"))


def skeleton_segments(points: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("recording", "frame")) -> DataFrame:
    """Both ends of every edge whose points are present in the frame. ``edges`` is the skeleton, a few dozen rows."""
    named = lambda end: points.select(*keys, F.col("keypoint").alias(end), *(F.col(a).alias(f"{end}_{a}") for a in "xyz"))
    first = named("a").join(F.broadcast(edges.select("a", "b")), "a")
    return first.join(named("b"), [*keys, "b"])


def triangulate(points: DataFrame, cameras: DataFrame, score_threshold: float = 0.9, keys: tuple[str, ...] = ("recording", "frame", "keypoint")) -> DataFrame:
    """(keys, x, y, z, score, ncams, error): 3D points from pixels of two cameras or more, with score above the threshold.

    Pixels are undistorted first. Each view gives two linear equations in x, y, z. Their normal equations are sums over the
    views, so Spark adds nine numbers per point and solves the 3 by 3 system in the same projection. ``error`` is the mean
    distance in pixels of the views from the point's projections, distortion included; views are dealt by
    point once, for the sums and the errors.
    """
    c = F.col
    used = points.filter(c("score") >= score_threshold).select(*keys, "camera", "u", "v", "score").repartition(*keys)
    seen = with_straight_rays(used.join(F.broadcast(cameras), "camera"))
    a, b = c("_a"), c("_b")
    rows = []
    for ray, i in ((a, 0), (b, 1)):
        rows.append(([ray * c(f"r2{j}") - c(f"r{i}{j}") for j in range(3)], c(f"t{i}") - ray * c("t2")))
    sums = {f"n{i}{j}": sum((m[i] * m[j] for m, _ in rows[1:]), rows[0][0][i] * rows[0][0][j]) for i in range(3) for j in range(i, 3)}
    sums |= {f"h{i}": sum((m[i] * h for m, h in rows[1:]), rows[0][0][i] * rows[0][1]) for i in range(3)}
    total = seen.groupBy(*keys).agg(
        *(F.sum(e).alias(n) for n, e in sums.items()), F.count("*").alias("ncams"), F.avg("score").alias("score")
    ).filter("ncams >= 2")
    n = lambda i, j: c(f"n{min(i, j)}{max(i, j)}")

    def determinant(col: int | None) -> Column:
        m = [[c(f"h{i}") if j == col else n(i, j) for j in range(3)] for i in range(3)]
        return (
            m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
            - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
            + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
        )

    whole = determinant(None)
    solved = total.select(*keys, *(F.try_divide(determinant(k), whole).alias(a) for k, a in enumerate("xyz")), "score", "ncams")
    views, u, v = _pixels(used.drop("score").join(solved.select(*keys, *"xyz"), list(keys)).join(F.broadcast(cameras), "camera"))
    far = F.sqrt((c("u") - u) * (c("u") - u) + (c("v") - v) * (c("v") - v))
    errors = views.groupBy(*keys).agg(F.avg(far).alias("error"))
    return solved.join(errors, list(keys))


def reorient(poses: DataFrame, origin: str, z_axis: tuple[str, str], x_axis: tuple[str, str], keypoints, key: str = "recording") -> DataFrame:
    """Wide poses in anatomical axes, per recording from mean positions: z along one keypoint pair, x along another made square to it."""
    means = [F.avg(F.col(f"`{k}_{a}`")).alias(f"_{n}_{a}") for n, k in (("o", origin), ("z0", z_axis[0]), ("z1", z_axis[1]), ("x0", x_axis[0]), ("x1", x_axis[1])) for a in "xyz"]
    axes = poses.groupBy(key).agg(*means)
    at = lambda n: tuple(F.col(f"_{n}_{a}") for a in "xyz")
    unit = lambda v: tuple(F.try_divide(p, g.norm(v)) for p in v)
    z = unit(g.minus(at("z1"), at("z0")))
    axes = axes.withColumns({f"_ez_{a}": p for a, p in zip("xyz", z)})
    ez = at("ez")
    raw = g.minus(at("x1"), at("x0"))
    along = g.project_vector(raw, ez)
    axes = axes.withColumns({f"_ex_{a}": p for a, p in zip("xyz", unit(g.minus(raw, along)))})
    axes = axes.withColumns({f"_ey_{a}": p for a, p in zip("xyz", g.cross(at("ez"), at("ex")))})
    joined = poses.join(axes, key)
    out = []
    for k in keypoints:
        moved = g.minus(g.point(k), at("o"))
        out += [g.dot(moved, at(e)).alias(f"{k}_{a}") for a, e in zip("xyz", ("ex", "ey", "ez"))]
    return joined.select(key, *[c for c in ("frame",) if c in poses.columns], *out)


def filter_pose2d(points: DataFrame, medfilt: int = 13, offset: float = 5.0, score: float = 0.8, keys: tuple[str, ...] = ("recording", "view", "keypoint")) -> DataFrame:
    """Pixels with a low score, or far from the running median, are replaced by linear interpolation over frames."""
    from .series import interpolate

    half = medfilt // 2
    window = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-half, half)
    near = points.withColumns({f"_{a}": F.percentile(a, F.lit(0.5)).over(window) for a in "xy"})
    good = (F.col("score") >= score) & (F.abs(F.col("x") - F.col("_x")) <= offset) & (F.abs(F.col("y") - F.col("_y")) <= offset)
    kept = near.withColumns({a: F.when(good, F.col(a)) for a in "xy"}).drop("_x", "_y")
    for a in "xy":
        kept = interpolate(kept, a, keys, "frame")
    return kept
