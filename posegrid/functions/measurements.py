"""Measurements of a frame from its keypoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as g

# The keypoints in their order, and the groups of their edges.
KEYPOINTS = (
    "nose(bottom)", "nose(tip)", "nose(top)", "pad(top)(left)", "pad(side)(left)", "pad(top)(right)", "pad(side)(right)", "pad(center)", "lowerlip",
    "upperlip(left)", "upperlip(right)", "eye(front)(left)", "eye(top)(left)", "eye(back)(left)", "eye(bottom)(left)", "eye(front)(right)",
    "eye(top)(right)", "eye(back)(right)", "eye(bottom)(right)", "ear(base)(left)", "ear(top)(left)", "ear(tip)(left)", "ear(bottom)(left)",
    "ear(base)(right)", "ear(top)(right)", "ear(tip)(right)", "ear(bottom)(right)",
)
GROUPS = {
    "nose": ("nose(bottom)", "nose(tip)", "nose(top)"),
    "whiskers(left)": ("pad(top)(left)", "pad(side)(left)", "pad(center)"),
    "whiskers(right)": ("pad(top)(right)", "pad(side)(right)", "pad(center)"),
    "mouth": ("lowerlip", "upperlip(left)", "upperlip(right)"),
    "eye(left)": ("eye(front)(left)", "eye(top)(left)", "eye(back)(left)", "eye(bottom)(left)"),
    "eye(right)": ("eye(front)(right)", "eye(top)(right)", "eye(back)(right)", "eye(bottom)(right)"),
    "ear(left)": ("ear(base)(left)", "ear(top)(left)", "ear(tip)(left)", "ear(bottom)(left)"),
    "ear(right)": ("ear(base)(right)", "ear(top)(right)", "ear(tip)(right)", "ear(bottom)(right)"),
}

# The names of the measurements, of both sides and of one.
_SIDED = {
    "eye-height-{}-mm": lambda p: g.dist(p("eye(top)({})"), p("eye(bottom)({})")),
    "eye-width-{}-mm": lambda p: g.dist(p("eye(front)({})"), p("eye(back)({})")),
    "eye-area-{}-mm2": lambda p: g.ellipse_area((p("eye(front)({})"), p("eye(back)({})")), (p("eye(top)({})"), p("eye(bottom)({})"))),
    "ear-height-{}-mm": lambda p: g.dist(p("ear(tip)({})"), p("ear(base)({})")),
    "ear-width-{}-mm": lambda p: g.dist(p("ear(top)({})"), p("ear(bottom)({})")),
    "ear-angle-{}-deg": lambda p: g.angle_at(p("ear(base)({})"), p("ear(tip)({})"), p("pad(center)")),
    "ear-area-{}-mm2": lambda p: g.ellipse_area((p("ear(base)({})"), p("ear(tip)({})")), (p("ear(top)({})"), p("ear(bottom)({})"))),
}
_SINGLE = {
    "mouth-area-mm2": lambda p: g.triangle_area(p("upperlip(left)"), p("upperlip(right)"), p("lowerlip")),
    "nose-bulge-volume-mm3": lambda p: g.nose_bulge_volume(
        p("eye(front)(left)"), p("eye(front)(right)"), p("nose(top)"), p("pad(top)(left)"), p("pad(top)(right)")
    ),
    "cheek-bulge-volume-mm3": lambda p: g.hull_volume(
        *map(p, ("nose(bottom)", "pad(top)(left)", "pad(top)(right)", "pad(side)(left)", "pad(side)(right)"))
    ),
}


def expressions() -> dict[str, Column]:
    """The seventeen measurements by name."""
    out = {}
    for name, of in _SIDED.items():
        for side in ("left", "right"):
            out[name.format(side)] = of(lambda kp, side=side: g.point(kp.format(side)))
    return out | {name: of(g.point) for name, of in _SINGLE.items()}


def measurements(poses: DataFrame, keys: tuple[str, ...] = ("recording", "frame"), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Keys and a column per measurement: one projection over wide rows, no shuffle."""
    return poses.select(*keys, *(c.alias(n) for n, c in expressions().items() if n not in exclude))


def missing_keypoints(poses: DataFrame) -> list[str]:
    """Default keypoints that a wide table lacks, from its schema alone."""
    return [k for k in KEYPOINTS if f"{k}_x" not in poses.columns]


# Units and type of a measurement by the word in its name, the first that fits.
KINDS = (
    ("height", "mm", "distance"),
    ("width", "mm", "distance"),
    ("angle", "deg", "angle"),
    ("area", "mm^2", "area"),
    ("volume", "mm^3", "volume"),
)


def units_of(name: Column) -> Column:
    """Units of a measurement, null for an unknown one."""
    return F.coalesce(*(F.when(name.contains(word), units) for word, units, _ in KINDS))


def kind_of(name: Column) -> Column:
    return F.coalesce(*(F.when(name.contains(word), kind) for word, _, kind in KINDS), F.lit("unknown"))


def long(measured: DataFrame, keys: tuple[str, ...] = ("recording", "frame")) -> DataFrame:
    """One row per frame and measurement."""
    names = [c for c in measured.columns if c not in keys]
    return measured.unpivot(list(keys), [F.col(f"`{c}`").alias(c) for c in names], "measurement_name", "value")


def summary(measured_long: DataFrame, keys: tuple[str, ...] = ("recording",), series: bool = False) -> DataFrame:
    """Mean, population deviation and count per key and measurement, with units and type; on demand the series in frame order."""
    more = [F.array_sort(F.collect_list(F.struct("frame", "value")))["value"].alias("timeseries")] if series else []
    found = measured_long.groupBy(*keys, "measurement_name").agg(
        F.avg("value").alias("measurement_value"), F.stddev_pop("value").alias("std"), F.count("value").alias("count"), *more
    )
    name = F.col("measurement_name")
    return found.withColumns(
        {"measurement_group": F.split_part(name, F.lit("-"), F.lit(1)), "measurement_units": units_of(name), "measurement_type": kind_of(name)}
    )
