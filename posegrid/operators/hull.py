"""Convex hull volumes of any number of points per row."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _volumes(points):
    """Volumes of the hulls of rows of n points (rows, n, 3), all rows at once.

    A triangle of points is a facet if all others lie on one side of it. Each facet with the centre makes
    a tetrahedron; a point on a facet's plane would make several triangles cover it, so points are moved
    apart by a billionth of their spread first. A row without volume comes to about zero.
    """
    import numpy as np

    rows, n, _ = points.shape
    spread = np.ptp(points, axis=1).max(axis=1)[:, None, None]
    moved = points + spread * 1e-9 * np.random.default_rng(0).standard_normal((1, n, 3))
    centre = moved.mean(axis=1)
    total = np.zeros(rows)
    for i, j, k in combinations(range(n), 3):
        a, b, c = moved[:, i], moved[:, j], moved[:, k]
        normal = np.cross(b - a, c - a)
        side = np.einsum("rd,rnd->rn", normal, moved - a[:, None])
        others = [x for x in range(n) if x not in (i, j, k)]
        facet = (side[:, others] > 0).all(axis=1) | (side[:, others] < 0).all(axis=1)
        total += np.where(facet, np.abs(np.einsum("rd,rd->r", normal, centre - a)) / 6, 0.0)
    return total


def hull_volumes(df: DataFrame, keypoints: list[str], keys=("recording", "frame")) -> DataFrame:
    """(keys, volume) of the hull of named keypoints of wide rows; null where a coordinate is missing. Four points at least."""
    if len(keypoints) < 4:
        raise ValueError("a hull needs four points")
    columns = [f"{k}_{a}" for k in keypoints for a in "xyz"]
    renamed = df.select(*keys, *(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            values = np.stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], axis=1)
            known = np.isfinite(values).all(axis=1)
            out = np.full(len(values), np.nan)
            if known.any():
                out[known] = _volumes(values[known].reshape(-1, len(keypoints), 3))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, mask=~known)], names=[*keys, "volume"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return renamed.mapInArrow(each, f"{kinds}, volume double")
