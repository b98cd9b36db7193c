"""Recursive filters in parallel, by a scan of affine state maps.

A cascade of second-order sections is linear: over a chunk of n samples the state goes from z to A^n z + u, where
u is the end state of a start from rest. So chunks are filtered from rest side by side, the maps are composed over
the chunks of a signal (a few numbers a chunk), and a last pass adds each chunk's response to its start state. The
result is that of the plain recursion up to rounding, without a guessed overlap. Inside a chunk the same is done once more: blocks of
``BLOCK`` samples by one matrix product, their states by a short recursion.

A signal's samples follow each other in the order of ``idx``, gaps in the index do not matter. From the first missing or
infinite sample on the recursion has no value, and the result is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.sources.scratch import settled

#: Samples of a chunk (a task's unit) and of a block (a matrix product).
CHUNK, BLOCK = 1 << 16, 64

Sections = tuple[tuple[float, ...], ...]


@lru_cache(maxsize=64)
def _system(sections: Sections) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(A, B, C, D) of the cascade: z' = A z + B x, y = C z + D x; two states a section."""
    m = 2 * len(sections)
    # What enters a section, as a combination of the states before it and the sample.
    a, b = np.zeros((m, m)), np.zeros(m)
    enters, direct = np.zeros(m), 1.0
    for i, (b0, b1, b2, a0, a1, a2) in enumerate(sections):
        b0, b1, b2, a1, a2 = b0 / a0, b1 / a0, b2 / a0, a1 / a0, a2 / a0
        leaves, through = b0 * enters, b0 * direct
        leaves[2 * i] += 1.0
        a[2 * i], b[2 * i] = b1 * enters - a1 * leaves, b1 * direct - a1 * through
        a[2 * i, 2 * i + 1] += 1.0
        a[2 * i + 1], b[2 * i + 1] = b2 * enters - a2 * leaves, b2 * direct - a2 * through
        enters, direct = leaves, through
    return a, b, enters, direct


@lru_cache(maxsize=256)
def _block(sections: Sections, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(H, O, U, P) of n samples: y = H x + O z, end state = U x + P z."""
    a, b, c, d = _system(sections)
    powers = [np.eye(len(b))]
    for _ in range(n):
        powers.append(a @ powers[-1])
    impulse = np.array([d] + [c @ powers[k] @ b for k in range(n - 1)])
    lags = np.subtract.outer(np.arange(n), np.arange(n))
    h = np.where(lags >= 0, impulse[np.maximum(lags, 0)], 0.0)
    return h, np.array([c @ powers[k] for k in range(n)]), np.array([powers[n - 1 - k] @ b for k in range(n)]).T, powers[n]


def run(sections: Sections, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filtered samples and the end state, from a start state."""
    whole = len(x) // BLOCK
    out = np.empty(len(x))
    if whole:
        h, o, u, p = _block(sections, BLOCK)
        blocks = x[: whole * BLOCK].reshape(whole, BLOCK)
        drive, starts = blocks @ u.T, np.empty((whole, len(z)))
        for k in range(whole):
            starts[k] = z
            z = p @ z + drive[k]
        out[: whole * BLOCK] = (blocks @ h.T + starts @ o.T).ravel()
    if len(x) % BLOCK:
        h, o, u, p = _block(sections, len(x) % BLOCK)
        rest = x[whole * BLOCK :]
        out[whole * BLOCK :] = h @ rest + o @ z
        z = u @ rest + p @ z
    return out, z


def _rows(values) -> Sections:
    return tuple(tuple(map(float, s)) for s in values)


def sos_filter(df: DataFrame, sections: list[list[float]], key: str = "recording", chunk: int = CHUNK) -> DataFrame:
    """(key, idx, v): second-order sections (b0, b1, b2, a0, a1, a2), one after the other, over each signal (idx, v)."""
    fixed = _rows(sections)
    m = 2 * len(fixed)
    kind = df.schema[key].dataType.simpleString()

    def at_rest(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("idx").to_numpy(), kind="stable")
        x = table.column("v").to_numpy()[order].astype(float)
        bad = ~np.isfinite(x)
        sound = int(bad.argmax()) if bad.any() else len(x)
        y, end = run(fixed, np.where(bad, 0.0, x), np.zeros(m))
        row = {
            key: table.column(key)[0].as_py(), "chunk": table.column("chunk")[0].as_py(), "sound": sound, "n": len(x),
            "at": table.column("idx").to_numpy()[order].astype("<i8").tobytes(), "y": y.astype("<f8").tobytes(), "state": end.tolist(),
        }
        return pa.Table.from_pylist([row], packed)

    packed = pa.schema(
        [(key, df.select(key).limit(0).toArrow().schema.field(0).type), ("chunk", pa.int64()), ("sound", pa.int64()), ("n", pa.int64()), ("at", pa.binary()), ("y", pa.binary()), ("state", pa.list_(pa.float64()))]
    )
    rows = df.select(key, F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v")).withColumn("chunk", F.floor(F.col("idx") / chunk).cast("long"))
    resting = rows.groupBy(key, "chunk").applyInArrow(at_rest, f"`{key}` {kind}, chunk long, sound long, n long, at binary, y binary, state array<double>")
    resting = settled(resting, "filtered-chunks")

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        z, sound, starts, intact = np.zeros(m), True, [], []
        for n, good, end in zip(group["n"], group["sound"], group["state"]):
            starts.append(z.tolist())
            intact.append(sound)
            z = _power(fixed, int(n)) @ z + np.asarray(end)
            sound = sound and good == n
        return pd.DataFrame({key: group[key], "chunk": group["chunk"], "start": starts, "intact": intact})

    maps = resting.select(key, "chunk", "n", "sound", "state")
    starts = maps.groupBy(key).applyInPandas(composed, f"`{key}` {kind}, chunk long, start array<double>, intact boolean")
    named = starts.withColumnsRenamed({key: "_key", "chunk": "_chunk"})

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                y = np.frombuffer(row["y"], "<f8") + run(fixed, np.zeros(row["n"]), np.asarray(row["start"], float))[0]
                lost = np.arange(row["n"]) >= (row["sound"] if row["intact"] else 0)
                keys = batch.column(key).slice(i, 1).take(pa.array(np.zeros(row["n"], np.int32)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.frombuffer(row["at"], "<i8")), pa.array(y, mask=lost)], names=[key, "idx", "v"])

    met = resting.join(named, F.col(key).eqNullSafe(F.col("_key")) & (F.col("chunk") == F.col("_chunk")))
    return met.select(key, "n", "sound", "at", "y", "start", "intact").mapInArrow(respond, f"`{key}` {kind}, idx long, v double")


@lru_cache(maxsize=256)
def _power(sections: Sections, n: int) -> np.ndarray:
    return np.linalg.matrix_power(_system(sections)[0], n)
