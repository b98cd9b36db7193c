"""Exact percentiles of groups of any size.

``percentile`` keeps every different value of a group in one task. Here a mergeable sketch gives bounds around each asked
order statistic, one more pass counts the values below the bounds and sends on only those between them, and this is
done again inside the bounds until few different values are left (or the bounds stay, as half of a group may be one value). The last values are counted by value and picked by running count.
Results are those of ``percentile``: linear between the two nearest ranks, missing values left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posegrid.sources.scratch import settled

#: Accuracy of the sketch (a rank's error is under a group's rows by this number), its steps, and different values ordered together at last.
ACCURACY, GRID, FEW = 10_000, 64, 200_000


def _same(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Equi-join on keys that may be null."""
    named = right.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(named, reduce(lambda a, b: a & b, on)).drop(*(f"_of_{k}" for k in keys)) if on else left.crossJoin(F.broadcast(named))


def percentiles(df: DataFrame, value: str, shares: list[float], keys=("recording",), accuracy: int = ACCURACY, few: int = FEW) -> DataFrame:
    """(keys, share, n, percentile) for each share of 0 to 1; groups without a value have no row."""
    keys = list(keys)
    rows = settled(df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null"), "values")
    wanted = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    floor = F.floor("_at").cast("long")
    wanted = wanted.withColumn("_at", F.col("share") * (F.col("n") - 1))
    ranks = wanted.select(*keys, "n", "share", "_at", F.explode(F.array_distinct(F.array(floor, F.least(floor + 1, F.col("n") - 1)))).alias("_rank"))
    ranks = settled(ranks, "ranks")
    # NaN is the greatest value, so it bounds all.
    bounds = ranks.select(*keys, "_rank").distinct().select("*", F.lit(float("-inf")).alias("_low"), F.lit(float("nan")).alias("_high"), F.lit(False).alias("_stuck"))
    found = []
    while True:
        # Bounds are few, a row for each asked rank, and meet the rows by their keys.
        met = _same(rows, bounds, keys).filter("_v <= _high")
        below = met.groupBy(*keys, "_rank").agg(F.sum((F.col("_v") < F.col("_low")).cast("long")).alias("_below"))
        values = met.filter("_v >= _low").groupBy(*keys, "_rank", "_low", "_high", "_stuck", "_v").agg(F.count("*").alias("_times"))
        inside = values.groupBy(*keys, "_rank", "_low", "_high", "_stuck").agg(
            F.count("*").alias("_different"), F.sum("_times").alias("_inside"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
        )
        counted = settled(_same(inside, below, [*keys, "_rank"]), "counted")
        done = F.col("_stuck") | (F.col("_different") <= few)
        found.append(settled(_picked(rows, counted.filter(done), keys), "picked"))
        rest = counted.filter(~done)
        if rest.isEmpty():
            break
        bounds = settled(_closer(rows, rest, keys, accuracy), "bounds")
    known = _same(ranks, reduce(DataFrame.unionByName, found), [*keys, "_rank"])
    pair = known.groupBy(*keys, "share", "n", "_at").agg(F.min_by("_value", "_rank").alias("_a"), F.max_by("_value", "_rank").alias("_b"))
    share = F.col("_at") - F.floor("_at")
    exact = F.when((share == 0) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise((1 - share) * F.col("_a") + share * F.col("_b"))
    return pair.select(*keys, "share", "n", exact.alias("percentile"))


def _closer(rows: DataFrame, rest: DataFrame, keys, accuracy: int) -> DataFrame:
    """Bounds around each rank that a sketch of the values between the present bounds gives; ``_stuck`` where they stay."""
    inner = _same(rows, rest.select(*keys, "_rank", "_low", "_high"), keys).filter("_v >= _low and _v <= _high")
    grid = F.array(*(F.lit(i / GRID) for i in range(GRID + 1)))
    sketch = inner.groupBy(*keys, "_rank").agg(F.percentile_approx("_v", grid, accuracy).alias("_grid"))
    share = (F.col("_rank") - F.col("_below")) / F.col("_inside")
    slack = 2.0 / accuracy
    first, last = F.floor((share - slack) * GRID).cast("int"), F.ceil((share + slack) * GRID).cast("int")
    low = F.when(first <= 0, F.col("_least")).otherwise(F.get("_grid", first))
    high = F.when(last >= GRID, F.col("_most")).otherwise(F.get("_grid", last))
    told = _same(rest.drop("_low", "_high", "_stuck"), sketch, [*keys, "_rank"])
    return told.select(*keys, "_rank", low.alias("_low"), high.alias("_high"), ((low == F.col("_least")) & (high == F.col("_most"))).alias("_stuck"))


def _picked(rows: DataFrame, last: DataFrame, keys) -> DataFrame:
    """(keys, _rank, _value): the asked order statistic among the few values within bounds, by running count of different values."""
    inside = _same(rows, last.select(*keys, "_rank", "_low", "_high", "_below"), keys).filter("_v >= _low and _v <= _high")
    counts = inside.groupBy(*keys, "_rank", "_below", "_v").agg(F.count("*").alias("_times"))
    up_to = F.sum("_times").over(Window.partitionBy(*keys, "_rank").orderBy("_v")) + F.col("_below")
    reached = counts.withColumn("_up_to", up_to).filter("_up_to > _rank")
    return reached.groupBy(*keys, "_rank").agg(F.min("_v").alias("_value"))
