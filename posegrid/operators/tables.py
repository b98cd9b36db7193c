"""Filters, reshaping and joins of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_periods(df: DataFrame, periods: DataFrame, key: str = "recording", frame: str = "frame") -> DataFrame:
    """Rows whose frame lies in their key's [start, end); an open end (null) is no bound.

    Periods are given by hand, a row or so per animal; Spark broadcasts them while they are small.
    """
    p = periods.select(F.col(key), F.col("start").alias("_start"), F.col("end").alias("_end"))
    inside = (F.col("_start").isNull() | (F.col(frame) >= F.col("_start"))) & (F.col("_end").isNull() | (F.col(frame) < F.col("_end")))
    return df.join(p, key).filter(inside).drop("_start", "_end")


def minutes_to_frames(minutes: Column, fps: int = 100) -> Column:
    """Half-even rounding."""
    return F.bround(minutes * 60 * fps).cast("long")


def region_of(name: Column) -> Column:
    """Anatomical region by the first rule that fits; reference points have none; anything else raises."""
    rules = (("ref", None), ("nose", "nose"), ("pad", "whiskers"), ("whisker", "whiskers"), ("lip", "mouth"), ("mouth", "mouth"), ("eye", "eye"), ("ear", "ear"), ("cheek", "whiskers"))
    sided = F.when(name.contains("left"), F.lit("(left)")).when(name.contains("right"), F.lit("(right)")).otherwise("")
    found = F.raise_error(F.concat(F.lit("no region: "), name)).cast("string")
    for part, region in reversed(rules):
        value = F.lit(None).cast("string") if region is None else F.concat(F.lit(region), sided if region in ("eye", "ear") else F.lit(""))
        found = F.when(name.contains(part), value).otherwise(found)
    return found


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key in a total order."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", number).filter("_n = 1").drop("_n")


def strided(df: DataFrame, step: int, offset: int = 0, order: str = "idx") -> DataFrame:
    return df.filter(F.pmod(F.col(order) - offset, F.lit(step)) == 0)


def shift_frames(df: DataFrame, shift: int, keys=("recording",), order: str = "idx") -> DataFrame:
    """Row i takes the values of row max(i + shift, 0); for a positive shift the recording is that much shorter."""
    if shift >= 0:
        return df.filter(F.col(order) >= shift).withColumn(order, F.col(order) - shift)
    first = df.filter(F.col(order) == 0).withColumn(order, F.explode(F.sequence(F.lit(0), F.lit(-shift - 1))))
    n = F.max(order).over(Window.partitionBy(*keys))
    moved = df.withColumn("_n", n).filter(F.col(order) - shift <= F.col("_n")).drop("_n").withColumn(order, F.col(order) - shift)
    return first.unionByName(moved)


def custom_order(column: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), column)


def nearest(times: DataFrame, samples: DataFrame, key: str, bucket: int) -> DataFrame:
    """For each ``t`` of ``times`` the nearest ``s`` of ``samples`` (with value v); the earlier wins a tie.

    Both are dealt by key and time bucket, and each bucket also gets the last sample before and the first
    after it, so a long recording is many tasks.
    """
    t = times.withColumn("_b", F.floor(F.col("t") / bucket))
    s = samples.withColumn("_b", F.floor(F.col("s") / bucket))
    ends = s.groupBy(key, "_b").agg(F.min_by(F.struct("s", "v"), "s").alias("_f"), F.max_by(F.struct("s", "v"), "s").alias("_l"))
    rows = t.select(key, "_b", F.col("t").alias("_at"), F.lit(1).alias("_q"), F.lit(None).cast("struct<s:bigint,v:double>").alias("_s"))
    mine = s.select(key, "_b", F.col("s").alias("_at"), F.lit(0).alias("_q"), F.struct(F.col("s").cast("long").alias("s"), F.col("v").cast("double").alias("v")).alias("_s"))
    wanted = t.select(key, "_b").distinct()
    # Neighbours beyond the bucket, from one row per bucket.
    both = wanted.withColumn("_w", F.lit(1)).join(ends, [key, "_b"], "full")
    # All frames grow from the start of their order, so each row costs one step.
    over = Window.partitionBy(key).orderBy("_b")
    down = Window.partitionBy(key).orderBy(F.col("_b").desc())
    edge = both.withColumns(
        {
            "_p": F.last("_l", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)),
            "_n": F.last("_f", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1)),
        }
    ).filter("_w = 1")
    outer = edge.select(key, "_b", F.explode(F.array("_p", "_n")).alias("_x")).filter("_x is not null")
    outer = outer.select(key, "_b", F.col("_x.s").alias("_at"), F.lit(0).alias("_q"), F.struct(F.col("_x.s").cast("long").alias("s"), F.col("_x.v").cast("double").alias("v")).alias("_s"))
    line = Window.partitionBy(key, "_b").orderBy("_at", "_q")
    back = Window.partitionBy(key, "_b").orderBy(F.col("_at").desc(), F.col("_q"))
    near = (
        rows.unionByName(mine)
        .unionByName(outer)
        .withColumns(
            {
                "_before": F.last("_s", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)),
                "_after": F.last("_s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)),
            }
        )
        .filter("_q = 1")
    )
    left, right = F.col("_at") - F.col("_before.s"), F.col("_after.s") - F.col("_at")
    pick = F.when(left.isNull() | (right < left), F.col("_after")).otherwise(F.col("_before"))
    return near.withColumn("_r", pick).select(key, F.col("_at").alias("t"), F.col("_r.s").alias("s"), F.col("_r.v").alias("v"))


def frame_of(us: Column, fps: int = 100) -> Column:
    """Frame whose interval holds a time in whole microseconds, on a regular grid."""
    return F.floor(us / (1_000_000 // fps)).cast("long")


def histogram(df: DataFrame, width: float, value: str = "v", keys=("recording",)) -> DataFrame:
    """Bins of a width from the least value of each key, in percent of the key."""
    low = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.count(value).alias("_n"))
    binned = df.filter(F.col(value).isNotNull()).join(low, list(keys)).withColumn("bin", F.floor((F.col(value) - F.col("_lo")) / width))
    return binned.groupBy(*keys, "bin", "_n").agg(F.count("*").alias("n")).withColumn("percent", 100.0 * F.col("n") / F.col("_n")).drop("_n")


def equal_bins(df: DataFrame, bins: int, value: str = "v", keys=("recording",)) -> DataFrame:
    """Adds ``bin``, of equal bins over the range of each key, the last one closed; with one value only all is bin 0."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return df.join(ends, list(keys)).withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)))


def frame_at(events: DataFrame, frames: DataFrame, time: str = "t_us", keys=("session",), width: int = 60_000_000) -> DataFrame:
    """``events`` with ``frame``: the last frame (keys, frame, time) at or before each, on uneven frame times.

    Events before the first frame get the first, those after the last one the last; a key without frames gives null. Both tables
    are dealt by key and stretches of ``width``; what a stretch lacks at its start comes from one row for each
    stretch before it, so a long session is many tasks.
    """
    keys = list(keys)
    cut = F.floor(F.col(time) / width).cast("long")
    at = frames.select(*keys, F.col(time).alias("_t"), F.col("frame").alias("_f"), F.floor(F.col(time) / width).cast("long").alias("_part"))
    ends = at.groupBy(*keys, "_part").agg(F.max(F.struct("_t", "_f")).getField("_f").alias("_last"), F.min(F.struct("_t", "_f")).getField("_f").alias("_first"))
    # Stretches of events and of frames together, so that those without a frame are carried over too.
    parts = events.select(*keys, cut.alias("_part")).distinct().join(ends, [*keys, "_part"], "full")
    over = Window.partitionBy(*keys).orderBy("_part")
    carried = parts.select(
        *keys, "_part", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_least"),
    )
    row = F.struct(*events.columns)
    both = events.select(*keys, F.col(time).alias("_t"), F.lit(None).cast(frames.schema["frame"].dataType).alias("_f"), cut.alias("_part"), F.lit(1).alias("_kind"), row.alias("_row"))
    both = both.unionByName(at.select("*", F.lit(0).alias("_kind"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row")))
    so_far = Window.partitionBy(*keys, "_part").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.last("_f", ignorenulls=True).over(so_far)).filter("_kind = 1").join(carried, [*keys, "_part"])
    return found.select("_row.*", F.coalesce("_here", "_before", "_least").alias("frame"))


def with_key_columns(df: DataFrame, parts: dict[str, int], words: dict[str, str] | None = None, path: str = "path", separator: str = "_") -> DataFrame:
    """Key columns from file names: ``parts`` by their number from one, ``words`` as whether the name holds one."""
    cut = {name: F.split_part(path, F.lit(separator), F.lit(i)) for name, i in parts.items()}
    return df.withColumns(cut | {name: F.col(path).contains(word) for name, word in (words or {}).items()})


def without_names(df: DataFrame, names: list[str], column: str, exact: bool = False) -> DataFrame:
    """Rows whose name holds none of ``names`` (so '8' drops '48' too), or with ``exact`` is none of them."""
    if exact:
        return df.filter(~F.col(column).isin(names))
    for name in names:
        df = df.filter(~F.col(column).contains(name))
    return df


def of_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows that have one of the key tuples."""
    return df.join(keys, keys.columns, "left_semi")


def renamed_values(column: Column, names: dict[str, str], otherwise: Column | None = None) -> Column:
    """A value's other name, or the value itself."""
    if not names:
        return column if otherwise is None else otherwise
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(table[column], column if otherwise is None else otherwise)


def filled(df: DataFrame, grid: DataFrame, values: dict[str, float]) -> DataFrame:
    """Every row of ``grid``, with the values of ``df`` or their fillings."""
    keys = grid.columns
    found = grid.join(df.select(*keys, *values), keys, "left")
    return found.select(*keys, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in values.items()))


def axes_long(df: DataFrame, keys, axes=("x", "y", "z")) -> DataFrame:
    """A row for each axis of a point."""
    return df.unpivot(list(keys), list(axes), "axis", "value")


def values_wide(df: DataFrame, keys, name: str, names: list[str], values) -> DataFrame:
    """A row of keys with columns ``name/value``; the names are given, so Spark need not look for them."""
    rows = df.select(*keys, name, *(F.col(v).alias(f"_{v}") for v in values)).groupBy(*keys).pivot(name, names).agg(*(F.first(f"_{v}").alias(v) for v in values))
    # Spark names a pivoted column name_value, and by the name alone where there is one value.
    return rows.toDF(*keys, *(f"{n}/{v}" for n in names for v in values))


def exploded(df: DataFrame, keys, arrays) -> DataFrame:
    """(keys, i, arrays): a row for each place of parallel arrays."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("i", "_x"))
    return rows.select(*keys, F.col("i").cast("long").alias("i"), *(F.col("_x").getField(a).alias(a) for a in arrays))


def all_rows(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; what a table lacks is null."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def side_rank(name: Column) -> Column:
    """0 for the left side, 1 for the right, 2 for what has none."""
    return F.when(name.endswith("(left)"), 0).when(name.endswith("(right)"), 1).otherwise(2)


def numeric_text(text: Column) -> Column:
    """The first number in a text, or null."""
    return F.regexp_extract(text, r"[0-9.]+", 0).try_cast("double")


def condition_origin(df: DataFrame, ends: Column, zeros: int, key: str = "recording", order: str = "idx", value: str = "v") -> DataFrame:
    """(key, t, value): series that ``ends`` holds for stop at time zero, the others start ``zeros`` steps later; in between all are zero."""
    first = df.filter(ends)
    length = first.groupBy(key).agg((F.max(order) + 1).alias("_n"))
    before = first.join(length, key).select(key, (F.col(order) - F.col("_n")).cast("long").alias("t"), value)
    after = df.filter(~ends).select(key, (F.col(order) + zeros).cast("long").alias("t"), value)
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(zeros - 1).cast("long")))
    quiet = df.select(key).distinct().select(key, steps.alias("t"), F.lit(0.0).alias(value))
    return before.unionByName(after).unionByName(quiet)


def common_origin(df: DataFrame, starts: Column, length: int, key: str = "recording", order: str = "idx") -> DataFrame:
    """``df`` from each series' first row that ``starts`` holds for, ``length`` steps at most, with the time ``t`` since then."""
    origin = df.filter(starts).groupBy(key).agg(F.min(order).alias("_o"))
    since = F.col(order) - F.col("_o")
    return df.join(origin, key).withColumn("t", since).filter((F.col("t") >= 0) & (F.col("t") < length)).drop("_o")
