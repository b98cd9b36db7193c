"""Chat logs: snapshots of one conversation are collapsed, and what remains is rendered.

Logs hold a conversation again each time it grew. Its turns in order give rolling hashes, one for every
prefix: the running exclusive-or of 128-bit hashes of (position, role, text). A conversation is a
snapshot when its last rolling hash is a shorter prefix's hash of some other conversation at the same
length; anti-joins retain the rest. Of equal conversations the least ``conv_id`` stays.

Both sides of the anti-join are made distinct first, with map-side aggregation, so a first turn or a
whole conversation that a third of the log shares is one row there. A conversation's own turns are
windowed together; they are rendered into one row of the result and so are bounded by it.

Defined cases: turns are ordered by turn (null first), role, text, so equal turn numbers have a fixed
order and repeated rows are turns of their own; a null role or text hashes apart from an empty one and
renders as empty; the marks of a turn's ends inside a role or text get a space (``<| im_end|>``), so no text can forge a
turn; texts of any length are hashed and rendered whole; a row with a null ``conv_id`` is a conversation of its own, its turn number aside, so such
rows gather in no task; no rows, no result rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: Rendering of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]


def _hash(which: int, place: Column) -> Column:
    """One of two hashes of a turn at its place."""
    return F.xxhash64(F.lit(which), place, F.isnull("role"), F.col("role"), F.isnull("text"), F.col("text"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, high, low, length): the rolling hash of every prefix of every conversation."""
    turns, loose = turns.filter("conv_id is not null"), turns.filter("conv_id is null")
    own = Window.partitionBy("conv_id")
    so_far = own.orderBy(*_order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(own.orderBy(*_order())))
    placed = placed.withColumn("h", _hash(1, F.col("place"))).withColumn("l", _hash(2, F.col("place")))
    known = placed.select(
        "conv_id", "place", F.bit_xor("h").over(so_far).alias("high"), F.bit_xor("l").over(so_far).alias("low"), F.count("*").over(own).alias("length")
    )
    one = F.lit(1)
    return known.union(loose.select("conv_id", one.alias("place"), _hash(1, one).alias("high"), _hash(2, one).alias("low"), one.cast("long").alias("length")))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, high, low) of the conversations that prefix no longer one, one of each group of equals."""
    hashes = settle(prefix_hashes(turns), "prefix-hashes")
    whole = (
        hashes.filter("place = length").groupBy("length", "high", "low").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    shorter = hashes.filter("place < length").select(F.col("place").alias("length"), "high", "low").distinct()
    return whole.join(shorter, ["length", "high", "low"], "left_anti").select("conv_id", F.col("length").alias("n_turns"), "n_copies", "high", "low")


def _plain(value: str) -> Column:
    """A role or text that can't open or close a turn: marks inside it get a space."""
    out = F.coalesce(value, F.lit(""))
    for mark in (OPEN, CLOSE.strip()):
        out = F.replace(out, F.lit(mark), F.lit(mark.replace("<|", "<| ")))
    return out


def _shown() -> Column:
    return F.concat(F.lit(OPEN), _plain("role"), F.lit("\n"), _plain("text"), F.lit(CLOSE))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, rendered): the turns of every conversation in order, in chat markup."""
    key = F.struct(F.col("turn"), F.col("role"), F.col("text"), _shown().alias("shown"))
    ordered = F.sort_array(F.collect_list(key))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["shown"]), "").alias("rendered"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of every maximal conversation."""
    kept = settle(maximal_conversations(turns), "maximal-conversations")
    shown = render(turns.join(kept.select("conv_id"), "conv_id", "left_semi"))
    known = kept.join(shown, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")
    # A conversation of one row without an id is found again by its hashes.
    one, both = F.lit(1), ["high", "low"]
    loose = turns.filter("conv_id is null").select(_hash(1, one).alias("high"), _hash(2, one).alias("low"), _shown().alias("rendered"))
    lone = kept.filter("conv_id is null").join(loose.groupBy(*both).agg(F.first("rendered").alias("rendered")), both)
    return known.union(lone.select("conv_id", "n_turns", "n_copies", "rendered"))
