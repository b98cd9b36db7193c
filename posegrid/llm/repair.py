"""Repair of the structure of conversations: faults are marked, and the cheapest edits give alternating turns.

A repaired conversation has role initials ``(s?(ua)+)?``. Keeping a turn costs nothing, giving it the role user or
assistant 2, deleting it 3, inserting an empty turn of either role 2; a truncated turn that stays adds 1, and blank or
duplicate turns must go. Of equally cheap edits those with the ASCII-least initials (Delete, Insert, Keep, Rerole) are taken.

The plan is a run-length dynamic program. A turn's symbol is its role's initial and its fault; equal consecutive
symbols are one run. One turn is a min-plus transition between the four states of the pattern, inserts before it included; its
binary powers are cached by symbol, so the costs to the end at all run borders take a logarithm of each run's length. The choices are then
unrolled forwards: at each turn the least letter that keeps to the cost to the end, whose values inside a run come from
the same powers by halving.

Spark deals whole conversations to tasks and sorts them, spilling where it must; tasks stream the sorted turns. A
conversation's turns are never collected: the first pass holds its runs, the second one its plan, a letter or two a turn. A
conversation of most rows is still one sequence for its plan and digest and streams through one task.

Defined cases: turns go by turn (null first), then role, then text, and repeated rows are duplicates; a null role or text is one
space; rows with a null ``conv_id`` are one conversation; a role whose initial is none of s, u, a (an empty one too) can't be
kept; gaps ignore null turns; a conversation whose turns are all lost has zeros, no edits and no turns; texts of
any length are read whole; other columns are ignored; no rows, no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

SPACES = " \t\n\x0b\x0c\r"
#: Faults of a turn, the first that holds.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
BEGUN, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": {BEGUN: SYSTEM}, "u": {BEGUN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state after a turn of our own making, the one role that can follow.
MADE = {BEGUN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
RE_ROLE, DELETE, INSERT, STAYS_TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
#: Runs up to this length are unrolled in one piece.
PIECE = 1024

Symbol = tuple[str, int]
Matrix = tuple[tuple[int, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(x + b[k][j] for k, x in enumerate(row))) for j in range(4)) for row in a)


def _apply(a: Matrix, ahead: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(FAR, *(x + y for x, y in zip(row, ahead))) for row in a)


def _inserts() -> Matrix:
    """Costs of any number of inserted turns."""
    costs = [[0 if s == t else FAR for t in range(4)] for s in range(4)]
    for s in range(4):
        at, cost = s, 0
        for _ in range(3):
            at, cost = MADE[at], cost + INSERT
            costs[s][at] = min(costs[s][at], cost)
    return tuple(map(tuple, costs))


INSERTS = _inserts()
#: Costs to the end when no turn is left.
AT_END = _apply(INSERTS, (0, FAR, FAR, 0))


def moves(state: int, symbol: Symbol) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a turn, letters ascending."""
    initial, fault = symbol
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    more = STAYS_TRUNCATED if fault == TRUNCATED else 0
    if state in STEPS.get(initial, {}):
        yield "K", more, STEPS[initial][state]
    yield "R", RE_ROLE + more, MADE[state]


@lru_cache(maxsize=4096)
def power(symbol: Symbol, k: int) -> Matrix:
    """The transition of 2**k turns of a symbol."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    turn = [[FAR] * 4 for _ in range(4)]
    for s in range(4):
        for _, cost, t in moves(s, symbol):
            turn[s][t] = min(turn[s][t], cost)
    return _times(INSERTS, tuple(map(tuple, turn)))


def before(symbol: Symbol, length: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a run, from those after it."""
    k = 0
    while length:
        if length & 1:
            ahead = _apply(power(symbol, k), ahead)
        length, k = length >> 1, k + 1
    return ahead


def _inside(symbol: Symbol, length: int, ahead: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
    """Costs to the end after the first, second, ... turn of a run; memory doesn't grow with the run."""
    if length > PIECE:
        half = length // 2
        yield from _inside(symbol, half, before(symbol, length - half, ahead))
        yield from _inside(symbol, length - half, ahead)
        return
    costs = [ahead]
    for _ in range(length - 1):
        costs.append(_apply(power(symbol, 0), costs[-1]))
    yield from reversed(costs)


def _unrolled(runs: tuple[tuple[Symbol, int], ...], ahead: list[tuple[int, ...]]) -> Iterator[str]:
    state, now = BEGUN, ahead[0]
    for (symbol, length), after in zip(runs, ahead[1:]):
        for later in _inside(symbol, length, after):
            left = now[state]
            while True:
                options = [m for m in moves(state, symbol) if m[1] + later[m[2]] == left]
                made = MADE[state]
                if (not options or options[0][0] > "I") and INSERT + now[made] == left:
                    yield "I"
                    state, left = made, now[made]
                    continue
                letter, _, state = options[0]
                yield letter
                break
            now = later
    while now[state]:
        yield "I"
        state = MADE[state]


@lru_cache(maxsize=1 << 14)
def _short_plan(runs: tuple[tuple[Symbol, int], ...]) -> tuple[int, str]:
    return _plan(runs)


def _plan(runs: tuple[tuple[Symbol, int], ...]) -> tuple[int, str]:
    ahead = [AT_END]
    for symbol, length in reversed(runs):
        ahead.append(before(symbol, length, ahead[-1]))
    ahead.reverse()
    return ahead[0][BEGUN], "".join(_unrolled(runs, ahead))


def plan(runs: list[tuple[Symbol, int]]) -> tuple[int, str]:
    """The least cost of repairing runs of symbols, and the initials of its edits."""
    return (_short_plan if len(runs) <= 64 and sum(n for _, n in runs) <= PIECE else _plan)(tuple(runs))


def repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that the edits leave of ``turns``."""
    state = BEGUN
    for letter in audit:
        if letter == "I":
            state = MADE[state]
            yield ROLES[state], ""
            continue
        role, text = next(turns)
        if letter == "R":
            state = MADE[state]
            yield ROLES[state], text
        elif letter == "K":
            state = STEPS[role[0]][state]
            yield role, text


def mark_faults(turns: DataFrame) -> DataFrame:
    """Written rows (conv, at, turn, role, text, lost, fault) of ``turns`` (conv_id, turn, role, text, maybe lost).

    ``at`` numbers the turns in order. A row that is ``lost`` is no turn, but its conversation is reported.
    """
    none = F.lit(" ")
    lost = F.coalesce(F.col("lost"), F.lit(False)) if "lost" in turns.columns else F.lit(False)
    rows = turns.select(
        F.col("conv_id").alias("conv"), "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"), lost.alias("lost")
    ).repartition("conv")
    # Both sorts and the window stay inside the tasks that hold whole conversations.
    same = Window.partitionBy("conv", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (
        F.when(ended == "", BLANK)
        .when(F.row_number().over(same) > 1, DUPLICATE)
        .when(~F.substring(ended, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(SOUND)
    )
    ordered = rows.withColumn("fault", fault).sortWithinPartitions("conv", "turn", "role", "text")
    return settle(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv, its rows without that column), streamed from batches that are sorted by conversation."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
    for key, members in groupby(rows, key=lambda row: row[0]):
        yield key, (row[1:] for row in members)


def _collected(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int] = len) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", "at")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def plan_repairs(marked: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation, written."""
    kind = _arrow(marked, "conv")
    schema = pa.schema([("conv", kind), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])

    def judged(rows: Iterator[tuple]) -> tuple:
        faults, illegal, n_turns = [0] * 4, 0, 0
        first = last = before_initial = None
        runs: list[tuple[Symbol, int]] = []
        for _, turn, initial, fault, lost in rows:
            if lost:
                continue
            faults[fault] += 1
            illegal += before_initial is not None and before_initial + initial not in LEGAL
            before_initial = initial
            if turn is not None and turn != last:
                first, last, n_turns = turn if first is None else first, turn, n_turns + 1
            symbol = ("", fault) if fault in (BLANK, DUPLICATE) else (initial, fault)
            if runs and runs[-1][0] == symbol:
                runs[-1] = symbol, runs[-1][1] + 1
            else:
                runs.append((symbol, 1))
        gaps = min(last - first + 1 - n_turns, (1 << 63) - 1) if n_turns else 0
        return gaps, *faults[1:], illegal, *plan(runs)

    def plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((key, *judged(rows)) for key, rows in _conversations(batches))
        yield from _collected(found, schema, lambda row: 64 + len(row[-1]))

    light = marked.select("conv", "at", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "lost")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return settle(_sorted(light).mapInArrow(plans, f"conv {marked.schema['conv'].dataType.simpleString()}, {counts}, audit string"), "plans")


def repaired_turns(marked: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv, place, role, text) of every repaired turn; each task's conversations are whole and in order."""
    schema = pa.schema([("conv", _arrow(marked, "conv")), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, rows in _conversations(batches):
            audit = next(rows)[-1]
            for place, (role, text) in enumerate(repaired(audit, ((row[1], row[2]) for row in rows))):
                yield key, place, role, text

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _collected(edited(batches), schema, lambda row: 64 + len(row[-1]))

    none = F.lit(None).cast("string")
    turns = marked.filter("not lost").select("conv", "at", "role", "text", none.alias("audit"))
    rows = plans.select("conv", F.lit(-1).cast("long").alias("at"), none.alias("role"), none.alias("text"), "audit").union(turns)
    kind = marked.schema["conv"].dataType.simpleString()
    return _sorted(rows).mapInArrow(edit, f"conv {kind}, place long, role string, text string")


def turn_digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) over the lines ``role:text`` of the turns that :func:`repaired_turns` gives, as it gives them."""
    schema = pa.schema([("conv", _arrow(repaired, "conv")), ("sha256", pa.string())])

    def digest(rows: Iterator[tuple]) -> str:
        found = hashlib.sha256()
        for place, role, text in rows:
            found.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        return found.hexdigest()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _collected(((key, digest(rows)) for key, rows in _conversations(batches)), schema, lambda row: 128)

    return repaired.mapInArrow(digests, f"conv {repaired.schema['conv'].dataType.simpleString()}, sha256 string")


def repair_report(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    marked = mark_faults(turns)
    plans = plan_repairs(marked)
    digests = turn_digests(repaired_turns(marked, plans)).withColumnRenamed("conv", "_conv")
    known = plans.join(digests, F.col("conv").eqNullSafe(F.col("_conv")), "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return known.select(F.col("conv").alias("conv_id"), *COUNTS, "audit", F.coalesce("sha256", empty).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults that depend on a checksum of their place: lost, emptied, without ends, repeated, or by the user."""
    none: Column = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), none), F.lit(":"), F.coalesce(F.col("turn").cast("string"), none))
    role, text = F.coalesce("role", none), F.coalesce("text", none)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(place) % 20).alias("kind"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("lost"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
