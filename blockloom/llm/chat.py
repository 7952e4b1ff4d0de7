"""Chat formatting: the cheapest repair of a conversation's roles, by dynamic programming over a legal-turn automaton."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, stored

#: States: nothing yet, or the role of the message that is open. A role's state is its place here.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Which message may follow which; a conversation may end after these.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (USER, ASSISTANT)
MERGE, RELABEL, INSERT = 1, 2, 3
NEVER = 1 << 28


def between(state: int, goals: tuple[int, ...]) -> tuple[int, ...]:
    """The fewest empty messages after which one of the goals is the state; the first by role order among equals."""
    ways = [(state, ())]
    for at, way in ways:
        if at in goals:
            return way
        ways += [(n, (*way, n)) for n in NEXT[at]]
    raise AssertionError


@cache
def step(role: int, before: int, after: int) -> tuple[int, bool, tuple[int, ...]]:
    """(cost, merged, inserted) of a turn of this role that leaves the state `after`; role 0 is an unknown one."""
    if after == START:
        return NEVER, False, ()
    relabel = RELABEL * (role != after)
    ways = [(relabel + MERGE, True, ())] if before == after else []
    if leads := tuple(s for s in NEXT if after in NEXT[s]):
        try:
            inserted = between(before, leads) if after != SYSTEM else () if before == START else None
        except AssertionError:
            inserted = None
        if inserted is not None:
            ways.append((relabel + INSERT * len(inserted), False, inserted))
    return min(ways, key=lambda w: w[0], default=(NEVER, False, ()))


@cache
def closing(state: int) -> tuple[int, ...]:
    """The empty messages that end a conversation left in this state."""
    return () if state == START else between(state, ENDS)


def times(matrix: list[int], role: int) -> list[int]:
    """The matrix of least costs from each state to each, one turn further."""
    return [min(NEVER, *(matrix[4 * s + m] + step(role, m, t)[0] for m in range(4))) for s in range(4) for t in range(4)]


UNIT = [0 if s == t else NEVER for s in range(4) for t in range(4)]


def prefixes(batches):
    """Adds to each row the least costs from any state before its segment (its conversation's rows in the task) to any after it."""
    last, matrix = object(), UNIT
    for b in batches:
        made = []
        for conv, role in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist()):
            matrix = times(matrix if conv == last else UNIT, ROLES.index(role) if role in ROLES else 0)
            last = conv
            made.append(matrix)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.int32()))], names=[*b.schema.names, "_pre"])


PATHS = pa.schema([("conv", pa.int64()), ("task", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("ends", pa.bool_())])


def paths(batches):
    """From the segments of each conversation, in order: the state before and after each on a cheapest way."""

    def solve(conv, segments):
        costs = [[0 if s == START else NEVER for s in range(4)]]
        for _, m in segments:
            costs.append([min(NEVER, *(costs[-1][s] + m[4 * s + t] for s in range(4))) for t in range(4)])
        at = min(range(4), key=lambda t: costs[-1][t] + INSERT * len(closing(t)))
        for k in range(len(segments) - 1, -1, -1):
            task, m = segments[k]
            before = min(range(4), key=lambda s: costs[k][s] + m[4 * s + at])
            yield conv, task, before, at, k == len(segments) - 1
            at = before

    def batches_of(rows):
        rows = list(rows)
        return batch(PATHS, **dict(zip(PATHS.names, zip(*rows))))

    conv, segments, out = None, [], []
    for b in batches:
        for c, t, m in zip(b.column("conv_id").to_pylist(), b.column("_task").to_pylist(), b.column("_pre").to_pylist()):
            if segments and c != conv:
                out += solve(conv, segments)
                segments = []
                if len(out) >= 10000:
                    yield batches_of(out)
                    out = []
            conv = c
            segments.append((t, m))
    if segments:
        out += solve(conv, segments)
    if out:
        yield batches_of(out)


REPAIRED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("merged", pa.bool_()), ("inserted", pa.list_(pa.string())), ("cost", pa.int64()), ("rendered", pa.string())])
REPAIRED_SQL = "conv_id long, turn long, role string, new_role string, merged boolean, inserted array<string>, cost long, rendered string"


def opened(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSED = "<|end|>\n"
MARKER = re.compile(r"<(\\*)\|")


def escaped(text: str | None) -> str:
    """A text in which nothing reads as a marker: `<|` gets a backslash between, `<\\|` one more, and so on."""
    return MARKER.sub(r"<\\\1|", text or "")


def retrace(batches):
    """Rows come last first; each gets its part of a cheapest way and of the rendered conversation."""
    key, at = None, None
    for b in batches:
        out = []
        for r in b.to_pylist():
            own = (r["_task"], r["conv_id"])
            final = key != own and r["ends"]
            if key != own or at is None:
                key, at = own, r["last"]
            role = ROLES.index(r["role"]) if r["role"] in ROLES else 0
            #: Costs before this row come from the row before it in the segment, or are those of standing still.
            had = r["_had"] if r["_had"] is not None else UNIT
            before = min(range(4), key=lambda s: had[4 * r["first"] + s] + step(role, s, at)[0])
            cost, merged, inserted = step(role, before, at)
            empties = "".join(opened(i) + CLOSED for i in inserted)
            piece = "\n" if merged else (CLOSED if before != START else "") + empties + opened(at)
            piece += escaped(r["text"])
            more = closing(at) if final else ()
            if final:
                piece += CLOSED + "".join(opened(i) + CLOSED for i in more)
            out.append((r["conv_id"], r["turn"], r["role"], ROLES[at], merged, [ROLES[i] for i in (*inserted, *more)], cost + INSERT * len(more), piece))
            at = before
        if out:
            yield batch(REPAIRED, **dict(zip(REPAIRED.names, zip(*out))))


def repair(turns: DataFrame) -> DataFrame:
    """A row per turn: conv_id, turn, role, new_role, merged, inserted, cost, rendered.

    A legal conversation is at most one system message, then user and assistant in turn, beginning with user and ending
    with either. A turn can join the open message (cost 1), change its role (2), or be led in or followed by empty
    messages (3 each); a role that is none of the three must change. The costs of a conversation's turns add up to the
    least possible; among equals the way is fixed by the order of states. The rendered pieces of a conversation, in
    order of turn, joined up, are the repaired conversation. `<|` in a text is written `<\\|`, and `<\\|` with one more
    backslash, so that texts can't forge turns and can be read back.

    Turns are dealt by range, so a conversation of any length spreads over tasks: each task sums up its part as a 4 by
    4 matrix of least costs, the parts' matrices are joined per conversation, and each task retraces its own part.

    Turns go by turn, null last, then by a hash of role and text; repeated turns stay. All turns without conv_id are
    one conversation. Null text is empty. An empty table gives an empty result; other columns are not looked at.
    """
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("_tie")]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").withColumn("_tie", F.xxhash64("role", "text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    with_costs = rows.mapInArrow(prefixes, rows.withColumn("_pre", F.array().cast("array<int>")).schema)
    kept = stored(with_costs.withColumn("_at", F.monotonically_increasing_id()), "turns")
    kept = kept.withColumn("_task", F.shiftright("_at", 33))
    segments = kept.groupBy("conv_id", "_task").agg(F.max_by("_pre", "_at").alias("_pre"))
    segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "_task")
    way = stored(segments.mapInArrow(paths, "conv long, task long, first int, last int, ends boolean"), "ways")
    # the row before is in the same task, so its number is one less
    had = kept.select(F.col("_at").alias("_b"), F.col("conv_id").alias("_bc"), F.col("_pre").alias("_had"))
    both = kept.drop("_pre", "_tie").join(way, (F.col("_task") == F.col("task")) & F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv", "task")
    both = both.join(had, (F.col("_at") == F.col("_b") + 1) & F.col("conv_id").eqNullSafe(F.col("_bc")), "left").drop("_b", "_bc")
    dealt = both.repartition("_task", "conv_id").sortWithinPartitions("_task", "conv_id", F.col("_at").desc())
    return dealt.mapInArrow(retrace, REPAIRED_SQL)


def op4_chat(turns: DataFrame) -> DataFrame:
    return repair(turns)
