"""Chat formatting by minimum-cost role repair.

A legal conversation is a word of a small automaton: an optional system turn, then user and assistant in turn, ending
with assistant.  Each source turn is given a role (its own, or a *relabel*) and either *steps* to a new turn, is
*merged* into the open one, or steps after *empty insertions* that make the step legal.  Dynamic programming finds the
cheapest repair; the repaired turns are rendered.

The costs of a run of turns form a 4 x 4 matrix (state before, state after) over (min, +), and matrices of adjoining
runs multiply, so a conversation of any length is cut where the range partitioning cuts it:

1.  Turns are range-partitioned and sorted; each partition's run of a conversation is a segment with its matrix.
2.  The matrices of a conversation (one per partition at most) are chained; every segment learns the state it starts
    and ends in, and how many turns come before it.
3.  Each segment finds its own path between those states and renders its turns.  Nothing gathers a conversation: the
    result has a row per turn, and the rows' ``rendered`` in order of ``seq`` are the conversation.

Equal costs are decided by a hash of the turns and choices, which adds up like the costs, so the result doesn't depend
on the partitioning.

Defined results: roles are matched after trimming and lower-casing, with common aliases; other roles and null are
unknown and cheap to relabel.  A null text is empty.  Turns are ordered by number (null first), then role, then a hash
of the text.  A repeated row (same conversation, number, role and text) is one turn delivered twice and counts once; without a
number nothing says so, and each row is a turn.
Rows with a null conversation id are one conversation.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema

ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant",
           "developer": "system"}
START, SYSTEM, USER, ASSISTANT = range(4)
UNKNOWN = 4
#: Costs of a repair.
MERGE, RELABEL, NAME_UNKNOWN, INSERT = 1, 2, 1, 3
#: Legal steps of the automaton, and the empty turns that make other steps legal.
STEPS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
BRIDGES = {(START, ASSISTANT): (USER,), (SYSTEM, ASSISTANT): (USER,), (USER, USER): (ASSISTANT,), (ASSISTANT, ASSISTANT): (USER,)}
#: Empty turns that close a conversation.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
OPEN_TURN, CLOSE_TURN = "<|im_start|>{role}\n", "<|im_end|>\n"

#: A move: (state before, state after, cost, merged, inserted turns).
Move = tuple[int, int, int, bool, tuple[int, ...]]


def moves(code: int) -> list[Move]:
    """The moves that a turn of a role allows."""
    out: list[Move] = []
    for after in (SYSTEM, USER, ASSISTANT):
        named = 0 if code == after else (NAME_UNKNOWN if code == UNKNOWN and after != SYSTEM else RELABEL)
        for before in range(4):
            if (before, after) in STEPS:
                out.append((before, after, named, False, ()))
            if before == after:
                out.append((before, after, named + MERGE, True, ()))
            if (before, after) in BRIDGES:
                out.append((before, after, named + INSERT * len(BRIDGES[before, after]), False, BRIDGES[before, after]))
    return out


MOVES = {code: moves(code) for code in (SYSTEM, USER, ASSISTANT, UNKNOWN)}


def draw(turn_hash: int, number: int) -> int:
    """The tie-break of a turn's ``number``-th move."""
    return ((turn_hash ^ (number * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 >> 17) & 0xFFFFFFFF


#: Value of a path: (cost, tie-break, new turns, inserted turns); the first two decide.
Value = tuple[int, int, int, int]


def run_from(state: int, turns: list[tuple[int, int]]) -> list[dict[int, tuple[Value, int, int]]]:
    """Best (value, state before, move number) for each state after each (code, hash) turn, from one state."""
    best: dict[int, Value] = {state: (0, 0, 0, 0)}
    out = []
    for code, turn_hash in turns:
        new: dict[int, tuple[Value, int, int]] = {}
        for number, (before, after, cost, merged, inserted) in enumerate(MOVES[code]):
            if before in best:
                c, t, steps, empty = best[before]
                value = (c + cost, t + draw(turn_hash, number), steps + (not merged) + len(inserted), empty + len(inserted))
                if after not in new or value < new[after][0]:
                    new[after] = (value, before, number)
        out.append(new)
        best = {s: v[0] for s, v in new.items()}
    return out


def matrix(turns: list[tuple[int, int]]) -> list[int]:
    """The values of all pairs of states, flat; cost -1 where there is no path."""
    flat: list[int] = []
    for state in range(4):
        last = run_from(state, turns)[-1]
        for after in range(4):
            flat += last[after][0] if after in last else (-1, 0, 0, 0)
    return flat


def chained(matrices: list[list[int]]) -> tuple[int, list[int]]:
    """(total cost, the states at the borders of the segments) of the cheapest repair of a conversation."""
    best: dict[int, tuple[int, int]] = {START: (0, 0)}
    back: list[dict[int, int]] = []
    for flat in matrices:
        new: dict[int, tuple[int, int]] = {}
        origin: dict[int, int] = {}
        for before, (cost, tie) in best.items():
            for after in range(4):
                c, t = flat[16 * before + 4 * after:16 * before + 4 * after + 2]
                if c >= 0 and (after not in new or (cost + c, tie + t) < new[after]):
                    new[after], origin[after] = (cost + c, tie + t), before
        best = new
        back.append(origin)
    cost, _, state = min((c + INSERT * len(CLOSING[s]), t, s) for s, (c, t) in best.items())
    states = [state]
    for origin in reversed(back):
        states.append(origin[states[-1]])
    return cost, states[::-1]


def path(begin: int, end: int, turns: list[tuple[int, int]]) -> list[Move]:
    """The cheapest moves from one state to another."""
    table = run_from(begin, turns)
    out: list[Move] = []
    state = end
    for (code, _), row in zip(reversed(turns), reversed(table)):
        _, before, number = row[state]
        out.append(MOVES[code][number])
        state = before
    return out[::-1]


def coded(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their role's code and hash; equal turns without a number are counted apart."""
    role = F.lower(F.trim("role"))
    for alias, name in ALIASES.items():
        role = F.when(role == alias, F.lit(name)).otherwise(role)
    code = F.lit(UNKNOWN)
    for number, name in enumerate(ROLES, SYSTEM):
        code = F.when(role == name, F.lit(number)).otherwise(code)
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    times = F.when(F.col("turn").isNull(), F.col("n")).otherwise(F.lit(1).cast("long"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("n")
    h = F.when(F.col("copy") > 1, F.xxhash64("conv_id", "turn", "role", "text", "copy")).otherwise(F.xxhash64("conv_id", "turn", "role", "text"))
    return rows.withColumn("code", code).withColumn("h", h).drop("copy")


SEGMENT = "conv_id {id}, part int, first long, n long, m array<long>"
BORDER = "first long, begin int, end int, closes boolean, seq0 long, turn0 long, cost long"
RESULT = "conv_id {id}, seq long, out_turn long, turn {turn}, source_role string, role string, action string, cost long, rendered string"


def _segments(rows: DataFrame, kind: str) -> DataFrame:
    target = arrow_schema(SEGMENT.format(id=kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, first = None, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": now[0], "part": now[1], "first": first, "n": len(turns), "m": matrix(turns)}], schema=target)

        for batch in batches:
            for conv, part, pos, code, h in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "pos", "code", "h"))):
                if now != (conv, part):
                    if turns:
                        yield done()
                    now, turns, first = (conv, part), [], pos
                turns.append((code, h))
        if turns:
            yield done()

    own = rows.select("conv_id", "part", "pos", "code", "h").repartition("part").sortWithinPartitions("part", "pos")
    return own.mapInArrow(run, SEGMENT.format(id=kind))


def _borders(segments: DataFrame) -> DataFrame:
    target = arrow_schema(BORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            cost, states = chained([s["m"] for s in held])
            out, seq, turn = [], 0, 0
            for k, s in enumerate(held):
                begin, end = states[k], states[k + 1]
                out.append({"first": s["first"], "begin": begin, "end": end, "closes": k + 1 == len(held), "seq0": seq, "turn0": turn, "cost": cost})
                at = 16 * begin + 4 * end
                seq, turn = seq + s["n"] + s["m"][at + 3], turn + s["m"][at + 2]
            return pa.RecordBatch.from_pylist(out, schema=target)

        for batch in batches:
            for s in batch.to_pylist():
                if held and held[0]["conv_id"] != s["conv_id"]:
                    yield done()
                    held = []
                held.append(s)
        if held:
            yield done()

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(run, BORDER)


def rendered(turns: list[dict], border: dict) -> list[dict]:
    """The output rows of a segment."""
    out: list[dict] = []
    seq, turn = border["seq0"], border["turn0"] - 1

    def add(role: int, text: str, action: str, source: dict | None, merged: bool) -> None:
        nonlocal seq, turn
        turn += not merged
        head = "\n" if merged else CLOSE_TURN * (turn > 0) + OPEN_TURN.format(role=ROLES[role - 1])
        out.append({"conv_id": turns[0]["conv_id"], "seq": seq, "out_turn": turn, "turn": source and source["turn"], "source_role": source and source["role"],
                    "role": ROLES[role - 1], "action": action, "cost": border["cost"], "rendered": head + text})
        seq += 1

    for source, (_, after, _, merged, inserted) in zip(turns, path(border["begin"], border["end"], [(t["code"], t["h"]) for t in turns])):
        for role in inserted:
            add(role, "", "insert", None, False)
        relabelled = source["code"] != after
        add(after, source["text"], ("merge+relabel" if relabelled else "merge") if merged else ("relabel" if relabelled else "keep"), source, merged)
    if border["closes"]:
        for role in CLOSING[border["end"]]:
            add(role, "", "insert", None, False)
        out[-1]["rendered"] += CLOSE_TURN
    return out


def repair(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """The repaired conversations, a row per turn or inserted turn, in order of ``seq`` within a conversation.

    ``out_turn`` numbers the repaired turns (rows of one number are merged), ``cost`` is the conversation's.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    kind, turn_kind = (conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    keys = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("h")]
    rows = coded(conversations).repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    rows = scratch.keep("turns", rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    borders = _borders(_segments(rows, kind))
    schema = RESULT.format(id=kind, turn=turn_kind)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        border: dict = {}
        ready: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["first"] is not None:  # the first turn of a segment carries its border
                    if held:
                        ready += rendered(held, border)
                    held, border = [], row
                    if len(ready) >= 1000:
                        yield pa.RecordBatch.from_pylist(ready, schema=target)
                        ready = []
                held.append(row)
        if held:
            ready += rendered(held, border)
        for k in range(0, len(ready), 1000):
            yield pa.RecordBatch.from_pylist(ready[k:k + 1000], schema=target)

    whole = rows.join(borders, F.col("pos") == F.col("first"), "left").repartition("part").sortWithinPartitions("part", "pos")
    return whole.mapInArrow(run, schema)
