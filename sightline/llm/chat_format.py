"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant messages in turn, the assistant's last.
Each turn either starts a message or joins the one before it, with its own role or another, after empty messages where
needed. Dynamic programming over the automaton's states finds the cheapest way for the whole conversation.

Turns are range-partitioned and sorted by conversation and turn, so a very long conversation spreads over partitions.
A partition holds segments of conversations. Costs compose: of a segment that may go on in another partition, all
cheapest paths from each entry state to each exit state are kept, a byte a turn each, and a matrix of their costs. Only
the first and last segment of a partition are of that kind; the driver chains these, two rows a partition, and their
turns take the path between the states it found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MERGE, INSERT, RELABEL = 1, 2, 3
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
AFTER = {"system": AFTER_SYSTEM, "user": AFTER_USER, "assistant": AFTER_ASSISTANT}
#: Which roles may follow a state.
FOLLOWS = {START: ("system", "user"), AFTER_SYSTEM: ("user",), AFTER_USER: ("assistant",), AFTER_ASSISTANT: ("user",)}
NEVER = 1 << 40
#: An action: the role that a turn takes, whether it joins the message before it, and the empty messages before it.
ACTIONS = [(role, joins, empty) for joins, empty, role in product((False, True), ((), ("user",), ("assistant",)), ROLES) if not (joins and empty)]
END_COST = {START: 0, AFTER_SYSTEM: 2 * INSERT, AFTER_USER: INSERT, AFTER_ASSISTANT: 0}
END_EMPTY = {START: (), AFTER_SYSTEM: ("user", "assistant"), AFTER_USER: ("assistant",), AFTER_ASSISTANT: ()}
OPEN, CLOSE, JOIN = "<|{}|>\n", "\n<|end|>\n", "\n\n"


def normal_role(role: str | None) -> str:
    name = (role or "").strip().lower()
    return ALIASES.get(name, name)


def _steps(role: str) -> list[dict[int, tuple[int, int]]]:
    """For a turn of this role, by state: next state -> (cost, action), the cheapest and of these the first action."""
    steps: list[dict[int, tuple[int, int]]] = []
    for state in range(4):
        best: dict[int, tuple[int, int]] = {}
        for k, (taken, joins, empty) in enumerate(ACTIONS):
            at = state
            for e in empty:
                if e not in FOLLOWS[at]:
                    break
                at = AFTER[e]
            else:
                legal = AFTER[taken] == at if joins else taken in FOLLOWS[at]
                cost = MERGE * joins + INSERT * len(empty) + RELABEL * (taken != role)
                if legal and (cost, k) < best.get(AFTER[taken], (NEVER, 0)):
                    best[AFTER[taken]] = (cost, k)
        steps.append(best)
    return steps


STEPS = {r: _steps(r) for r in (*ROLES, "")}


def segment_paths(roles: list[str], entry: int) -> tuple[list[int], list[bytes]]:
    """Cheapest cost from an entry state to each exit state, and that path's actions."""
    cost, back = {entry: 0}, []
    for role in roles:
        steps = STEPS.get(role, STEPS[""])
        new: dict[int, tuple[int, int, int]] = {}
        for state, so_far in cost.items():
            for to, (c, action) in steps[state].items():
                if (so_far + c, action, state) < new.get(to, (NEVER, 0, 0)):
                    new[to] = (so_far + c, action, state)
        back.append(new)
        cost = {to: x[0] for to, x in new.items()}
    paths = []
    for exit_ in range(4):
        path, state = bytearray(len(roles)), exit_
        if exit_ in cost:
            for i in range(len(roles) - 1, -1, -1):
                _, path[i], state = back[i][state]
        paths.append(bytes(path))
    return [cost.get(s, NEVER) for s in range(4)], paths


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows of one conversation in a sorted partition."""
    run: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if run and run[0][0] != row[0]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def repaired_turns(turns: DataFrame) -> DataFrame:
    """One row per row of turns: conv_id, turn, role, new_role, action, empty_before, empty_after, cost, piece.

    action is keep, merge, relabel or relabel+merge. empty_before lists the empty messages put in before the turn,
    empty_after those after a conversation's last. cost is the whole conversation's, on its last turn, else null.
    piece is the turn's part of the rendered conversation: the pieces of a conversation, ordered by turn, role, hash of the
    text (xxhash64) and text, make it up. Turns are ordered so too, null numbers and roles first. Roles are compared in lower case without
    white space around; null and unknown roles need a relabel. Null text counts as empty, and a turn with empty text is
    kept. Rows without conv_id are one conversation. Repeated rows are turns of their own. An empty table
    gives an empty result.
    """
    conv, turn = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    order = ["conv_id", "turn", "role", "tie"]
    sorted_ = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text").select("conv_id", "turn", "role", "text")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, no = TaskContext.get().partitionId(), None, 0

        def out(run: list[tuple], edge: bool) -> pa.RecordBatch:
            roles, n = [normal_role(r[2]) for r in run], len(run)
            found = [segment_paths(roles, e) for e in (range(4) if edge else (START,))]
            costs = [c for cost, _ in found for c in cost]
            if edge:
                paths = [bytes(p[i] for _, ps in found for p in ps) for i in range(n)]
            else:
                exit_ = min(range(4), key=lambda s: (costs[s] + END_COST[s], s))
                paths = [bytes([a]) for a in found[0][1][exit_]]
                costs = [costs[exit_] + END_COST[exit_], exit_]
            return pa.RecordBatch.from_pydict(
                {"part": [part] * n, "segment": [no] * n, "seq": list(range(n)), "first": [i == 0 for i in range(n)], "last": [i == n - 1 for i in range(n)], "edge": [edge] * n, "paths": paths, "costs": [None] * (n - 1) + [costs]}
                | {k: [r[j] for r in run] for j, k in enumerate(("conv_id", "turn", "role", "text"))},
                schema=schema,
            )

        schema = None
        for batch_schema, run in _with_schema(batches):
            if schema is None:
                schema = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("seq", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("edge", pa.bool_()), ("paths", pa.binary()), ("costs", pa.list_(pa.int64())), *((f.name, f.type) for f in batch_schema)])
            if held is not None:
                yield out(held, no == 0)
                no += 1
            held = run
        if held is not None:
            yield out(held, True)

    solved = written(sorted_.mapInArrow(solve, f"part long, segment long, seq long, first boolean, last boolean, edge boolean, paths binary, costs array<long>, conv_id {conv}, turn {turn}, role string, text string"), "chat-segments")
    edges = solved.where("edge and last").select("part", "segment", "conv_id", "costs").collect()  # two rows a partition
    plan = F.broadcast(turns.sparkSession.createDataFrame(chained(sorted(edges, key=lambda r: (r["part"], r["segment"]))), "part long, segment long, path int, starts boolean, ends boolean, end_state int, total long"))

    joined = solved.join(plan, ["part", "segment"], "left")
    inner = ~F.col("edge")
    action = F.conv(F.hex(F.substring("paths", F.when(inner, F.lit(1)).otherwise(F.col("path") + 1), F.lit(1))), 16, 10).cast("int")
    starts, ends = F.col("first") & (inner | F.col("starts")), F.col("last") & (inner | F.col("ends"))
    end_state = F.when(inner, F.element_at("costs", 2).cast("int")).otherwise(F.col("end_state"))
    table = F.array(*(F.struct(F.lit(role).alias("role"), F.lit(joins).alias("joins"), F.array(*map(F.lit, empty)).cast("array<string>").alias("empty")) for role, joins, empty in ACTIONS))
    tails = F.array(*(F.array(*map(F.lit, END_EMPTY[s])).cast("array<string>") for s in range(4)))
    joined = joined.withColumn("act", F.element_at(table, action + 1)).withColumn("starts_now", starts).withColumn("ends_now", ends)
    joined = joined.withColumn("empty_after", F.when(F.col("ends_now"), F.element_at(tails, end_state + 1)).otherwise(F.array().cast("array<string>")))
    known = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    role = F.coalesce(F.try_element_at(known, role), role)

    def message(name, text):
        return F.concat(F.lit("<|"), name, F.lit("|>\n"), text)

    empties = F.array_join(F.transform("act.empty", lambda r: F.concat(message(r, F.lit("")), F.lit(CLOSE))), "")
    close_last = F.when(F.col("starts_now"), F.lit("")).otherwise(F.lit(CLOSE))
    piece = F.when(F.col("act.joins"), F.concat(F.lit(JOIN), F.col("text"))).otherwise(F.concat(close_last, empties, message(F.col("act.role"), F.col("text"))))
    after = F.array_join(F.transform("empty_after", lambda r: F.concat(message(r, F.lit("")), F.lit(CLOSE))), "")
    relabels = F.when(F.col("act.role") != role, F.lit("relabel"))
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.col("act.role").alias("new_role"),
        F.coalesce(F.nullif(F.concat_ws("+", relabels, F.when(F.col("act.joins"), F.lit("merge"))), F.lit("")), F.lit("keep")).alias("action"),
        F.array_join("act.empty", ",").alias("empty_before"),
        F.array_join("empty_after", ",").alias("empty_after"),
        F.when(F.col("ends_now"), F.when(inner, F.element_at("costs", 1)).otherwise(F.col("total"))).alias("cost"),
        F.concat(piece, F.when(F.col("ends_now"), F.concat(F.lit(CLOSE), after)).otherwise(F.lit(""))).alias("piece"),
    )


def _with_schema(batches: Iterator[pa.RecordBatch]):
    """Segments with the schema of the rows they come from."""
    seen = []

    def noted():
        for b in batches:
            seen[:] = [b.schema]
            yield b

    for run in _segments(noted()):
        yield seen[0], run


def chained(edges: list) -> list[tuple]:
    """part, segment, path, starts, ends, end_state, total for each edge segment: conversations that go on from a partition's end."""
    out, i = [], 0
    while i < len(edges):
        j = i + 1
        while j < len(edges) and edges[j]["conv_id"] == edges[i]["conv_id"] and edges[j]["part"] != edges[j - 1]["part"]:
            j += 1
        costs, back = {START: 0}, []
        for e in edges[i:j]:
            new: dict[int, tuple[int, int]] = {}
            for state, c in costs.items():
                for to in range(4):
                    step = e["costs"][4 * state + to]
                    if step < NEVER and (c + step, state) < new.get(to, (NEVER, 0)):
                        new[to] = (c + step, state)
            back.append(new)
            costs = {to: x[0] for to, x in new.items()}
        state = end = min(costs, key=lambda s: (costs[s] + END_COST[s], s))
        total, rows = costs[end] + END_COST[end], []
        for k in range(j - i - 1, -1, -1):
            before = back[k][state][1]
            e = edges[i + k]
            rows.append((e["part"], e["segment"], 4 * before + state, k == 0, k == j - i - 1, end, total))
            state = before
        out += rows[::-1]
        i = j
    return out
