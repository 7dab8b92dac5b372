"""Best-fit packing of documents into sequences of a fixed number of tokens, by linear grouping.

The plan needs how many pieces there are of each length and nothing else: at most `capacity` numbers, whatever the
table holds. Large lengths are put in groups of equal cardinality and rounded up to the largest of their group. For the
few sizes left, configurations (how many pieces of each size one sequence takes) are optimised by column generation,
a linear programme whose whole parts are used. Actual pieces then take the places, so that what rounding up set aside
is free again. What is left, pieces of the programme's fractions and all small ones, goes best fit: the longest first,
each into the fullest sequence that still holds it. Sequences that are filled alike are one range of numbers in the
plan, so that the plan is a bounded table: pieces of a length, numbered from `first`, go `per_sequence` at a time to
the sequences from `sequence` on, at `offset`.

Spark encodes the texts, numbers the pieces of each length over all partitions, and looks each piece's number up in
the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, written
from .token_counts import slices
from .token_output import encode_texts, encoder

CAPACITY = 4096
#: Groups of large lengths at most.
GROUPS = 96
#: Lengths above capacity / share are large; the plan of the share that needs fewest sequences is taken.
SHARES = (3, 2, 4, 6)
#: Rounds of column generation a group; the plan is valid wherever they end.
PIVOTS = 40
BROADCAST_STARTS = 200_000
#: Bytes of text that are encoded together: each distinct word of them is looked up once.
SLICE_BYTES = 8_000_000


class Placing(NamedTuple):
    """Pieces first .. first + n - 1 of a length: piece first + i lies in sequence + i div per_sequence, and there at
    offset + (i mod per_sequence) * length."""

    length: int
    first: int
    n: int
    per_sequence: int
    sequence: int
    offset: int


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within capacity; a size may be taken any number of times."""
    worth = np.zeros(capacity + 1)
    takes: list[np.ndarray] = []
    for _ in range(capacity // int(sizes.min())):
        better, take = worth.copy(), np.full(capacity + 1, -1, np.int16)
        for k, (size, value) in enumerate(zip(sizes.tolist(), values.tolist())):
            if value <= 0:
                continue
            with_it = worth[:-size] + value
            more = with_it > better[size:] + 1e-12
            better[size:][more] = with_it[more]
            take[size:][more] = k
        if (take < 0).all():
            break
        takes.append(take)
        worth = better
    config, left = np.zeros(len(sizes)), capacity
    for take in reversed(takes):
        if (k := int(take[left])) >= 0:
            config[k] += 1
            left -= int(sizes[k])
    return float(config @ values), config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, so that their use is least and meets the demand: the simplex method
    with columns made as they are needed."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    used = demand / np.diag(basis)
    for _ in range(PIVOTS * m):
        worth, config = best_configuration(sizes, np.linalg.solve(basis.T, np.ones(m)), capacity)
        if worth <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, config)
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = config
        used = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(basis[:, j], used[j]) for j in range(m)]


def grouped(counts: dict[int, int], least: int, capacity: int, groups: int) -> list[list[list[int]]]:
    """Groups of about equal cardinality, the longest first: runs [length, first, n]. Groups of one largest length are one."""
    large = sorted(((s, n) for s, n in counts.items() if least < s < capacity), reverse=True)
    total = sum(n for _, n in large)
    k = max(1, min(groups, total))
    edges = [total * g // k for g in range(1, k + 1)]
    out: list[list[list[int]]] = []
    at, g, fresh = 0, 0, True
    for s, n in large:
        first = 0
        while first < n:
            take = min(n - first, edges[g] - at)
            if fresh and not (out and out[-1][0][0] == s):
                out.append([])
            fresh = False
            out[-1].append([s, first, take])
            first, at = first + take, at + take
            if at == edges[g]:
                g, fresh = g + 1, True
    return out


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[Placing], int]:
    """The placing of counts[length] pieces of each length, and the number of sequences. Depends on counts alone.

    What counts as large is tried out: with many small pieces few large ones need the programme, without any most do.
    """
    best, fewest = ([], 0), -(-sum(s * n for s, n in counts.items()) // capacity)
    for share in SHARES:
        plan = plan_above(counts, capacity // share, capacity, groups)
        if share == SHARES[0] or plan[1] < best[1]:
            best = plan
        if best[1] == fewest:
            break
    return best


def plan_above(counts: dict[int, int], least: int, capacity: int, groups: int) -> tuple[list[Placing], int]:
    """The plan in which lengths above least are large."""
    plan, sequences = [], 0
    free: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of sequences
    rooms = 0  # the rooms that free has, as bits

    def keep(room: int, start: int, n: int) -> None:
        nonlocal rooms
        if room > 0 and n > 0:
            free.setdefault(room, []).append((start, n))
            rooms |= 1 << room

    if whole := counts.get(capacity, 0):
        plan.append(Placing(capacity, 0, whole, 1, 0, 0))
        sequences = whole
    members = grouped(counts, least, capacity, groups)
    if members:
        sizes, demand = np.array([g[0][0] for g in members]), np.array([float(sum(r[2] for r in g)) for g in members])
        for config, used in configurations(sizes, demand, capacity):
            copies = int(np.floor(used + 1e-6))
            slots, cuts = [], {0, copies}
            for g in np.flatnonzero(config).tolist() if copies else []:
                for _ in range(int(round(config[g]))):
                    at, runs = 0, []
                    while at < copies and members[g]:
                        run = members[g][0]
                        n = min(run[2], copies - at)
                        runs.append((at, run[0], run[1]))
                        run[1], run[2], at = run[1] + n, run[2] - n, at + n
                        cuts.add(at)
                        if not run[2]:
                            members[g].pop(0)
                    cuts |= {r[0] for r in runs}
                    slots.append([*runs, (at, 0, 0)])
            edges = sorted(cuts)
            for a, b in zip(edges, edges[1:]):
                filled = 0
                for runs in slots:
                    while len(runs) > 1 and runs[1][0] <= a:
                        runs.pop(0)
                    begin, length, first = runs[0]
                    if length and begin <= a:
                        plan.append(Placing(length, first + a - begin, b - a, 1, sequences + a, filled))
                        filled += length
                keep(capacity - filled, sequences + a, b - a)
            sequences += copies
    left = [tuple(r) for g in members for r in g] + [(s, 0, n) for s, n in counts.items() if s <= least and n]
    for length, first, n in sorted(left, key=lambda r: (-r[0], r[1])):
        while n:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                start, many = free[room].pop()
                if not free[room]:
                    rooms &= ~(1 << room)
            else:
                room, start, many = capacity, sequences, -(-n // (capacity // length))
                sequences += many
            each = room // length
            whole = min(many, n // each)
            if whole:
                plan.append(Placing(length, first, whole * each, each, start, capacity - room))
                keep(room - each * length, start, whole)
                first, n = first + whole * each, n - whole * each
            if whole < many and n:
                plan.append(Placing(length, first, n, n, start + whole, capacity - room))
                keep(room - n * length, start + whole, 1)
                whole, n = whole + 1, 0
            keep(room, start + whole, many - whole)
    return plan, sequences


class Packing(NamedTuple):
    """pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset, part, row. ids: part, row, ids, where ids are
    little-endian unsigned integers of id_bytes bytes. sequences: how many there are."""

    pieces: DataFrame
    ids: DataFrame
    id_bytes: int
    sequences: int


def packed_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> Packing:
    """Every row of docs as token ids with end_id after them, in pieces of at most capacity ids, placed in sequences.

    Only a document of more ids is cut, into pieces of capacity ids of which the last may be shorter. Null text counts
    as empty and is the end id alone. Rows that repeat, or have no doc_id, are documents of their own. A sequence has
    at most capacity ids, without gaps. An empty table gives empty results; other columns of docs are not read.
    """
    spark = docs.sparkSession
    words = encoder(tokenizer_path)
    id_bytes = 2 if max(words.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    kind = pa.schema([(k, pa.int64()) for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "row", "place")] + [("ids", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, row, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                ids, lengths = encode_texts(batch.column(1), words, end_id)
                many = -(-lengths // capacity)
                doc = np.repeat(np.arange(len(lengths)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(lengths[doc] - start, capacity)
                ends = np.cumsum(length)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist())]
                by_length = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=capacity + 1)
                place = np.empty(len(length), np.int64)
                place[by_length] = np.arange(len(length)) - (np.cumsum(counts) - counts)[length[by_length]] + seen[length[by_length]]
                seen += counts
                offsets = (np.concatenate([[0], ends]) * id_bytes).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype(f"<u{id_bytes}").tobytes())])
                ints = [batch.column(0).take(pa.array(doc)), piece, start, length, np.array(crc, np.int64), np.full(len(doc), part), row + np.arange(len(doc)), place]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in ints), packed], schema=kind)
                row += len(doc)

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = written(read.mapInArrow(pieces, "doc_id long, piece long, start long, length long, ids_crc32 long, part long, row long, place long, ids binary"), "packing-pieces")

    counts = written(made.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan, sequences = packing_plan(lengths, capacity)
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    table = np.array(sorted(plan), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)  # its size hangs on capacity and groups, not on the documents

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = (t[:, 0] << 44) | t[:, 1]
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(7).to_numpy()
            at = t[np.searchsorted(keys, (length << 44) | number, side="right") - 1]
            i = number - at[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at[:, 4] + i // at[:, 3]), pa.array(at[:, 5] + i % at[:, 3] * length), *batch.columns[5:7]], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part", "row"])

    slim = made.drop("ids").join(broadcast_if_small(before, counts.count(), BROADCAST_STARTS), ["part", "length"])
    slim = slim.select("doc_id", "piece", "start", "length", "ids_crc32", "part", "row", (F.col("place") + F.col("before")).alias("number"))
    out = slim.mapInArrow(placed, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long, part long, row long")
    return Packing(out, made.select("part", "row", "ids"), id_bytes, sequences)


def packed_sequences(packing: Packing) -> DataFrame:
    """sequence_id, n_tokens, ids (binary, as in packing.ids), doc_ids, lengths: the sequences themselves, their pieces in order of offset."""
    both = packing.pieces.join(packing.ids, ["part", "row"])
    lists = both.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("pieces"))  # a sequence holds capacity ids at most
    joined = F.aggregate("pieces", F.lit(b""), lambda x, p: F.concat(x, p["ids"]))
    return lists.select("sequence_id", F.aggregate("pieces", F.lit(0).cast("long"), lambda x, p: x + p["length"]).alias("n_tokens"), joined.alias("ids"), F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.length").alias("lengths"))
