"""Conversation prefix trie: the distinct prefixes of conversations, with counts over their subtrees.

A stem is a prefix at which the work is dealt out. First every first turn is a stem. A stem with at most a bounded number
of turns below it goes to the bucket of its digest's hash, where applyInPandas builds the tries of the bucket's stems:
nodes are pointers (places in lists), a dictionary leads from a node and a turn's digest to the child, and one pass over
the nodes with children before their parents sums the subtrees. A larger stem stays open: it becomes a node of its own
and each of its next turns a new stem, again and again until all are small, so that a first turn that a third of all
conversations share spreads over the cluster. A large stem with one conversation is a chain and needs no trie. The open
nodes are then put together from their children, deepest first, a few bytes a child.

A node's list of ended conversations goes into one SHA-256, which nothing can split: ranges of ids are joined to pieces
of text in many tasks, and one task feeds a node's pieces to the digest in order, without holding them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Turns below a stem that is not split, at least; the limit grows so that no more than OPEN_STEMS stems are above it.
STEM_TURNS = 2_000
OPEN_STEMS = 500_000
#: Turns of a bucket on average, and the fewest buckets.
BUCKET_TURNS = 10_000
BUCKETS = 256
#: Characters of joined ids in a row.
PIECE_CHARS = 100_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_digest binary, parent_stem binary"
NOBODY = hashlib.sha256(b"").hexdigest()


def conversation_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos, digest, n_bytes, role, text: turns numbered from 1 in their conversation, by turn, null first, and by digest.

    digest is the SHA-256 of a turn's role and text, null being empty. Rows without conv_id are of no conversation.
    Turns are range-partitioned and counted by partition, so that a long conversation is not one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    t = t.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    t = written(t.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn").withColumn("at", F.monotonically_increasing_id()), "trie-turns").withColumn("part", F.shiftright("at", 33))
    spans = t.groupBy("conv_id", "part").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    spans = spans.select("conv_id", "part", "first_at", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    return t.join(spans, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first_at") + F.col("before") + 1).alias("pos"), "digest", "n_bytes", "role", "text")


def spliced(turns: DataFrame, every: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every conversation c continued from the start of conversation c - c % every.

    h = crc32 of c's decimal digits, modulo longest: the first h turns of the other conversation, or what there is of
    them, and then c's own turns after its first h. turns has conv_id, pos, digest, n_bytes; conversations has conv_id
    and n_turns, which may be 0. Conversations are those with a row in turns.
    """
    t = written(conversation_turns(turns).select("conv_id", "pos", "digest", "n_bytes"), "trie-numbered")
    sizes = t.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    c = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % longest)
    c = c.join(sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    c = written(c.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")), "trie-conversations")
    own = t.join(c.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n_bytes")
    start = t.where(F.col("pos") < longest).withColumnRenamed("conv_id", "base").join(c.select("conv_id", "base", "h"), "base").where("pos <= h")
    return written(own.unionByName(start.select("conv_id", "pos", "digest", "n_bytes")), "trie-spliced"), c.select("conv_id", "n_turns")


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes below a bucket's stems. A conversation's rows follow each other by place, the smallest conv_id first."""
    rows = rows.sort_values(["stem", "conv_id", "pos"], kind="stable")
    conv, depth, parent, n_bytes, n_convs, ends, digests, tops = [], [], [], [], [], [], [], []
    child: dict[tuple[int, bytes], int] = {}
    at = -1
    for c, pos, digest, size, n_turns, stem, top, parent_conv, parent_stem in zip(*(rows[k].tolist() for k in ("conv_id", "pos", "digest", "n_bytes", "n_turns", "stem", "top", "parent_conv", "parent_stem"))):
        first = pos == top
        key = (-1, bytes(stem)) if first else (at, bytes(digest))
        node = child.get(key)
        if node is None:
            node = child[key] = len(conv)
            conv.append(c)
            depth.append(pos)
            parent.append(-1 if first else at)
            n_bytes.append(size)
            n_convs.append(0)
            ends.append([])
            digests.append(digest)
            tops.append((parent_conv, parent_stem) if first else None)
        n_convs[node] += 1
        if pos == n_turns:
            ends[node].append(c)
        at = node
    n_children, leaves = [0] * len(conv), [0] * len(conv)
    saved = [(n - 1) * b for n, b in zip(n_convs, n_bytes)]
    for node in range(len(conv) - 1, -1, -1):  # a child always stands after its parent
        leaves[node] = leaves[node] or 1
        if (up := parent[node]) >= 0:
            n_children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    return pd.DataFrame(
        {
            "conv_id": conv, "depth": depth, "parent_conv_id": pd.array([t[0] if t else conv[p] for p, t in zip(parent, tops)], "Int64"), "n_convs": n_convs, "n_children": n_children, "n_leaves": leaves, "saved_tokens": saved,
            "ends_sha256": [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() if e else NOBODY for e in ends], "turn_digest": digests, "parent_stem": [t[1] if t else None for t in tops],
        }
    )


def ended_digests(ends: DataFrame) -> DataFrame:
    """stem, ends_sha256: the SHA-256 of each stem's conv_ids, ascending, in decimal, with commas between."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem, first, held, size = None, None, [], 0
        row = lambda: pa.RecordBatch.from_pydict({"stem": [stem], "first": [first], "piece": [",".join(held)]}, schema=pa.schema([("stem", pa.binary()), ("first", pa.int64()), ("piece", pa.string())]))
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (s != stem or size > PIECE_CHARS):
                    yield row()
                    held, size = [], 0
                if not held:
                    stem, first = s, c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield row()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem, sha = None, None
        row = lambda: pa.RecordBatch.from_pydict({"stem": [stem], "ends_sha256": [sha.hexdigest()]}, schema=pa.schema([("stem", pa.binary()), ("ends_sha256", pa.string())]))
        for batch in batches:
            for s, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if sha is not None and s == stem:
                    sha.update(b",")
                else:
                    if sha is not None:
                        yield row()
                    stem, sha = s, hashlib.sha256()
                sha.update(piece.encode())
        if sha is not None:
            yield row()

    joined = ends.repartitionByRange("stem", "conv_id").sortWithinPartitions("stem", "conv_id").select("stem", "conv_id").mapInArrow(pieces, "stem binary, first long, piece string")
    return joined.repartition("stem").sortWithinPartitions("stem", "first").mapInArrow(digests, "stem binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, stem_turns: int = STEM_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_digest.

    turns has conv_id, pos (from 1 without gaps), digest (binary, equal for equal turns) and n_bytes; convs has each
    conv_id once, with n_turns. A node is a distinct sequence of first turns; the root has none. conv_id is its
    smallest member's, parent_conv_id its parent's (null for the root), n_convs its members, n_leaves the childless
    nodes of its subtree, itself included, saved_tokens the sum over its subtree of (n_convs - 1) * n_bytes of a
    node's last turn, ends_sha256 the digest of the conv_ids that end there, and turn_digest its last turn's digest. A
    conversation without turns is a member of the root alone. No conversations give no rows.
    """
    convs = written(convs, "trie-lengths")
    limit = max(stem_turns, turns.count() // OPEN_STEMS)
    nobody = F.lit(b"")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(nobody.alias("stem"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent_stem"), F.lit(None).cast("long").alias("parent_conv"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("binary").alias("turn_digest"))
    opened = [written(root, "trie-open")]
    ends = convs.where("n_turns = 0").select(nobody.alias("stem"), "conv_id")
    open_rows = turns.join(convs, "conv_id").crossJoin(F.broadcast(opened[0].select("stem", F.col("conv_id").alias("stem_conv"))))  # the root's one row
    small, chains, depth = [], [], 0
    while True:
        depth += 1
        heads = open_rows.where(F.col("pos") == depth).select("conv_id", F.unhex(F.sha2(F.concat("stem", "digest"), 256)).alias("new_stem"))
        rows = open_rows.withColumnsRenamed({"stem": "parent_stem", "stem_conv": "parent_conv"}).join(heads, "conv_id").withColumnRenamed("new_stem", "stem").withColumn("top", F.lit(depth).cast("long"))
        rows = written(rows.select("conv_id", "pos", "digest", "n_bytes", "n_turns", "stem", "top", "parent_stem", "parent_conv"), "trie-rows")
        at_top = F.col("pos") == depth
        stems = rows.groupBy("stem").agg(
            F.count("*").alias("n_rows"), F.count_if(at_top).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("parent_stem").alias("parent_stem"), F.first("parent_conv").alias("parent_conv"), F.max(F.when(at_top, F.col("n_bytes"))).alias("n_bytes"), F.max(F.when(at_top, F.col("digest"))).alias("turn_digest"),
        )
        large = written(stems.where(F.col("n_rows") > limit), "trie-large")  # OPEN_STEMS rows at most
        mark = F.broadcast(large.select("stem", F.col("conv_id").alias("stem_conv"), (F.col("n_convs") > 1).alias("splits")))
        small.append(rows.join(mark, "stem", "left_anti"))
        marked = rows.join(mark, "stem")
        chains.append(marked.where("not splits"))
        split = large.where("n_convs > 1")
        if split.isEmpty():
            break
        opened.append(written(split.select("stem", F.lit(depth).cast("long").alias("depth"), "parent_stem", "parent_conv", "conv_id", "n_convs", "n_bytes", "turn_digest"), "trie-open"))
        going = marked.where("splits")
        ends = ends.unionByName(going.where((F.col("pos") == depth) & (F.col("n_turns") == depth)).select("stem", "conv_id"))
        open_rows = going.where(F.col("pos") > depth).select("conv_id", "pos", "digest", "n_bytes", "n_turns", "stem", "stem_conv")

    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    buckets = max(BUCKETS, turns.count() // BUCKET_TURNS)
    tries = union(small).withColumn("bucket", F.pmod(F.xxhash64("stem"), F.lit(buckets))).groupBy("bucket").applyInPandas(_tries, NODE)
    is_top, is_last = F.col("pos") == F.col("top"), F.col("pos") == F.col("n_turns")
    one = lambda n: F.lit(n).cast("long")
    chain = union(chains).select(
        "conv_id", F.col("pos").alias("depth"), F.when(is_top, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one(1).alias("n_convs"), F.when(is_last, one(0)).otherwise(one(1)).alias("n_children"), one(1).alias("n_leaves"), one(0).alias("saved_tokens"),
        F.when(is_last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOBODY)).alias("ends_sha256"), F.col("digest").alias("turn_digest"), F.when(is_top, F.col("parent_stem")).alias("parent_stem"),
    )
    nodes = written(tries.unionByName(chain), "trie-nodes")

    summed = [F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    tops = written(nodes.where("parent_stem is not null").groupBy(F.col("parent_stem").alias("stem")).agg(*summed), "trie-tops")
    ended = written(ended_digests(ends), "trie-ends")
    out, below = nodes, None
    for level in reversed(opened):
        kids = tops if below is None else tops.unionByName(below.groupBy(F.col("parent_stem").alias("stem")).agg(*summed))
        kids = kids.groupBy("stem").agg(*(F.sum(k).alias(k) for k in ("n_children", "n_leaves", "saved_tokens")))
        below = written(
            level.join(kids, "stem", "left").join(ended, "stem", "left").select(
                "conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", one(0)).alias("n_children"), F.coalesce("n_leaves", one(1)).alias("n_leaves"),
                (F.coalesce("saved_tokens", one(0)) + (F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"), "turn_digest", "parent_stem",
            ),
            "trie-opened",
        )
        out = out.unionByName(below)
    return out.drop("parent_stem")
