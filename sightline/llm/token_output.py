"""Token-ID output: Simple-8b words in Parquet pages, in ascending doc_id order.

A page holds the ids of consecutive documents as one stream. The stream is cut into blocks of BLOCK_IDS ids; each block
is a sequence of 64-bit little-endian words, and block_words has every block's first word, so that all blocks of a page
are decoded side by side in numpy. A word is 4 bits of selector over 60 bits of ids. SELECTORS says how many ids of how
many bits a selector holds; selector 0 is the escape: the whole next word is one id.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, written
from .token_counts import Kept, byte_letters, slices

#: Fixed values of the format: ids and bits of each for selectors 2 to 15.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 0
BLOCK_IDS = 256
PAGE_BYTES = 2_000_000
CACHE_BYTES = 48_000_000
BROADCAST_PAGES = 500_000
PAGE_SCHEMA = "shard long, page long, n_ids long, doc_ids array<long>, doc_lengths array<long>, block_words array<int>, payload binary"


def _lock_steps(ids: np.ndarray, step) -> None:
    """step(positions, blocks, turn) for the next word of every block that has ids left, until none has; it returns the ids taken."""
    blocks = np.arange(-(-len(ids) // BLOCK_IDS))
    at = blocks * BLOCK_IDS
    end = np.minimum(at + BLOCK_IDS, len(ids))
    turn = 0
    while len(blocks):
        at = at + step(at, blocks, turn)
        left = at < end
        at, end, blocks, turn = at[left], end[left], blocks[left], turn + 1


def encode_ids(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words as bytes, and the first word of each block. ids: unsigned 64-bit."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n, n_blocks = len(ids), -(-len(ids) // BLOCK_IDS)
    if not n:
        return b"", np.zeros(0, np.int32)
    bits = np.zeros(n_blocks * BLOCK_IDS, np.uint8)
    bits[:n] = np.maximum(np.frexp(ids.astype(np.float64))[1], 1)  # one too many at worst, for ids of over 53 bits
    # the widest of the next c ids, not looking beyond the block; beyond the last id nothing needs bits
    grid = bits.reshape(n_blocks, BLOCK_IDS)
    choice = np.zeros(grid.shape, np.uint8)  # the escape, unless an id fits
    by_count = {c: (b, k) for k, (c, b) in enumerate(SELECTORS, 2)}
    choice[grid <= by_count[1][0]] = by_count[1][1]
    top = grid.copy()
    for c in range(2, 61):  # more ids a word are better
        top[:, : BLOCK_IDS - c + 1] = np.maximum(top[:, : BLOCK_IDS - c + 1], grid[:, c - 1 :])
        top[:, BLOCK_IDS - c + 1 :] = 255  # a word with c ids would cross the block's end
        if c in by_count:
            choice[top <= by_count[c][0]] = by_count[c][1]
        if c > 8 and (top > 60 // c + 1).all():
            break
    choice = choice.reshape(-1)
    takes = np.array([1, 1, *(c for c, _ in SELECTORS)], np.int64)
    padded = np.concatenate([ids, np.zeros(64, np.uint64)])
    turns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def step(at: np.ndarray, blocks: np.ndarray, turn: int) -> np.ndarray:
        chosen = choice[at]
        turns.append((blocks, at, chosen))
        return takes[chosen]

    _lock_steps(ids, step)
    words_of = np.zeros(n_blocks, np.int64)
    for blocks, _, chosen in turns:
        words_of[blocks] += 1 + (chosen == ESCAPE)
    first = np.cumsum(words_of) - words_of
    out, place = np.zeros(int(words_of.sum()), np.uint64), first.copy()
    for blocks, at, chosen in turns:
        for k in np.flatnonzero(np.bincount(chosen)).tolist():
            mine = chosen == k
            where, begin = place[blocks[mine]], at[mine]
            if k == ESCAPE:
                out[where + 1] = padded[begin]
                place[blocks[mine]] += 2
                continue
            c, b = SELECTORS[k - 2]
            word = np.full(len(begin), k, np.uint64) << np.uint64(60)
            for i in range(c):
                word |= padded[begin + i] << np.uint64(i * b)
            out[where] = word
            place[blocks[mine]] += 1
    return out.astype("<u8").tobytes(), first.astype(np.int32)


def decode_ids(payload: bytes, block_words: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of a page, all blocks side by side."""
    words = np.concatenate([np.frombuffer(payload, "<u8").astype(np.uint64), np.zeros(1, np.uint64)])
    out, place = np.zeros(n_ids + 64, np.uint64), np.array(block_words, np.int64)  # the last word may reach beyond the end
    takes = np.array([1, 1, *(c for c, _ in SELECTORS)], np.int64)

    def step(at: np.ndarray, blocks: np.ndarray, turn: int) -> np.ndarray:
        here = place[blocks]
        word = words[here]
        chosen = (word >> np.uint64(60)).astype(np.int64)
        for k in np.flatnonzero(np.bincount(chosen)).tolist():
            mine = chosen == k
            if k == ESCAPE:
                out[at[mine]] = words[here[mine] + 1]
                continue
            c, b = SELECTORS[k - 2]
            mask = np.uint64((1 << b) - 1)
            for i in range(c):
                out[at[mine] + i] = (word[mine] >> np.uint64(i * b)) & mask
        place[blocks] += 1 + (chosen == ESCAPE)
        return takes[chosen]

    _lock_steps(out[:n_ids], step)
    return out[:n_ids]


class WordEncoder:
    """Ids of words between white space, which the tokenizer drops; caches of CACHE_BYTES in each Python worker.

    A word of ASCII and Latin-1 letters is cut into pre-tokens here and the library's model encodes each new one; any
    other word, and any with a special string, goes through the whole library. The equality of both ways is tested. A
    word of ASCII letters alone is one pre-token and kept as such.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.pieces = Kept(cache_bytes // 2), Kept(cache_bytes // 2)
        self.letters = byte_letters()

    def piece(self, p: str) -> bytes:
        found = self.pieces.get(p)
        if found is None:
            mapped = p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode()))
            found = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            self.pieces.keep(p, len(p), found)
        return found

    def word(self, w: str) -> bytes:
        if w.isalpha() and w.isascii():
            return self.piece(w.lower())
        found = self.words.get(w)
        if found is None:
            if _LATIN_ONLY.fullmatch(w) and "<|" not in w:
                found = b"".join(map(self.piece, _LATIN.findall(w.lower())))
            else:
                found = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            self.words.keep(w, len(w), found)
        return found


#: Text without white space, of ASCII and Latin-1 letters, and the tokenizer's pattern for it.
_LATIN_ONLY = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
_LATIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_texts(texts: pa.Array, words: WordEncoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and each text's number of ids with its end id. A distinct word of the slice is looked up once."""
    lists = pc.ascii_split_whitespace(texts)
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    parts = [*map(words.word, coded.dictionary.to_pylist())] + [np.array([end_id], "<u4").tobytes()]
    width = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    pool, begins = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(width) - width
    stops = np.cumsum(sizes)
    codes = np.insert(coded.indices.to_numpy().astype(np.int64), stops, len(parts) - 1)
    spans = width[codes]
    ends = np.cumsum(spans)
    flat = pool[np.repeat(begins[codes] - (ends - spans), spans) + np.arange(int(ends[-1]) if len(ends) else 0)]
    lengths = np.diff(ends[stops + np.arange(len(stops))], prepend=0)
    return flat, lengths


def write_token_pages(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append end_id, and write pages of Simple-8b words to the shared folder; returns the written pages.

    Shards are ranges of doc_id and a page's shard and number give its place, so the pages in that order have ascending
    doc_id, which is a number and kept as long. Null ids come first; rows of one id are in the order of their texts' hashes. Null text counts as empty and has the end id alone.
    A text is never split between pages: a page has about PAGE_BYTES of text, or one longer text. An empty table gives no
    pages, and these no documents.
    """

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, page = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, PAGE_BYTES):
                ids, lengths = encode_texts(batch.column(1), words, end_id)
                payload, block_words = encode_ids(ids)
                yield pa.RecordBatch.from_pydict(
                    {"shard": [shard], "page": [page], "n_ids": [len(ids)], "doc_ids": [batch.column(0).to_pylist()], "doc_lengths": [lengths], "block_words": [block_words], "payload": [payload]},
                    schema=pa.schema([("shard", pa.int64()), ("page", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("block_words", pa.list_(pa.int32())), ("payload", pa.binary())]),
                )
                page += 1

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return written(ordered.mapInArrow(pages, PAGE_SCHEMA), "token-pages")


def read_token_pages(pages: DataFrame) -> DataFrame:
    """One row per document from written pages: doc_id, start, n_tokens, ids_crc32, and ids as little-endian 32-bit bytes.

    start counts the ids of all documents before this one. Shards are summed first, so the running sums are over one row
    a shard and over one shard's pages.
    """
    counts = pages.select("shard", "page", "n_ids")
    before_shard = counts.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("shard_start"))
    starts = counts.withColumn("before", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("page")) - F.col("n_ids")).join(before_shard, "shard").select("shard", "page", (F.col("before") + F.col("shard_start")).alias("page_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_ids(row["payload"], np.array(row["block_words"], np.int64), row["n_ids"]).astype("<u4")
                edges = [0, *np.cumsum(row["doc_lengths"]).tolist()]
                parts = [ids[a:b].tobytes() for a, b in pairwise(edges)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["page_start"] + a for a in edges[:-1]], pa.int64()), pa.array(row["doc_lengths"], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return pages.join(broadcast_if_small(starts, pages.count(), BROADCAST_PAGES), ["shard", "page"]).select("page_start", "n_ids", "doc_ids", "doc_lengths", "block_words", "payload").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
