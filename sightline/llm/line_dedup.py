"""Line dedup by content-defined chunks of lines, and by the runs of lines at their edges.

A line ends a chunk when a rolling hash over the hashes of the last WINDOW lines is divisible by DIVISOR, so that a
passage falls into the same chunks wherever it stands, but for those at its edges. Chunks of two lines or more that
occur more than once in the table are compared byte by byte; the first occurrence, by doc_id, stays.

Chunks alone miss what is repeated without filling one. So runs of neighbouring lines are compared next in the same way,
those within removed chunks aside: of two lines, and of a line with all blank lines up to each one beside it. Each
repeated passage of two lines or more is covered by such runs, and each run is such a passage.

Only hashes of chunks and runs are grouped at first. Texts of those whose hash repeats are grouped and joined next, so
texts that occur once are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

WINDOW = 2
DIVISOR = 2
LEAST_LINES = 2
BROADCAST_HASHES = 1_000_000
BROADCAST_BYTES = 32_000_000
#: Bytes of a hash and a place in a broadcast table, with room to spare.
FIRST_BYTES = 120
SALTS = 16
BATCH_CHARS = 8 << 20
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def chunks(text: str) -> list[list[str]]:
    """The lines of text, in chunks. The rolling hash drops the line that leaves the window and adds the new one."""
    import xxhash

    out, chunk, window, rolling = [], [], [], 0
    drop = pow(_BASE, WINDOW, 1 << 64)
    for line in text.split("\n"):
        h = xxhash.xxh3_64_intdigest(line.encode())
        window.append(h)
        rolling = (rolling * _BASE + h) & _MASK
        if len(window) > WINDOW:
            rolling = (rolling - window.pop(0) * drop) & _MASK
        chunk.append(line)
        if (rolling >> 32) % DIVISOR == 0:
            out.append(chunk)
            chunk = []
    return [*out, chunk] if chunk else out


def candidate(chunk: list[str]) -> bool:
    return len(chunk) >= LEAST_LINES and any(map(str.strip, chunk))


def chunk_pieces(text: str) -> Iterator[tuple]:
    """(number, text) of every chunk that may be removed."""
    return ((k, "\n".join(c)) for k, c in enumerate(chunks(text)) if candidate(c))


def run_pieces(text: str, gone: list[int] | None) -> Iterator[tuple]:
    """(first line, lines, encoded) of every run of lines that may be removed, but those within the chunks in gone.

    A run is a line that is not blank and the next, or the blank lines from it on up to any of them, on either side.
    Equal lines in a row are encoded as their count and one of them, so that blank stretches stay short.
    """
    lines, chunk_of, gone = [], [], set(gone or ())
    for k, c in enumerate(chunks(text)):
        lines += c
        chunk_of += [k] * len(c)
    for step, mark in ((1, ">"), (-1, "<")):
        start = None
        for i in range(len(lines))[::step]:
            line = lines[i]
            blank = not line.strip()
            if start is not None and (blank or (step == 1 and start == i - 1)):
                if line == last:
                    count += 1
                else:
                    closed, last, count = f"{closed}{count}\t{last}\n", line, 1
                low, high = min(start, i), max(start, i)
                if chunk_of[low] != chunk_of[high] or chunk_of[low] not in gone:
                    yield low, high - low + 1, f"{mark}{closed}{count}\t{last}"
            if not blank:
                start, closed, last, count = i, "", line, 1


def piece_rows(texts: DataFrame, pieces: Callable[..., Iterator[tuple]], names: list[str], with_text: bool) -> DataFrame:
    """doc_id, text_hash, names, hash and, if asked, chunk, of every piece; pieces gets the other columns of texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            id_type = whole.column(0).type

            def batch(rows: list[tuple]) -> pa.RecordBatch:
                types = [id_type, pa.int64(), *(pa.int32() for _ in names), pa.binary(), *[pa.string()] * with_text]
                columns = zip(*rows) if rows else [()] * len(types)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "text_hash", *names, "hash", *["chunk"] * with_text])

            for start in range(0, whole.num_rows, 500):
                rows, chars = [], 0
                for doc_id, text_hash, *rest in zip(*(c.to_pylist() for c in whole.slice(start, 500).columns)):
                    for *place, piece in pieces(*rest):
                        digest = xxhash.xxh3_128_digest(piece.encode())
                        rows.append((doc_id, text_hash, *place, digest, *[piece] * with_text))
                        chars += len(piece) * with_text
                        if chars > BATCH_CHARS or len(rows) > 50_000:
                            yield batch(rows)
                            rows, chars = [], 0
                yield batch(rows)

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(cut, f"doc_id {kind}, text_hash long, {''.join(f'{n} int, ' for n in names)}hash binary" + ", chunk string" * with_text)


def repeated_pieces(texts: DataFrame, pieces: Callable[..., Iterator[tuple]], names: list[str], label: str) -> DataFrame:
    """doc_id, text_hash, names and first (the first place of the same bytes) of pieces that stand elsewhere before."""
    repeated = written(piece_rows(texts, pieces, names, False).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), f"repeated-hashes-{label}")
    found = piece_rows(texts, pieces, names, True).join(broadcast_if_small(repeated, repeated.count(), BROADCAST_HASHES), "hash")
    found = written(found, f"repeated-{label}")
    place = F.struct("doc_id", "text_hash", names[0])
    texts_of = found.groupBy("hash", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n"))  # the byte comparison
    first = written(texts_of.groupBy("hash").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.max("n").alias("n")).where("n > 1"), f"first-{label}")
    later = ~place.eqNullSafe(F.col("first"))
    # a hash of one text needs no text any more; of others, texts are joined too
    n, n_many = first.agg(F.count("*"), F.count_if(F.col("texts") > 1)).first()
    one = first.where("texts = 1").select("hash", "first")
    slim = found.select("doc_id", "text_hash", *names, "hash")
    if n * FIRST_BYTES <= BROADCAST_BYTES:
        joined = slim.join(F.broadcast(one), "hash")
    else:  # a piece that stands everywhere is joined in SALTS tasks
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        joined = slim.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", names[0]), F.lit(SALTS))).join(one.withColumn("salt", salts), ["hash", "salt"])
    columns = ["doc_id", "text_hash", *names, "first"]
    out = joined.where(later).select(*columns)
    if n_many:
        mixed = found.join(first.where("texts > 1").select("hash"), "hash")
        own = mixed.groupBy("hash", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "chunk", "first")
        out = out.unionByName(mixed.join(own, ["hash", "chunk"]).where(later).select(*columns))
    return out


def with_gone(keyed: DataFrame, gone: DataFrame, number: str, alias: str) -> tuple[DataFrame, bool]:
    """keyed with the set of a document's numbers in gone as alias, and whether gone is small enough for a broadcast."""
    gone = gone.groupBy(F.col("doc_id").alias("__sightline_id"), F.col("text_hash").alias("__sightline_gone_hash")).agg(F.collect_set(number).alias(alias))
    gone = written(gone, "removed")
    n = gone.count()
    joined = keyed.join(broadcast_if_small(gone, n, BROADCAST_HASHES), keyed["doc_id"].eqNullSafe(F.col("__sightline_id")) & (F.col("__sightline_hash") == F.col("__sightline_gone_hash")), "left")
    return joined.drop("__sightline_id", "__sightline_gone_hash"), n <= BROADCAST_HASHES


def _marked(docs: DataFrame) -> tuple[DataFrame, bool]:
    keyed = docs.withColumn("__sightline_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = keyed.where(F.col("text").isNotNull()).select("doc_id", F.col("__sightline_hash").alias("text_hash"), "text")
    return with_gone(keyed, repeated_pieces(texts, chunk_pieces, ["chunk_no"], "chunks"), "chunk_no", "__sightline_gone")


def _cleaned(joined: DataFrame, columns: list[str]) -> DataFrame:
    @F.pandas_udf("text string, n_lines long, n_removed_lines long")
    def cleaned(text, gone, gone_lines):
        import pandas as pd

        rows = []
        for t, g, ls in zip(text, gone, gone_lines):
            if t is None:
                rows.append((None, 0, 0))
            elif g is None and ls is None:
                rows.append((t, t.count("\n") + 1, 0))
            else:
                all_, removed, single = chunks(t), set(() if g is None else g), set(() if ls is None else ls)
                lines = [(line, k) for k, c in enumerate(all_) for line in c]
                kept = [line for i, (line, k) in enumerate(lines) if k not in removed and i not in single]
                rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed_lines"])

    joined = joined.withColumn("__sightline_clean", cleaned("text", "__sightline_gone", "__sightline_lines"))
    return joined.select(*(F.col("__sightline_clean.text").alias("text") if c == "text" else F.col(c) for c in columns), "__sightline_clean.n_lines", "__sightline_clean.n_removed_lines")


def without_repeated_chunks(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with repeated chunks taken out of text, and n_lines and n_removed_lines.

    Null texts stay null and have no lines; an empty text has one. Chunks of white space alone stay. Rows that share
    doc_id and text are one document: what stays of it stays in each. Null ids come before all others. A chunk's lines
    are removed whole, with the line break after them. An empty table stays empty.
    """
    marked, _ = _marked(docs)
    return _cleaned(marked.withColumn("__sightline_lines", F.lit(None).cast("array<int>")), docs.columns)


def without_repeated_passages(docs: DataFrame) -> DataFrame:
    """without_repeated_chunks, and every other run of two lines or more, not all blank, that stands before is removed.

    Before is in a document of a smaller id, or further up in the same one without a line in common.
    """
    marked, small = _marked(docs)
    if not small:
        marked = written(marked, "marked-texts")  # else each of three passes would shuffle the texts
    texts = marked.where(F.col("text").isNotNull()).select("doc_id", F.col("__sightline_hash").alias("text_hash"), "text", "__sightline_gone")
    again = repeated_pieces(texts, run_pieces, ["line", "lines"], "runs")
    overlaps = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("line") < F.col("first.line") + F.col("lines"))
    again = again.where(~overlaps).select("doc_id", "text_hash", F.explode(F.expr("sequence(line, line + lines - 1)")).alias("line"))
    return _cleaned(with_gone(marked, again, "line", "__sightline_lines")[0], docs.columns)
