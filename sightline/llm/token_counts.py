"""Token counts by prefix dynamic programming.

For every document the operator stores one signed byte per code point: how the exact token count changes when that
code point joins the prefix. Any truncation or budget question is a sum or a search over these bytes; nothing is
encoded again.

Within a piece of text that the tokenizer never merges across, the last token of the encoding of every prefix is
found from the prefixes before it: token t ends the encoding of w[:i] when it may follow the last token of
w[:i - len(t)], and two tokens may follow each other when the library encodes their concatenation as just those two.
Pieces are cut before white space that follows something else, where the pre-tokenizer always cuts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The code points of Unicode's White_Space property.
UNICODE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: The tokenizer's contractions; a prefix of one is two pieces.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Bytes of all caches of a worker, and the longest string that they keep.
CACHE_BYTES = 240_000_000
LONGEST_KEPT = 64
SLICE_BYTES = 8_000_000


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Kept(dict):
    """A cache of short strings' results; it takes no more once what it holds comes to about `limit` bytes."""

    ENTRY = 200  # of a key, a value and their place, besides their characters

    def __init__(self, limit: int):
        super().__init__()
        self.left = limit

    def keep(self, key, n_chars: int, value) -> None:
        if n_chars <= LONGEST_KEPT and self.left > 0:
            self[key] = value
            self.left -= self.ENTRY + 2 * n_chars


class PrefixCounter:
    """Token count changes per code point of pieces of text; one per Python worker, with caches of cache_bytes in all."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.tails = {t[i:] for t in self.vocab for i in range(len(t))}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.follows, self.words, self.pieces = (Kept(cache_bytes // 3) for _ in range(3))
        self.letters = byte_letters()
        self.ascii = {b: self.letters[b] for b in range(128)}
        self.done = ("", [0], [""])

    def may_follow(self, a: str, b: str) -> bool:
        tokens = self.model.tokenize(a + b)
        known = len(tokens) == 2 and tokens[0].value == a
        self.follows.keep((a, b), len(a) + len(b), known)
        return known

    def prefix_counts(self, w: str) -> list[int]:
        """Token count of every prefix of w, which is in the byte-level alphabet and has no cut inside.

        The prefixes that w shares with the word before it are not computed again, so sorted words are cheap.
        """
        done, counts, last = self.done
        at = 0
        for x, y in zip(done, w):
            if x != y:
                break
            at += 1
        counts, last = counts[: at + 1], last[: at + 1]
        vocab, follows, tails = self.vocab, self.follows, self.tails
        for end in range(at + 1, len(w) + 1):
            start = end - 1
            while start and w[start - 1 : end] in tails:
                start -= 1
            for begin in range(start, end):
                t = w[begin:end]
                if t in vocab:
                    before = last[begin]
                    if not before:
                        break
                    ok = follows.get((before, t))
                    if ok or ok is None and self.may_follow(before, t):
                        break
            counts.append(counts[begin] + 1)
            last.append(t)
        self.done = (w, counts, last) if len(w) <= LONGEST_KEPT else ("", [0], [""])
        return counts

    def word(self, w: str) -> bytes:
        """Count changes per code point of one pre-token."""
        found = self.words.get(w)
        if found is None:
            if w.isascii():
                counts = self.prefix_counts(w.translate(self.ascii))
            else:
                counts = self.prefix_counts("".join(map(self.letters.__getitem__, w.encode())))
                ends = [0, *accumulate(len(c.encode()) for c in w)]
                counts = [counts[i] for i in ends]
            found = bytes([(y - x) & 255 for x, y in pairwise(counts)])
            self.words.keep(w, len(w), found)
        return found

    def piece(self, p: str) -> bytes:
        """Count changes per code point of a run of white space with what follows it up to the next white space."""
        found = self.pieces.get(p)
        if found is None:
            found = self.around_special(p) if self.special.search(p) else self.cut(p)
            self.pieces.keep(p, len(p), found)
        return found

    def cut(self, p: str) -> bytes:
        """Pre-token by pre-token; white space before the first counts as one pre-token as long as nothing follows."""
        if not p:
            return b""
        words = _LATIN.findall(p) if _LATIN_ONLY.fullmatch(p) else [p[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(p)]
        space = len(p) - len(p.lstrip(UNICODE_SPACE))
        out, first = b"", 0
        if 1 < space < len(p):
            # white space with nothing after it is one pre-token; with a word after it, it is cut before its last code point
            out, at, so_far = self.word(p[:space]), 0, 0
            while at + len(words[first]) <= space:
                at += len(words[first])
                so_far += total(self.word(words[first]))
                first += 1
            deltas = self.word(words[first])
            change = so_far + total(deltas[: space - at + 1]) - total(out)
            out, first = out + bytes([change & 255]) + deltas[space - at + 1 :], first + 1
        for w in words[first:]:
            deltas = self.word(w)
            if len(w) == 3 and w in CONTRACTIONS:
                deltas = bytes([1, 1, (total(deltas) - 2) & 255])
            out += deltas
        return out

    def around_special(self, p: str) -> bytes:
        """A piece that holds special strings, each one token: the library encodes what is between them apart.

        Until its last code point a special string is plain text after what is before it.
        """
        out, at = [], 0
        for m in self.special.finditer(p):
            open_ = self.cut(p[at : m.end() - 1])
            plain = m.start() - at
            out += [open_, bytes([(total(open_[:plain]) + 1 - total(open_)) & 255])]
            at = m.end()
        return b"".join([*out, self.cut(p[at:])])


_PIECES = re.compile(f"[{UNICODE_SPACE}]*[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+")
_TWO_SPACES = re.compile(f"[{UNICODE_SPACE}]{{2}}")
#: Text of ASCII and Latin-1 letters, and the tokenizer's pattern for it.
_LATIN_ONLY = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_LATIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
_counters: dict[str, PrefixCounter] = {}


def total(deltas: bytes) -> int:
    return sum(deltas) - 256 * sum(d > 127 for d in deltas)


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def text_pieces(text: str) -> list[str]:
    """Cut before white space that follows something else."""
    return _PIECES.findall(text)


def document_deltas(texts: pa.Array, count: PrefixCounter) -> list[np.ndarray]:
    """Count changes per code point, one int8 array a text; each distinct piece of the slice is counted once."""
    found: list[np.ndarray | None] = [None] * len(texts)
    strings = texts.to_pylist()
    odd = [i for i, t in enumerate(strings) if _TWO_SPACES.search(t)]
    for i in odd:
        found[i] = np.frombuffer(b"".join(map(count.piece, text_pieces(strings[i]))), np.int8)
    rest = np.setdiff1d(np.arange(len(texts)), odd)
    if len(rest):
        lists = pc.split_pattern(texts.take(pa.array(rest)), " ")
        sizes = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        codes, first = coded.indices.to_numpy().astype(np.int64), np.cumsum(sizes) - sizes
        distinct = coded.dictionary.to_pylist()
        parts: list[bytes] = [b""] * len(distinct)
        for k in np.argsort(np.array(distinct, object), kind="stable").tolist():
            parts[k] = count.piece(" " + distinct[k])
        heads = {c: count.piece(distinct[c]) if distinct[c] else b"" for c in set(codes[first].tolist())}
        head_code = {c: len(parts) + k for k, c in enumerate(heads)}
        parts += heads.values()
        codes[first] = [head_code[c] for c in codes[first].tolist()]
        width = np.fromiter(map(len, parts), np.int64, len(parts))
        pool, begins = np.frombuffer(b"".join(parts), np.int8), np.cumsum(width) - width
        spans = width[codes]
        ends = np.cumsum(spans)
        flat = pool[np.repeat(begins[codes] - (ends - spans), spans) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[np.cumsum(sizes)]
        for i, a, b in zip(rest.tolist(), np.concatenate([[0], stops[:-1]]).tolist(), stops.tolist()):
            found[i] = flat[a:b]
    return found


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about size bytes at most in a column of texts or lists of 8-byte values, one row at least."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    lengths = (8 * values.value_lengths().to_numpy() if pa.types.is_list(values.type) else pc.binary_length(values).to_numpy(zero_copy_only=False)).astype(np.int64)
    group = np.cumsum(lengths, dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in pairwise(edges):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def prefix_token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, fit_chars and prefix_deltas.

    prefix_deltas has one signed byte per code point; its running sum is the exact token count of every prefix, as the
    tokenizers library gives it without added tokens. fit_chars is the length of the longest prefix within limit
    tokens. Null text counts as empty: no bytes, no tokens. Repeated rows give repeated results, an empty table none; other columns of docs
    are not read. There is no shuffle, and a worker holds caches of CACHE_BYTES and one slice of a batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer_path)
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(1)
                deltas = document_deltas(texts, counts)
                totals = [int(d.sum(dtype=np.int64)) for d in deltas]
                fits = [longest_fit(d, limit) if n > limit else len(d) for d, n in zip(deltas, totals)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(totals, pa.int64()), pa.array(fits, pa.int64()), pa.array([d.tobytes() for d in deltas], pa.binary())],
                    names=["doc_id", "n_bytes", "n_tokens", "fit_chars", "prefix_deltas"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, fit_chars long, prefix_deltas binary")


def longest_fit(deltas: np.ndarray, limit: int) -> int:
    """Length of the longest prefix with at most limit tokens; counts may fall as a prefix grows, so all are looked at."""
    within = np.flatnonzero(np.cumsum(deltas, dtype=np.int64) <= limit)
    return int(within[-1]) + 1 if len(within) else 0


def tokens_at(deltas: bytes, n_chars: int) -> int:
    """Exact token count of the first n_chars code points."""
    return int(np.frombuffer(deltas, np.int8)[:n_chars].sum(dtype=np.int64))
