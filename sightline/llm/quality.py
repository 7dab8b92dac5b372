"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled covariance and its diagonal. A document's
score comes from the difference of the two log densities: Mahalanobis distances by the inverses of Cholesky factors,
both computed once, log determinants and class shares.

The statistics of all documents are written once. Fitting needs counts, sums and sums of products of the labelled rows,
which Spark adds up; the driver sees matrices whose size does not depend on the data. Spark adds in any order, so a
score may differ in its last bits from run to run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

STATISTICS = ("word_bytes", "upper", "digit", "space", "newline", "shout", "bar", "symbol", "stop", "comma", "other_ascii", "distinct_words", "distinct_pairs", "same_as_last", "distinct_lines", "line_words")
N = len(STATISTICS)
PRIOR = 20
SHRINK_POOLED = 0.3
SHRINK_DIAGONAL = 0.1
BROADCAST_LABELS = 1_000_000


def _logit(x: float, n: float, usual: float) -> float:
    """Log odds of x in n, with PRIOR more counts at the usual share: short texts say little and stay near it."""
    return float(np.log((x + PRIOR * usual) / (n - x + PRIOR * (1 - usual))))


_SYMBOLS = b"#$%&*@^~<>{}[]\\=+_`/"
#: Bytes of a text above which words are counted as codes in arrays, not as objects.
LONG_TEXT = 100_000


def word_counts(raw: bytes) -> tuple[int, int, int, int]:
    """Words, distinct words, distinct pairs of neighbours, and words equal to the one before."""
    if len(raw) <= LONG_TEXT:
        words = raw.split()
        return len(words), len(set(words)), len(set(zip(words, words[1:]))), sum(map(bytes.__eq__, words, words[1:]))
    coded = pc.ascii_split_whitespace(pa.array([raw.decode()])).flatten().dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # white space at an end
        codes = codes[codes != blank]
    n = len(coded.dictionary)
    return len(codes), len(np.unique(codes)), len(np.unique(codes[:-1] * n + codes[1:])), int((codes[:-1] == codes[1:]).sum())


def line_counts(text: str) -> tuple[int, int]:
    """Lines and distinct lines."""
    if len(text) <= LONG_TEXT:
        lines = text.split("\n")
        return len(lines), len(set(lines))
    lines = pc.split_pattern(pa.array([text]), "\n").flatten()
    return len(lines), pc.count_distinct(lines).as_py()


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text."""
    raw = text.encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    w, distinct, pairs, same = word_counts(raw)
    upper, digit = int(counts[65:91].sum()), int(counts[48:58].sum())
    newline, space = int(counts[10]), int(counts[32])
    shout, bar, comma, stop = int(counts[33]), int(counts[124]), int(counts[44]), int(counts[46])
    symbol = int(counts[list(_SYMBOLS)].sum())
    letters = int(counts[97:123].sum()) + upper + int(counts[128:].sum())
    other = n - letters - digit - newline - space - shout - bar - comma - stop - symbol
    lines, distinct_lines = line_counts(text)
    return [
        float(np.log((n - space - newline + 5 * PRIOR) / (w + PRIOR))),
        _logit(upper, n, 0.02),
        _logit(digit, n, 0.002),
        _logit(space, n, 0.15),
        _logit(newline, n, 0.002),
        _logit(shout, n, 0.0005),
        _logit(bar, n, 0.0005),
        _logit(symbol, n, 0.0005),
        _logit(stop, n, 0.01),
        _logit(comma, n, 0.01),
        _logit(other, n, 0.001),
        _logit(distinct, max(w, 1), 0.8),
        _logit(pairs, max(w - 1, 1), 0.98),
        _logit(same, max(w - 1, 1), 0.01),
        _logit(distinct_lines, lines, 0.98),
        float(np.log((w + 20 * PRIOR) / (lines + PRIOR))),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the statistics of every row's whole text; null counts as empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInArrow(measure, f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors by class; counts (0, 0) leave a constant score."""

    counts: tuple[int, int]
    means: np.ndarray
    inverse_factors: np.ndarray
    log_dets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        n0, n1 = self.counts
        if not n0 or not n1:
            return np.full(len(x), (n1 + 1) / (n0 + n1 + 2))
        logs = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.inverse_factors[k].T
            logs.append(-0.5 * (z * z).sum(axis=1) - 0.5 * self.log_dets[k] + np.log(self.counts[k]))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame) -> Discriminant:
    """Fit on rows (x, label 0 or 1): all of them, by sums that Spark adds up."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + N + N * N))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, N)
            y = np.array(batch.column(1).to_pylist(), int)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.arange(sums.shape[1])
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(sums[k])], names=["label", "at", "value"])

    rows = labelled.select("x", "label").mapInArrow(moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()  # 2 * (1 + N + N * N) rows
    sums = np.zeros((2, 1 + N + N * N))
    for r in rows:
        sums[r["label"], r["at"]] = r["value"]
    counts = sums[:, 0]
    means = sums[:, 1 : 1 + N] / np.maximum(counts, 1)[:, None]
    scatter = sums[:, 1 + N :].reshape(2, N, N) - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / max(counts.sum() - 2, 1)
    inverse, dets = np.zeros((2, N, N)), np.zeros(2)
    for k in (0, 1):
        own = scatter[k] / max(counts[k] - 1, 1)
        own = (1 - SHRINK_POOLED) * own + SHRINK_POOLED * pooled
        own = (1 - SHRINK_DIAGONAL) * own + SHRINK_DIAGONAL * np.diag(np.diag(own)) + 1e-4 * np.eye(N)
        factor = np.linalg.cholesky(own)
        inverse[k] = np.linalg.inv(factor)
        dets[k] = 2 * np.log(np.diag(factor)).sum()
    return Discriminant((int(counts[0]), int(counts[1])), means, inverse, dets)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id leaves none and is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (probability of label 1), predicted (1 where score >= threshold).

    Learns from labelled rows whose crc32 of doc_id leaves a remainder other than 0 by 5; labels other than 0 and 1
    are passed over. Null and empty texts have the statistics of an empty text. Repeated rows count as often as they
    occur. Without labels of both classes every score is the smoothed share of label 1. Only doc_id and text of docs
    are read, doc_id to find the labels. An empty table gives an empty result.
    """
    stats = written(document_statistics(docs), "quality-statistics")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit(stats.join(broadcast_if_small(known, known.count(), BROADCAST_LABELS), "doc_id"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, N)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject; rows of one doc_id stay if any of them does.
    Rows without id stay; null and empty texts are judged as empty ones. An empty table stays empty."""
    scored = written(quality_scores(docs, labels, threshold), "quality-scores")
    good = scored.where("predicted = 1").select(F.col("doc_id").alias("__sightline_id")).distinct()
    bad = written(scored.where("predicted = 0").select(F.col("doc_id").alias("__sightline_id")).join(good, "__sightline_id", "left_anti").where(F.col("__sightline_id").isNotNull()).distinct(), "quality-rejects")
    return docs.join(broadcast_if_small(bad, bad.count(), BROADCAST_LABELS), docs["doc_id"] == F.col("__sightline_id"), "left_anti")
