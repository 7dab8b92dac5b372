"""Language identification by string kernels.

The kernel of two texts is the mean, over n = 1 to 3, of the shared distinct byte n-grams over the geometric mean of
both texts' distinct n-grams: a blended-spectrum presence kernel. Nystrom landmarks stand for the training texts, and
one-versus-rest kernel ridge regression on the landmarks' feature map gives a weight per landmark and language. A batch
of texts is scored by one product of its n-gram presence with the landmarks' and one with the weights.

Training uses BUCKETS * PER_BUCKET distinct rows of each language at most, those with the smallest hashes in each bucket
of hashes, and LANDMARKS_PER_LANGUAGE of these as landmarks; rows that repeat count once. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, written
from .quality import held_out

BUCKETS = 64
PER_BUCKET = 8
BROADCAST_SAMPLE = 200_000
LANDMARKS_PER_LANGUAGE = 24
RIDGE = 1e-2
ORDERS = (1, 2, 3)
BATCH_ROWS = 256
#: ASCII but letters becomes space; other bytes stay.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_SPACES = re.compile(rb" +")


def grams(text: str) -> list[np.ndarray]:
    """Distinct byte n-grams as numbers, for each order; ASCII other than letters counts as one space."""
    raw = np.frombuffer(_SPACES.sub(b" ", text.lower().encode().translate(_LETTERS)), np.uint8).astype(np.int32)
    out = []
    for n in ORDERS:
        size = max(0, len(raw) - n + 1)
        code = np.zeros(size, np.int32)
        for i in range(n):
            code = (code << 8) | raw[i : i + size]
        out.append(np.unique(code))
    return out


@dataclass
class Landmarks:
    """For each order: all n-grams of the landmarks, sorted, and which landmark has which, divided by the root of its count."""

    vocab: list[np.ndarray]
    presence: list[np.ndarray]

    @classmethod
    def of(cls, sets: list[list[np.ndarray]]) -> Landmarks:
        vocab, presence = [], []
        for k in range(len(ORDERS)):
            all_ = np.unique(np.concatenate([s[k] for s in sets] or [np.zeros(0, np.int32)]))
            z = np.zeros((len(all_), len(sets)), np.float32)
            for j, s in enumerate(sets):
                z[np.searchsorted(all_, s[k]), j] = 1 / np.sqrt(max(len(s[k]), 1))
            vocab.append(all_)
            presence.append(z)
        return cls(vocab, presence)

    def kernel(self, sets: list[list[np.ndarray]]) -> np.ndarray:
        """Kernel of each text with each landmark."""
        total = np.zeros((len(sets), self.presence[0].shape[1]), np.float32)
        for k, (all_, z) in enumerate(zip(self.vocab, self.presence)):
            x = np.zeros((len(sets), len(all_)), np.float32)
            for i, s in enumerate(sets):
                if len(all_) and len(s[k]):
                    at = np.minimum(np.searchsorted(all_, s[k]), len(all_) - 1)
                    x[i, at[all_[at] == s[k]]] = 1 / np.sqrt(len(s[k]))
            total += x @ z
        return total / len(ORDERS)


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: und and 0 where it is null or has no letter or nothing was learned."""
        named = ["und"] * len(texts)
        score = np.zeros(len(texts))
        full = [i for i, t in enumerate(texts) if self.languages and t is not None and _LETTER.search(t)]
        for i in range(0, len(full), BATCH_ROWS):
            part = full[i : i + BATCH_ROWS]
            out = self.landmarks.kernel([grams(texts[j]) for j in part]) @ self.weights
            best = out.argmax(axis=1)
            score[part] = np.clip((out[np.arange(len(part)), best] + 1) / 2, 0, 1)
            for j, b in zip(part, best.tolist()):
                named[j] = self.languages[b]
        return named, score


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from docs' text and lang, in folds other than 2 of 4."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))
    known = known.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("lang").alias("learned")).withColumn("hash", F.xxhash64("doc_id", "text_hash"))
    in_bucket = Window.partitionBy("learned", F.pmod("hash", F.lit(BUCKETS))).orderBy("hash", "doc_id")
    picked = known.withColumn("rank", F.row_number().over(in_bucket)).where(F.col("rank") <= PER_BUCKET).drop("rank").distinct()
    # BUCKETS * PER_BUCKET rows a language from here on
    picked = picked.withColumn("rank", F.row_number().over(Window.partitionBy("learned").orderBy("hash", "doc_id")))
    picked = written(picked, "language-picked")
    keyed = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("text_hash")).join(broadcast_if_small(picked, picked.count(), BROADCAST_SAMPLE), ["doc_id", "text_hash"]).where(F.col("lang") == F.col("learned"))
    sample = keyed.groupBy("lang", "doc_id", "text_hash", "rank").agg(F.first("text").alias("text"))  # copies of a row become one before the shuffle
    sample = written(sample, "language-sample")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([s[k] for s in sets], pa.list_(pa.int32())) for k in range(len(ORDERS))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), *columns], names=["lang", "rank", "g1", "g2", "g3"])

    marks = sample.where(F.col("rank") <= LANDMARKS_PER_LANGUAGE).select("lang", "rank", "text")
    rows = marks.mapInArrow(gather, "lang string, rank int, g1 array<int>, g2 array<int>, g3 array<int>").collect()  # LANDMARKS_PER_LANGUAGE rows a language
    rows.sort(key=lambda r: (r["lang"], r["rank"]))
    sets = [[np.array(r[g], np.int32) for g in ("g1", "g2", "g3")] for r in rows]
    landmarks = Landmarks.of(sets)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(i, BATCH_ROWS)
                k = landmarks.kernel([grams(t.as_py()) for t in part.column("text")])
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("rank"), pa.array(list(k.astype(np.float64)), pa.list_(pa.float64()))], names=["lang", "rank", "k"])

    train = sample.select("lang", "rank", "text").mapInArrow(kernel, "lang string, rank int, k array<double>").collect()  # BUCKETS * PER_BUCKET rows a language
    train.sort(key=lambda r: (r["lang"], r["rank"]))
    languages = sorted({r["lang"] for r in train})
    if not sets or not train:
        return LanguageModel([], landmarks, np.zeros((0, 0)))
    values, vectors = np.linalg.eigh(landmarks.kernel(sets).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nystrom: kernel with the landmarks times this are features
    x = np.array([r["k"] for r in train]) @ root
    y = np.array([[1.0 if r["lang"] == name else -1.0 for name in languages] for r in train])
    per = y.shape[0] / len(languages) / np.maximum((y > 0).sum(axis=0), 1)
    weight = np.array([per[languages.index(r["lang"])] for r in train])[:, None]  # every language weighs the same
    solved = np.linalg.solve(x.T @ (weight * x) + RIDGE * np.eye(x.shape[1]), x.T @ (weight * y))
    return LanguageModel(languages, landmarks, (root @ solved).astype(np.float32))


def predicted_languages(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (0 to 1, half the regression's value plus a half).

    lang_pred is a language of the training rows, or und with score 0 where text is null or has no letter, or where no
    row can be learned from. doc_id and lang are read to choose training rows only. Repeated rows get equal results. An
    empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4 * BATCH_ROWS):
                part = batch.slice(i, 4 * BATCH_ROWS)
                named, score = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
