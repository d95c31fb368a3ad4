"""Document quality by ordinal regression: one set of text weights, ordered thresholds between grades.

P(grade >= k) = logistic(w x - t_k) with t_1 <= t_2 <= ...  x are hashed words of the whole text (counts
damped by a logarithm, scaled to length one) and a few measures of its form.  Weights and thresholds are fitted
together by gradient steps on the likelihood of graded documents.  The expected grade is the sum of the tail
probabilities; documents are selected by one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import byte_chunks, held_out, kept, sampled
from tidepanel.llm.hashing import word_bounds, word_hashes

#: Hashed words share so many weights; a power of two.
BUCKETS = 1 << 14
#: At most so many graded documents are learnt from.
TRAIN_DOCS = 4000
ROUNDS, RATE, PENALTY = 300, 0.3, 1e-4
SHAPES = 10


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: the buckets of its words with their values, then ``SHAPES`` measures of form as further buckets."""
    for _, raw, offsets in byte_chunks(column):
        starts, ends, counts = word_bounds(raw, offsets)
        hashes = word_hashes(raw, starts, ends)
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        last = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        first = raw[starts] if len(starts) else np.zeros(0, np.uint8)
        symbol = ((last < 48) | ((last > 57) & (last < 65)) | ((last > 90) & (last < 97)) | ((last > 122) & (last < 128))) & ~np.isin(last, np.frombuffer(b".,;:?)", np.uint8))
        upper = (first >= 65) & (first <= 90)
        bar = (ends - starts == 1) & (first == ord("|"))
        digit = (first >= 48) & (first <= 57)
        at = 0
        for i, count in enumerate(counts):
            part = slice(at, at + count)
            at += count
            buckets, found = np.unique((hashes[part] >> np.uint64(7)).astype(np.int64) & (BUCKETS - 1), return_counts=True)
            values = np.log1p(found)
            values = values / max(1e-9, float(np.sqrt((values**2).sum())))
            n = max(1, int(count))
            text = raw[offsets[i] : offsets[i + 1]]
            size = max(1, len(text))
            distinct = len(np.unique(hashes[part]))
            shape = [
                1.0, distinct / n, same[part].sum() / n, symbol[part].sum() / n, upper[part].sum() / n, bar[part].sum() / n,
                digit[part].sum() / n, min(1.0, (size - n) / n / 12), ((text >= 65) & (text <= 90)).sum() / size, min(1.0, np.log1p(n) / 12),
            ]
            yield np.concatenate((buckets, np.arange(BUCKETS, BUCKETS + SHAPES))), np.concatenate((values, np.array(shape)))


@dataclass
class Model:
    """``weights`` per bucket, ascending ``thresholds`` between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thresholds[None, :], -30, 30)))


def _slopes(margin: np.ndarray, grades: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood of each row by its margin and by the thresholds."""
    rows = np.arange(len(margin))
    upper = np.concatenate((thresholds, [np.inf]))[grades]
    lower = np.concatenate(([-np.inf], thresholds))[grades]
    above, below = 1 / (1 + np.exp(-np.clip(margin - lower, -30, 30))), 1 / (1 + np.exp(-np.clip(margin - upper, -30, 30)))
    above, below = np.where(np.isinf(lower), 1.0, above), np.where(np.isinf(upper), 0.0, below)
    likely = np.maximum(above - below, 1e-9)
    da, db = above * (1 - above), below * (1 - below)
    by_threshold = np.zeros((len(margin), len(thresholds)))
    inner = grades > 0
    by_threshold[rows[inner], grades[inner] - 1] += (da / likely)[inner]
    inner = grades < len(thresholds)
    by_threshold[rows[inner], grades[inner]] -= (db / likely)[inner]
    return -(da - db) / likely, by_threshold


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int) -> Model:
    """Weights and thresholds by Adam; thresholds are kept in order."""
    owners = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    buckets, values = np.concatenate([b for b, _ in rows]), np.concatenate([v for _, v in rows])
    weights = np.zeros(BUCKETS + SHAPES)
    thresholds = np.linspace(-1, 1, levels - 1) if levels > 2 else np.zeros(1)
    shares = np.bincount(grades, minlength=levels) / len(grades)
    balance = 1 / np.maximum(shares[grades], 1e-3)
    balance /= balance.sum()
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(thresholds), np.zeros_like(thresholds)]
    for step in range(1, ROUNDS + 1):
        margin = np.bincount(owners, weights[buckets] * values, len(rows))
        pull, moved = _slopes(margin, grades, thresholds)
        slope = np.bincount(buckets, (pull * balance)[owners] * values, len(weights)) + PENALTY * weights
        lift = (moved * balance[:, None]).sum(axis=0)
        for k, (g, i) in enumerate(((slope, 0), (lift, 2))):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            move = RATE / (1 + step / 50) * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.99**step)) + 1e-6)
            if k == 0:
                weights = weights - move
            else:
                thresholds = np.maximum.accumulate(thresholds - move)
    return Model(weights, thresholds)


def train(documents: DataFrame, ratings: DataFrame, levels: int) -> Model | None:
    """The model of rated documents outside the held-out fold, at most ``TRAIN_DOCS``; ``ratings`` has doc_id and grade.

    Ratings that are NULL or no grade from 0 to ``levels`` - 1 are passed over; of several the lowest counts.  ``None``
    without two different grades.
    """
    known = ratings.filter(F.col("grade").between(0, levels - 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("grade").cast("int").alias("grade"))
    known = kept(sampled(known.filter(~held_out(F.col("doc_id"))), TRAIN_DOCS), "ratings")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rated = texts.join(F.broadcast(known), "doc_id").select("grade", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.array([b.astype(np.int32).tobytes() for b, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())],
                names=["grade", "buckets", "scale"],
            )

    got = kept(rated.mapInArrow(rows, "grade int, buckets binary, scale binary"), "rated").limit(2 * TRAIN_DOCS).toPandas()
    if got["grade"].nunique() < 2:
        return None
    pairs = [(np.frombuffer(b, np.int32), np.frombuffer(v, np.float32)) for b, v in zip(got["buckets"], got["scale"], strict=True)]
    return fit(pairs, got["grade"].to_numpy().astype(np.int64), levels)


def graded(documents: DataFrame, model: Model | None, levels: int) -> DataFrame:
    """(doc_id, tails): P(grade >= k) for k from 1, for every document row and its whole text (NULL: empty).

    Without a model every tail is one half.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = shared.value
        for batch in batches:
            if learnt is None:
                tails = np.full((batch.num_rows, levels - 1), 0.5)
            else:
                tails = learnt.tails(np.array([learnt.weights[b] @ v for b, v in features(batch.column("text"))]).reshape(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tails.tolist(), pa.list_(pa.float64()))], names=["doc_id", "tails"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, tails array<double>")


def selected(documents: DataFrame, model: Model | None, levels: int, grade: int = 1, chance: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_prob (of ``grade`` or better) and kept: whether that reaches ``chance``."""
    tail: Column = F.col("tails")[grade - 1]
    return graded(documents, model, levels).select("doc_id", F.aggregate("tails", F.lit(0.0), lambda a, t: a + t).alias("expected_grade"), tail.alias("tail_prob"), (tail >= chance).alias("kept"))
