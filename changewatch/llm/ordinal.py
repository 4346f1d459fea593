"""Quality classifier: ordinal cumulative-link regression on graded ratings.

For grades 0 < 1 < ... < K the model is P(grade <= k | text) = logistic(t_k - w x), with one weight
vector w for all grades and ordered thresholds t_0 < t_1 < ... (kept ordered by writing the gaps
as exponentials). x are hashed features of the text, as log(1 + rate): runs of three bytes, words, and
how often a word repeats the one before it. It gives each text an expected grade and the
probability of a grade of at least ``tail``, by which a corpus can be selected.

Training reads a bounded sample of rated texts (about ``per_grade`` of each grade, chosen by a
hash of the key). Features are made in Spark tasks; the fit is full-batch Adam over the sample's
sparse matrix on the driver. Scoring broadcasts w (``BUCKETS`` floats) and the thresholds, and
reads every whole text.

Defined cases: an empty text (null included) has no features and so the grade of the thresholds
alone. With fewer than two grades in the sample every text gets the only grade known (0 if there
is none). Null ratings and ratings without a document are not learned from; a key rated
several times counts once per rating. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import fold, query, table, with_fields
from .toxicity import labelled_sample
from .vec import Hasher, slices, space_table, splitmix, word_spans

BITS = 15
BUCKETS = 1 << BITS
PER_GRADE = 2500
STEPS = 120
RATE = 0.05
RIDGE = 3e-4


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, bucket, value) by slice, sorted by row and bucket."""
    space, hasher = space_table(), Hasher(4)
    for first, data, offsets in slices(column, 1 << 19):
        n_rows = len(offsets) - 1
        length = np.maximum(np.diff(offsets), 1)
        start, end, row = word_spans(data, offsets, space)
        word = hasher.spans(hasher.sums(data), start, end)
        again = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) + 1
        byte_row = np.repeat(np.arange(n_rows), np.diff(offsets))
        three = data.astype(np.uint64)
        three = three[:-2] << np.uint64(16) | three[1:-1] << np.uint64(8) | three[2:] if len(data) > 2 else three[:0]
        whole = byte_row[:-2] == byte_row[2:] if len(data) > 2 else np.zeros(0, bool)
        shift = np.uint64(64 - BITS)
        bucket = np.concatenate([
            (three[whole] * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64),
            (splitmix(word) >> shift).astype(np.int64),
            np.zeros(len(again), np.int64),
        ])
        rows = np.concatenate([byte_row[:-2][whole] if len(data) > 2 else byte_row[:0], row, row[again]])
        cell, count = np.unique(rows * BUCKETS + bucket, return_counts=True)
        at = cell >> BITS
        yield first, n_rows, at, cell & (BUCKETS - 1), np.log1p(1000.0 * count / length[at])


class Model:
    """Weights by bucket and thresholds in ascending order; grades are 0 .. len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, only: int = 0):
        self.weights, self.thresholds, self.only = weights, thresholds, only

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K, by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -30, 30)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, weight: np.ndarray | None = None) -> Model:
    """Maximum likelihood with a ridge, by Adam on the whole sample.

    ``weight``: how many ratings each row stands for, so that the shares of the grades are those of all.
    """
    n = len(grade)
    many = np.ones(n) if weight is None else weight * (n / weight.sum())
    # thresholds start where the observed shares of grades put them
    share = np.clip(np.cumsum(np.bincount(grade, many, minlength=grades))[:-1] / n, 0.01, 0.99)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    w = np.zeros(BUCKETS)
    scale = np.sqrt(np.bincount(bucket, value**2, minlength=BUCKETS) / n) + 1e-3
    x = value / scale[bucket] / np.sqrt(max(len(value) / n, 1))
    moments = [np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(grades - 1), np.zeros(grades - 1)]
    for step in range(1, STEPS + 1):
        t = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        s = np.bincount(row, w[bucket] * x, minlength=n)
        above, below = _logistic(edges[grade + 1] - s), _logistic(edges[grade] - s)
        p = np.maximum(above - below, 1e-9)
        d_s = many * (above + below - 1)
        d_t = np.bincount(grade, many * above * (1 - above) / p, minlength=grades)[:-1]
        d_t -= np.bincount(grade, many * below * (1 - below) / p, minlength=grades)[1:]
        d_free = np.concatenate([[d_t.sum()], [d_t[k + 1 :].sum() * np.exp(free[k + 1]) for k in range(grades - 2)]])
        g_w = -np.bincount(bucket, d_s[row] * x, minlength=BUCKETS) / n + RIDGE * w
        for k, (g, v) in enumerate(((g_w, w), (-d_free / n, free))):
            m, u = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            u += 0.01 * (g * g - u)
            v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-8)
    t = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
    return Model((w / scale / np.sqrt(max(len(value) / n, 1))).astype(np.float32), t)


def fit(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", per_grade: int = PER_GRADE) -> Model:
    """Learn from ``ratings`` (key, grade from 0 on) of some documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grades = np.array(batch.column(0).to_pylist(), np.int32)
            for first, n_rows, row, bucket, value in features(batch.column(1)):
                ends = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c)) for c in (bucket.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array(grades[first : first + n_rows]), *lists, batch.column(2).slice(first, n_rows)], ["grade", "bucket", "value", "weight"])

    rated = ratings.filter(F.col(grade) >= 0)
    sample = labelled_sample(docs, rated, key, text, grade, per_grade)
    got = sample.mapInArrow(rows, "grade int, bucket array<int>, value array<float>, weight double").toArrow()
    grades = got.column("grade").to_numpy().astype(np.int64)
    if len(np.unique(grades)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(0), int(grades[0]) if len(grades) else 0)
    bucket, value = got.column("bucket").combine_chunks(), got.column("value").combine_chunks()
    row = np.repeat(np.arange(len(grades)), np.diff(bucket.offsets.to_numpy()))
    return train(row, bucket.flatten().to_numpy(), value.flatten().to_numpy().astype(float), grades, int(grades.max()) + 1, got.column("weight").to_numpy())


def graded(df: DataFrame, model: Model, tail: int, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``expected_grade``, ``tail_probability`` and ``predicted_grade``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = ["expected_grade", "tail_probability", "predicted_grade"]
    kept = [c for c in df.columns if c not in (text, *names)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for first, n_rows, row, bucket, value in features(batch.column(len(kept))):
                score[first : first + n_rows] = np.bincount(row, model.weights[bucket] * value, minlength=n_rows)
            if len(model.thresholds):
                least = model.at_least(score)
                expected = least.sum(axis=1)
                top = least[:, tail - 1] if 1 <= tail <= least.shape[1] else np.full(len(score), float(tail < 1))
                each = np.diff(np.concatenate([np.ones((len(score), 1)), least, np.zeros((len(score), 1))], axis=1), axis=1)
                best = (-each).argmax(axis=1)
            else:
                expected, top = np.full(len(score), float(model.only)), np.full(len(score), float(model.only >= tail))
                best = np.full(len(score), model.only)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(expected), pa.array(top), pa.array(best.astype(np.int32))], [*kept, *names]
            )

    given = df.select(*kept, text)
    schema = with_fields(given.drop(text), "expected_grade double, tail_probability double, predicted_grade int")
    return given.mapInArrow(rows, schema)


@query()
def op4_ordinal_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    # graded ratings of the labels: 0 toxic and bad, 1 toxic or bad, 2 neither
    ratings = table(spark, folder, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    model = fit(docs, ratings.filter(~held_out))
    return graded(docs.select("doc_id", held_out.alias("held_out"), "text"), model, tail=2)
