"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts n-grams of 1 to 3 characters of a bounded sample of labelled texts in
Spark tasks (at most about ``per_language`` texts of each language, chosen by a hash
of the row) and gathers one counter per language and bucket. ``predict`` broadcasts
the matrix of log-probabilities (languages x ``BUCKETS`` doubles, so bounded) and
scores every whole text in numpy: one gather per language over the n-grams of a
slice of documents, summed by row.

Defined cases: a text that is null or has no letter gives ``und`` with score 0. Equal
texts get equal answers. Without any labelled text everything is ``und``. Of two
languages with equal scores the alphabetically first wins. Other columns of the input
are passed through; columns named like the output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import fold, query, table
from .vec import MULTIPLIER, freed_after, slices, splitmix

BUCKETS = 1 << 15
ORDERS = 3
PER_LANGUAGE = 3000
SLICE = 1 << 18
SMOOTHING = 0.5
UNDETERMINED = "und"


def letter_flags(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    found, at = np.unique(codes, return_inverse=True)
    return np.array([chr(c).isalpha() for c in found], dtype=bool)[at] if len(codes) else np.zeros(0, bool)


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of the n-grams of each order; data is lower-cased UTF-8.

    Runs of other characters count as one space. Rows without a letter give nothing.
    """
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    row = np.searchsorted(offsets, np.flatnonzero((data & 0xC0) != 0x80), side="right") - 1
    letter = letter_flags(codes)
    keep = letter.copy()
    # a space after each run of letters; nothing is kept of a row before its first letter
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
    codes, row = np.where(letter, codes, 32)[keep].astype(np.uint64), row[keep]
    mult = splitmix(np.arange(1, ORDERS + 1, dtype=np.uint64)) | np.uint64(1)
    h = np.zeros(len(codes), np.uint64)
    for order in range(ORDERS):
        n = len(codes) - order
        if n <= 0:
            return
        h = h[:n] + codes[order:] * mult[order]
        same = row[:n] == row[order:]
        mixed = (h + np.uint64(order)) * np.uint64(MULTIPLIER)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        yield (mixed >> np.uint64(64 - 15)).astype(np.int64)[same], row[:n][same]


def sample_by_label(df: DataFrame, label: Column, text: str, per_label: int) -> DataFrame:
    """Rows (label, text, weight) of about ``per_label`` rows of each label, chosen by a hash of the row.

    A label of fewer rows is taken whole. ``weight`` is how many rows with a label and text each row
    stands for: weights of a label add up to all its rows, however large the table.
    """
    point = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30)) / float(1 << 30)
    rows = df.select(label.alias("label"), F.col(text).alias("text"), point.alias("point"))
    rows = rows.filter("label is not null and text is not null")
    spark = df.sparkSession
    counts = [(str(r["label"]), r["count"]) for r in rows.groupBy("label").count().collect()]
    # small tables by Arrow: of rows in Python, Spark would start Python workers that only hand them on
    names = pa.array([name for name, _ in counts], pa.string())
    share = spark.createDataFrame(pa.table({"_name": names, "share": pa.array([per_label / n for _, n in counts], pa.float64())}))
    # one row per label: a model holds a row of weights for each, so there are few
    chosen = rows.join(F.broadcast(share), F.col("label").cast("string") == F.col("_name")).filter("point < share")
    got = {str(r["label"]): r["count"] for r in chosen.groupBy("label").count().collect()}
    weight = pa.array([n / got[name] if name in got else None for name, n in counts], pa.float64())
    weights = spark.createDataFrame(pa.table({"_of": names, "weight": weight}))
    return chosen.join(F.broadcast(weights), F.col("label").cast("string") == F.col("_of")).select("label", "text", "weight")


class Model:
    """Languages in alphabetical order and their log-probabilities by bucket."""

    def __init__(self, languages: list[str], weights: np.ndarray, prior: np.ndarray):
        self.languages, self.weights, self.prior = languages, weights, prior


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from rows with a non-null language and text."""

    @freed_after
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        texts: dict[str, float] = {}
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), dtype=object)
            stands_for = batch.column(2).to_numpy()
            names = sorted(set(labels))
            number = np.searchsorted(names, labels.astype(str)) if names else np.zeros(0, np.int64)
            for k, name in enumerate(names):
                texts[name] = texts.get(name, 0.0) + float(stands_for[number == k].sum())
                total.setdefault(name, np.zeros(BUCKETS, np.int64))
            for first, data, offsets in slices(batch.column(1), SLICE):
                for bucket, row in ngram_buckets(data, offsets):
                    cell = number[first + row] * BUCKETS + bucket
                    counts = np.bincount(cell, minlength=len(names) * BUCKETS)
                    for k, name in enumerate(names):
                        total[name] += counts[k * BUCKETS : (k + 1) * BUCKETS]
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            bucket = np.concatenate([at, [-1]])  # -1: how many texts, with those not in the sample
            number = np.concatenate([counts[at].astype(float), [texts[name]]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(bucket)), pa.array(bucket.astype(np.int32)), pa.array(number)],
                ["lang", "bucket", "n"],
            )

    sample = sample_by_label(labelled, F.col(lang).cast("string"), text, per_language)
    counted = sample.select("label", F.lower("text").alias("text"), "weight").mapInArrow(count, "lang string, bucket int, n double")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    texts = np.zeros(len(languages))
    which = np.searchsorted(languages, rows["lang"].to_numpy(str)) if languages else np.zeros(0, np.int64)
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    texts[which[bucket < 0]] = n[bucket < 0]
    counts[which[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    smoothed = counts + SMOOTHING
    weights = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
    return Model(languages, weights, np.log(np.maximum(texts, 1)))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (the probability of the predicted language)."""
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.prior))

    # only texts go to Python, once, and only predictions come back: the other columns wait in the JVM
    @F.arrow_udf("struct<lang:string,score:double>")
    @freed_after
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages, weights, prior = shared.value
        for texts in batches:
            n = len(texts)
            total = np.zeros((len(languages), n))
            seen = np.zeros(n, np.int64)
            for first, data, offsets in slices(texts, SLICE):
                rows = len(offsets) - 1
                for bucket, row in ngram_buckets(data, offsets):
                    seen[first : first + rows] += np.bincount(row, minlength=rows)
                    for k in range(len(languages)):
                        total[k, first : first + rows] += np.bincount(row, weights[k][bucket], minlength=rows)
            if languages:
                total += prior[:, None]
                best = total.argmax(axis=0)
                score = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
                name = np.array(languages, dtype=object)[best]
                name[seen == 0], score[seen == 0] = UNDETERMINED, 0.0
            else:
                name, score = np.full(n, UNDETERMINED, object), np.zeros(n)
            yield pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(score)], names=["lang", "score"])

    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    return df.select(*kept, scored(F.lower(df[text])).alias("_of")).select(
        *kept, F.col("_of.lang").alias("lang_pred"), F.col("_of.score").alias("score"))


def accepted(least: float = 0.5) -> Column:
    """Documents kept by a corpus filter: some language is the likelier one."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)


@query()
def op9_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = fit(docs.filter(~held_out & F.col("lang").isNotNull()))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
