"""Toxicity by class-conditional Kneser-Ney models of word sequences.

Two models of order 2, one of toxic and one of ordinary texts, end in the same backoff. With
discount D, in class c, for a word w after the word v (or the start of a sentence):

    P_c(w | v) = max(n_c(v w) - D, 0) / n_c(v .) + L_c(v) P_c(w)
    P_c(w)     = max(n_c(w) - D, 0) / n_c(.) + L_c B(w)

n_c(v w) counts the sampled texts of the class that have w after v, and n_c(w) after how many different words w stands
in them: words of a few copied passages count little, however many copies the sample has. L is the share that D took away
(1 after words that the class has never seen), and B is shared: the continuation counts of the whole corpus, i.e. after how
many different words w stands anywhere, plus a half for every word. So an expression rare
in the labelled texts falls back on the same counts in both classes and tells them apart no more.

A difference is log P_toxic - log P_ordinary, less that of a word which neither class has after v: how much a class
leaves to the backoff depends on the size of its sample and is no evidence. So it is
log (max(n_c(v w) - D, 0) / (n_c(v .) L_c(v)) + P_c(w)) for each class, less log L_c. It is normalised by length over three stretches: the worst single word in its
context, the worst sentence (with ``PRIOR`` words of no evidence, as some have two words) and the whole text.
One insult in a long text shows in the first two. A logistic curve of the three gives the score; it, D (of ``DISCOUNTS``) and
the order (2, or 1 where pairs of words do not help) are fitted, by likelihood, on the sampled texts, each
judged without what it gave to the counts (leaving one out).

Continuation counts are a table of all words of all texts: (word, context) pairs are made distinct by task
and packed by buckets of words, then counted by bucket. Words frequent in the sample are spread over buckets by their contexts. Class counts come from a bounded sample of
labelled texts (about ``per_class`` of each class, chosen by a hash of the row); sequences of a single
sampled text, or context, are added up but not passed on, since every D takes them away whole. What is broadcast are the other
sequences of the sample, so it is bounded by it. Words are told apart by 64-bit hashes, contexts of a word by 32-bit ones.

Words are runs of letters, digits and other characters from U+0080 on, lower-cased; sentences end at ``.!?`` or a line.

Defined cases: a text without evidence (empty, null, all words unknown) scores the share of toxic rows among labelled
ones. Equal texts have equal scores. A text of any length is read whole. Without labelled texts of both classes all scores
are 0.5. Where a document id has several labels, one toxic label decides. A repeated row counts as often as it stands there.
An empty table gives no rows. Other columns, whatever their names, are passed through; one named as the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffles_freed, use_checkpoint_dir
from .catalog import fold, query, table
from .langid import sample_by_label
from .vec import MULTIPLIER, Hasher, slices, splitmix, word_spans

PER_CLASS = 3000
DISCOUNTS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
ORDERS = (1, 2)
PRIOR = 5
STRETCH = 2_000_000
PAIR_BYTES = 8_000_000
HOT_CONTEXTS = 200
START = np.uint64(0)


@dataclass
class Words:
    """Words of a slice of texts: hash, hash of the word before (or START), row, number of the sentence."""

    word: np.ndarray
    before: np.ndarray
    row: np.ndarray
    sentence: np.ndarray


def words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, rows, words) by slice of lower-cased texts."""
    breaks = np.ones(256, bool)
    breaks[48:58] = breaks[97:123] = breaks[128:] = False
    ends = np.zeros(256, bool)
    ends[[10, 13, 33, 46, 63]] = True
    hasher = Hasher(6)
    for first, data, offsets in slices(column):
        start, end, row = word_spans(data, offsets, breaks)
        word = hasher.spans(hasher.sums(data), start, end)
        stops = np.cumsum(ends[data])
        fresh = np.ones(len(start), bool)
        if len(start):
            fresh[1:] = (row[1:] != row[:-1]) | (stops[start[1:]] != stops[start[:-1]])
        before = np.concatenate([[START], word[:-1]]).astype(np.uint64)[: len(word)]
        before[fresh] = START
        yield first, len(offsets) - 1, Words(word, before, row, np.cumsum(fresh) - 1)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return splitmix(before * np.uint64(MULTIPLIER) + splitmix(word))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, before, word, n) of rows (label, text): in how many texts the word comes after ``before``."""
    for batch in batches:
        label = np.array(batch.column(0).to_pylist(), np.int64)
        for first, _, w in words(batch.column(1)):
            of = label[first + w.row].astype(np.uint64)
            key = pair_keys(w.before, w.word)
            _, at = np.unique(splitmix(key + splitmix(w.row)), return_index=True)  # once per text
            _, one, n = np.unique(splitmix(key[at] + splitmix(of[at])), return_index=True, return_counts=True)
            at = at[one]
            columns = [of[at].astype(np.int32), w.before[at].view(np.int64), w.word[at].view(np.int64), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["label", "before", "word", "n"])


def class_counts(df: DataFrame) -> DataFrame:
    """(label, single, before, word, n) over rows (label, text): of pairs, and of words the number of their contexts."""
    rows = df.select("label", F.lower("text").alias("text")).mapInArrow(_class_counts, "label int, before bigint, word bigint, n bigint")
    pairs = rows.groupBy("label", "before", "word").agg(F.sum("n").alias("n")).checkpoint()
    singles = pairs.groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))
    columns = ["label", "single", "before", "word", "n"]
    return pairs.withColumn("single", F.lit(False)).select(*columns).union(
        singles.withColumns({"single": F.lit(True), "before": F.lit(0).cast("bigint")}).select(*columns))


def _contexts(hot, buckets: int):
    """(bucket, packed) of the distinct (word, context) of a stretch: words, how many contexts each has, contexts."""

    def distinct(kept: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        word, context = (np.concatenate(part) for part in zip(*kept, strict=True))
        _, at = np.unique(splitmix(word) + context.astype(np.uint64) * np.uint64(MULTIPLIER), return_index=True)
        word, context = word[at], context[at]
        spread = np.where(_at(hot.value, word)[0], context, 0).astype(np.uint64)
        bucket = splitmix(word + spread * np.uint64(MULTIPLIER)) % np.uint64(buckets)
        order = np.lexsort((context, word, bucket))
        word, context, bucket = word[order], context[order], bucket[order].astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        packed = []
        for start, end in zip(first, [*first[1:], len(word)], strict=True):
            one, n = np.unique(word[start:end], return_counts=True)
            packed.append(np.int64(len(one)).tobytes() + one.tobytes() + n.astype(np.uint32).tobytes() + context[start:end].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(packed, pa.binary())], ["bucket", "packed"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for _, _, w in words(batch.column(0)):
                kept.append((w.word, (w.before >> np.uint64(32)).astype(np.uint32)))
                held += len(w.word)
                if held >= STRETCH:
                    yield distinct(kept)
                    kept, held = [], 0
        if held:
            yield distinct(kept)

    return stretches


def _counted_contexts(group: pa.Table) -> pa.Table:
    """(word, contexts) of a bucket."""
    parts = []
    for packed in group.column("packed").to_pylist():
        k = int(np.frombuffer(packed, np.int64, 1)[0])
        word, n = np.frombuffer(packed, np.uint64, k, 8), np.frombuffer(packed, np.uint32, k, 8 + 8 * k)
        parts.append((np.repeat(word, n), np.frombuffer(packed, np.uint32, -1, 8 + 12 * k)))
    word, context = (np.concatenate(part) for part in zip(*parts, strict=True))
    _, at = np.unique(splitmix(word) + context.astype(np.uint64) * np.uint64(MULTIPLIER), return_index=True)
    word, n = np.unique(word[at], return_counts=True)
    return pa.table({"word": pa.array(word.view(np.int64)), "contexts": pa.array(n.astype(np.int64))})


def continuations(df: DataFrame, text: str = "text", hot: np.ndarray | None = None) -> DataFrame:
    """(word, contexts) of all words of all texts: after how many different words each stands.

    ``hot``: words (hashes) to spread over buckets by context; the result does not depend on it.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    hot = np.zeros(0, np.uint64) if hot is None else np.sort(hot)
    task = _contexts(df.sparkSession.sparkContext.broadcast(hot), max(8, size // PAIR_BYTES))
    rows = df.select(F.lower(df[text]).alias("text")).mapInArrow(task, "bucket bigint, packed binary")
    partly = rows.groupBy("bucket").applyInArrow(_counted_contexts, "word bigint, contexts bigint")
    return partly.groupBy("word").agg(F.sum("contexts").alias("contexts"))


def _sorted(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    return tuple(a[order] for a in (keys, *values))


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``wanted`` are in the sorted ``keys``, the place of each there)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[place] == wanted, place


@dataclass
class Grams:
    """Both class models for one discount; columns are (ordinary, toxic)."""

    discount: float
    word: np.ndarray  # sorted hashes
    word_n: np.ndarray
    backoff: np.ndarray  # B(w)
    pair: np.ndarray  # sorted keys of pairs
    pair_n: np.ndarray
    pair_left: np.ndarray  # n_c(v .) L_c(v)
    sums: np.ndarray  # n_c(.)
    left: np.ndarray  # L_c

    def differences(self, w: Words, label: np.ndarray | None = None) -> np.ndarray:
        """log P_toxic(w | v) - log P_ordinary(w | v) for each word, less that of a word of neither class after v.

        With the labels of sampled texts by row, each is judged without what it gave to the counts of its class.
        """
        p = np.ones((len(w.word), 2))  # words of neither class have no evidence
        own = np.zeros((len(w.word), 2))
        if label is not None and len(w.word):
            _, first = np.unique(splitmix(pair_keys(w.before, w.word) + splitmix(w.row)), return_index=True)
            _, word = np.unique(splitmix(w.word + splitmix(w.row)), return_inverse=True)
            own[np.arange(len(own)), label[w.row]] = np.bincount(word[first])[word]
        known, at = _at(self.word, w.word)
        at = at[known]
        p[known] = np.maximum(self.word_n[at] - own[known] - self.discount, 0) / self.sums + self.left * self.backoff[at, None]
        also = np.flatnonzero(known)  # the word of a known pair is known
        seen, at = _at(self.pair, pair_keys(w.before[also], w.word[also]))
        at, also = at[seen], also[seen]
        p[also] += np.maximum(self.pair_n[at] - (own[also] > 0) - self.discount, 0) / self.pair_left[at]
        log = np.log(p)
        return log[:, 1] - log[:, 0] - np.where(known, np.log(self.left[1] / self.left[0]), 0.0)

    def evidence(self, column: pa.Array, label: np.ndarray | None = None) -> np.ndarray:
        """Differences of the worst word, of the worst sentence and of the text, by row of lower-cased texts."""
        out = np.zeros((len(column), 3))
        for first, rows, w in words(column):
            d = self.differences(w, None if label is None else label[first : first + rows])
            if not len(d):
                continue
            length = np.bincount(w.sentence)
            sentence = np.bincount(w.sentence, d) / (length + PRIOR)
            begin = np.flatnonzero(np.diff(w.row, prepend=-1))
            row = w.row[begin]
            out[first + row, 0] = np.maximum.reduceat(d, begin)
            out[first + row, 1] = np.maximum.reduceat(sentence[w.sentence], begin)
            out[first : first + rows, 2] = np.bincount(w.row, d, minlength=rows) / np.maximum(np.bincount(w.row, minlength=rows), 1)
        return out


def estimate(grams, totals, corpus: tuple[int, int], discount: float, order: int = 2) -> Grams:
    """Models from counts: ``grams`` (single, before, word, n0, n1, contexts), ``totals`` of each class and context.

    ``totals`` has rows (single, before, c, n, left) with the sum of n and of min(n, discount). ``corpus`` is
    (distinct pairs, distinct words). Sequences that D takes away in both classes are left out.
    """
    pairs, kinds = corpus
    is_single = grams["single"].to_numpy(bool)
    n = grams[["n0", "n1"]].to_numpy(float)
    word = grams["word"].to_numpy(np.int64).view(np.uint64)
    before = grams["before"].to_numpy(np.int64).view(np.uint64)
    matters = n.max(axis=1, initial=0) > discount
    of_all = totals["single"].to_numpy(bool)
    sums, left = np.ones(2), np.ones(2)
    for c, total, rest in totals.loc[of_all, ["c", "n", "left"]].itertuples(index=False):
        sums[int(c)], left[int(c)] = total, rest / total
    use_pairs = ~is_single & matters & (order > 1)
    use = is_single & (matters | np.isin(word, word[use_pairs]))
    backoff = (grams["contexts"].to_numpy(float)[use] + 0.5) / (pairs + 0.5 * max(kinds, 1))
    single = _sorted(word[use], n[use], backoff)
    use = use_pairs
    context, number = np.unique(before[use], return_inverse=True)
    weight = np.ones((len(context), 2))
    rows = totals[~of_all]
    known, at = _at(context, rows["before"].to_numpy(np.int64).view(np.uint64))
    weight[at[known], rows["c"].to_numpy(int)[known]] = rows["left"].to_numpy(float)[known]
    pair = _sorted(pair_keys(before[use], word[use]), n[use], weight[number])
    return Grams(discount, *single, *pair, sums, left)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights, shift, mean log loss) of a logistic curve, by Newton steps with a little ridge.

    ``weight``: how many rows each one stands for, so that the shares of the classes are those of all rows.
    """
    if len(np.unique(y)) < 2:
        return np.zeros(x.shape[1]), 0.0, np.inf
    u = weight * (len(y) / weight.sum())
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    z = np.column_stack([x / scale, np.ones(len(x))])
    theta = np.zeros(z.shape[1])
    ridge = np.r_[np.ones(x.shape[1]), 0.01]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z.T * (u * np.maximum(p * (1 - p), 1e-6))) @ z + np.diag(ridge), z.T @ (u * (y - p)) - ridge * theta)
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ theta, -30, 30))), 1e-12, 1 - 1e-12)
    loss = -(u * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()
    return theta[:-1] / scale, float(theta[-1]), float(loss)


@dataclass
class Model:
    """Models of both classes, the discount and order taken, and the logistic curve of the evidence."""

    grams: Grams | None
    choice: tuple[float, int]
    weights: np.ndarray
    shift: float
    share: float  # of toxic rows among all labelled ones


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int) -> DataFrame:
    """(label, text, weight) of about ``per_label`` documents of each label, chosen among ``labels`` (key, label).

    ``weight`` is how many rows of ``labels`` each one stands for.
    The chosen keys are at most about labels x per_label, so they are broadcast.
    """
    chosen = sample_by_label(labels.select(key, label), F.col(label).cast("int"), key, per_label)
    return docs.select(key, text).join(F.broadcast(chosen.toDF("label", key, "weight")), key).select("label", F.col(text).alias("text"), "weight")


def counted(learn: DataFrame, docs: DataFrame, text: str):
    """(grams, totals by discount, corpus) for ``estimate``, of sampled texts (label, text) and all texts."""
    counts = class_counts(learn).checkpoint()
    left = [F.sum(F.least(F.col("n"), F.lit(d))).alias(f"left{i}") for i, d in enumerate(DISCOUNTS)]
    by_class = (F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1))
    grams = counts.groupBy("single", "before", "word").agg(*by_class).withColumn("most", F.greatest("n0", "n1"))
    # a word is kept with each of its pairs
    of_word = F.max("most").over(Window.partitionBy("word"))
    grams = grams.withColumn("of_word", of_word).filter(F.when(F.col("single"), F.col("of_word")).otherwise(F.col("most")) > min(DISCOUNTS)).checkpoint()
    # bounded by the sample, and only a matter of where pairs are counted
    hot = grams.filter(F.col("single") & (F.col("most") >= HOT_CONTEXTS)).select("word").toPandas()["word"]
    contexts = continuations(docs, text, hot.to_numpy(np.int64).view(np.uint64)).checkpoint()
    pairs, kinds = contexts.agg(F.coalesce(F.sum("contexts"), F.lit(0)), F.count(F.lit(1))).first()
    singles = grams.filter("single").join(contexts, "word", "left")
    singles = singles.select("single", "before", "word", "n0", "n1", F.coalesce("contexts", F.lit(0)).alias("contexts"))
    others = grams.filter("not single").withColumn("contexts", F.lit(0).cast("bigint")).select(*singles.columns)
    used = grams.select("single", "before").distinct()
    totals = counts.join(used, ["single", "before"], "left_semi").groupBy("single", "before", F.col("label").alias("c"))
    totals = totals.agg(F.sum("n").alias("n"), *left).toPandas()
    by_discount = [totals[["single", "before", "c", "n"]].assign(left=totals[f"left{i}"]) for i in range(len(DISCOUNTS))]
    return singles.union(others).toPandas(), by_discount, (pairs, kinds)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = PER_CLASS,
) -> Model:
    """Learn from ``labels`` (key, 0/1 label) of some documents, and from all texts of ``docs``."""
    with shuffles_freed(docs.sparkSession):
        return _fitted(docs, labels, key, text, label, per_class)


def _fitted(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int) -> Model:
    spark = docs.sparkSession
    use_checkpoint_dir(spark)
    learn = labelled_sample(docs, labels, key, text, label, per_class)
    grams, totals, corpus = counted(learn, docs, text)
    if {0, 1} - set(totals[0]["c"]):
        return Model(None, (0.0, 0), np.zeros(3), 0.0, 0.5)
    choices = [(k, d, order) for k, d in enumerate(DISCOUNTS) for order in ORDERS]
    models = [estimate(grams, totals[k], corpus, d, order) for k, d, order in choices]
    shared = spark.sparkContext.broadcast(models)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(0).to_pylist(), np.int64)
            found = np.concatenate([m.evidence(batch.column(2), label) for m in shared.value], axis=1)
            found = pa.array(list(found), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], found], ["label", "weight", "found"])

    held = learn.select("label", "weight", F.lower("text").alias("text"))
    held = held.mapInArrow(evidence, "label int, weight double, found array<double>").toPandas()
    found = np.stack(held["found"])
    curves = [logistic(found[:, 3 * k : 3 * k + 3], held["label"].to_numpy(float), held["weight"].to_numpy(float)) for k in range(len(models))]
    best = min(range(len(models)), key=lambda k: curves[k][2])
    share = float(np.average(held["label"], weights=held["weight"]))
    return Model(models[best], choices[best][1:], *curves[best][:2], share)


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` without its text and with the probability of being toxic."""
    kept = [c for c in df.columns if c not in (text, name)]
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = shared.value
        for texts in batches:
            found = of.grams.evidence(texts) if of.grams else np.zeros((len(texts), 3))
            z = np.clip(found @ of.weights + of.shift, -700, 700)
            yield pa.array(np.where(found.any(axis=1), 1 / (1 + np.exp(-z)), of.share))

    return df.select(*kept, probability(F.lower(df[text])).alias(name))


@query()
def op6_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    labels = table(spark, folder, "labels").filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = fit(docs, labels.filter(~held_out))
    result = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return result.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
