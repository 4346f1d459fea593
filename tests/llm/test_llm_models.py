"""Trained operators by held-out accuracy, and the pipeline."""

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changewatch.llm import langid, ordinal, registered, toxicity
from changewatch.llm.catalog import fold

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
EDGES = [(None, "no id here"), (2, None), (3, ""), (4, " 12 — \n"), (5, "word " * 30_000), (5, "word " * 30_000), (6, "漢字 и é")]
EXTRA = "doc_id bigint, text string, lang string, label string, score string, held_out string, difference string, _text string"


def edges(spark):
    return spark.createDataFrame([(*r, None, "l", "s", "h", "d", "t") for r in EDGES], EXTRA)


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@needs_tables
def test_language_id(spark):
    found = registered.QUERIES["op9_language_id"](spark, FOLDER).toPandas()
    lang = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(lang, on="doc_id")
    held = both[both["held_out"]]
    assert len(found) == len(lang) and (held["lang"] == held["lang_pred"]).mean() > 0.95
    model = langid.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    rows = langid.predict(edges(spark), model).collect()
    assert [r.lang_pred for r in rows if r.text is None or not any(c.isalpha() for c in r.text)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(EDGES)
    nobody = langid.predict(edges(spark), langid.fit(edges(spark))).collect()
    assert {(r.lang_pred, r.score) for r in nobody} == {("und", 0.0)}
    assert langid.predict(edges(spark).filter("false"), model).count() == 0


@needs_tables
def test_toxicity(spark):
    found = registered.QUERIES["op6_toxicity"](spark, FOLDER).toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert len(found) == 1000 and ((found["score"] >= 0.5) == (found["predicted"] == 1)).all()
    assert auc(held["toxic"].to_numpy(), held["score"].to_numpy()) > 0.85
    # labels of the held-out part change nothing
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = spark.createDataFrame(labels).filter(fold(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(docs, known)
    rows = toxicity.score(edges(spark), model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.fit(docs, known.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(edges(spark), none).collect()} == {0.5}
    assert toxicity.score(edges(spark).filter("false"), model).count() == 0


BIG = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables here")
def test_toxicity_of_held_out_labels(spark):
    found = registered.QUERIES["op6_toxicity"](spark, BIG).toPandas()
    held = found[found["held_out"]].merge(spark.read.parquet(f"{BIG}/labels.parquet").toPandas(), on="doc_id")
    y, s = held["toxic"].to_numpy(), held["score"].to_numpy()
    assert auc(y, s) > 0.93 and (s[y == 1] > np.quantile(s[y == 0], 0.99)).mean() >= 0.8
    assert ((s >= 0.5) & (y == 0)).sum() < 0.02 * (y == 0).sum()


def plain_sentences(text):
    return [q for q in (re.findall(r"[0-9a-z\x80-\U0010ffff]+", s) for s in re.split(r"[.!?\n\r]", (text or "").lower())) if q]


def plain_difference(word, before, texts, corpus, d):
    """The two models by their formulas, over lists of (label, text) and of all texts."""
    contexts = {(v, w) for t in corpus for q in plain_sentences(t) for v, w in zip([None, *q], q)}
    backoff = (sum(w == word for _, w in contexts) + 0.5) / (len(contexts) + 0.5 * len({w for _, w in contexts}))
    logs, left = [], []
    for c in (1, 0):
        single, pair = Counter(), Counter()
        for label, t in texts:
            if label == c:
                pair.update({(v, w) for q in plain_sentences(t) for v, w in zip([None, *q], q)})
        single.update(w for _, w in pair)
        total = sum(single.values())
        left.append(sum(min(n, d) for n in single.values()) / total)
        p = max(single[word] - d, 0) / total + left[-1] * backoff
        after = {k: n for k, n in pair.items() if k[0] == before}
        taken = sum(min(n, d) for n in after.values())  # n(v .) L(v)
        logs.append(np.log(p + (max(pair[before, word] - d, 0) / taken if after else 0)))
    return logs[0] - logs[1] - np.log(left[0] / left[1])


def test_class_models_by_their_formulas(spark):
    rng = np.random.default_rng(4)
    vocabulary = np.array("a b c d e f g h é 漢字 x1".split())
    texts = [(int(k % 3 == 0), ". ".join(" ".join(rng.choice(vocabulary, rng.integers(1, 6), p=np.arange(1, 12) / 66)) for _ in range(3)) + "!" * (k % 2)
              + (" b a Bad\n" if k % 3 == 0 and k % 2 else "")) for k in range(40)]
    corpus = [t for _, t in texts] + ["new words. a b new", None, ""]
    learn = spark.createDataFrame(texts, "label int, text string").repartition(3)
    docs = spark.createDataFrame([(t,) for t in corpus], "body string").repartition(3)
    grams, totals, size = toxicity.counted(learn, docs, "body")
    plain = toxicity.continuations(docs, "body")
    spread = toxicity.continuations(docs, "body", plain.toPandas()["word"].to_numpy(np.int64).view(np.uint64))
    assert sorted(plain.collect()) == sorted(spread.collect()) and plain.count() == size[1]
    asked = ["a b bad. Bad a! b, a", "unknown bad 漢字", "", None, "é\na x1 unknown"]
    for d, total in zip(toxicity.DISCOUNTS, totals):
        model = toxicity.estimate(grams, total, size, d)
        expected = []
        for t in asked:
            by_sentence = [[plain_difference(w, v, texts, corpus, d) for v, w in zip([None, *q], q)] for q in plain_sentences(t)]
            flat = [x for q in by_sentence for x in q]
            worst = max((sum(q) / (len(q) + toxicity.PRIOR) for q in by_sentence), default=0)
            expected.append([max(flat, default=0), worst, np.mean(flat) if flat else 0])
        got = model.evidence(pa.array([None if t is None else t.lower() for t in asked], pa.string()))
        assert np.allclose(got, expected, atol=1e-9), d


def test_toxicity_reads_whole_texts_and_repeats(spark):
    """An insult at the end of a long text counts; equal texts have equal scores; repeats are rows."""
    rows = [(k, f"word{k % 9} and word{k % 7} so on. " * 3 + ("you are vile. " if k % 4 == 0 else "you are kind. ")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    long = "word1 and word2 so on. " * 20_000
    asked = spark.createDataFrame([(1, long + "you are vile."), (1, long + "you are vile."), (2, long), (3, None), (4, "")], "score bigint, text string")
    got = toxicity.score(asked.withColumn("id", F.col("score")), model).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, set()).add(r.score)
    assert len(got) == 5 and all(len(v) == 1 for v in by_id.values())
    assert min(by_id[1]) > 0.5 > max(by_id[2]) and by_id[3] == by_id[4] and max(by_id[3]) < 0.5


@needs_tables
def test_ordinal_quality(spark):
    found = registered.QUERIES["op4_ordinal_quality"](spark, FOLDER).toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id")
    both["grade"] = both["quality"] + 1 - both["toxic"]
    held = both[both["held_out"]]
    assert len(found) == 1000 and np.corrcoef(held["grade"], held["expected_grade"])[0, 1] > 0.4
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ratings = spark.createDataFrame([(k, k % 3) for k in range(300)] + [(1, None), (10**9, 2)], "doc_id bigint, grade int")
    model = ordinal.fit(docs, ratings)
    assert len(model.thresholds) == 2 and (np.diff(model.thresholds) > 0).all()
    for tail in (0, 1, 2, 3):
        rows = ordinal.graded(edges(spark), model, tail).collect()
        assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in rows) and len(rows) == len(EDGES)
    only = ordinal.fit(docs, ratings.filter("grade = 2"))
    assert {(r.expected_grade, r.tail_probability) for r in ordinal.graded(edges(spark), only, 2).collect()} == {(2.0, 1.0)}
    assert ordinal.graded(edges(spark).filter("false"), model, 1).count() == 0


def test_ordinal_gradient_learns_order():
    rng = np.random.default_rng(0)
    n = 600
    grade = rng.integers(0, 4, n)
    row = np.repeat(np.arange(n), 2)
    bucket = np.stack([grade + 10, rng.integers(100, 120, n)], axis=1).ravel()
    model = ordinal.train(row, bucket, np.ones(2 * n), grade, 4)
    assert (np.diff(model.weights[10:14]) > 0).all() and (np.diff(model.thresholds) > 0).all()


def test_samples_keep_the_shares_of_all_rows(spark):
    """Class shares do not depend on how many rows the sample may take."""
    rows = [(k, f"word{k % 7} " * 5 + ("bad" if k % 10 == 0 else "good" if k % 3 else "mixed"), "xx" if k % 10 == 0 else "en") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").cache()
    sample = langid.sample_by_label(docs, F.col("lang"), "text", 150).groupBy("label").agg(F.sum("weight").alias("all"), F.count("*").alias("n"))
    found = {r.label: r for r in sample.collect()}
    assert abs(found["xx"]["all"] - 400) < 1e-6 and abs(found["en"]["all"] - 3600) < 1e-6 and found["en"].n < 250
    model = langid.fit(docs, per_language=150)
    assert np.allclose(np.exp(model.prior), [3600, 400])
    # labels that say nothing about the text: only their share can be learned
    labels = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("t")), F.lit(10)) == 0).cast("int").alias("toxic"))
    scores = toxicity.score(docs.limit(200), toxicity.fit(docs, labels, per_class=150)).toPandas()["score"]
    assert scores.mean() < 0.25
    ratings = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("g")), F.lit(10)) > 0).cast("int").alias("grade"))
    grades = ordinal.graded(docs.limit(200), ordinal.fit(docs, ratings, per_grade=150), 1).toPandas()
    assert grades["expected_grade"].mean() > 0.8


def test_pipeline_stages_on_edges(spark, tmp_path):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    base = " ".join(f"word{k} letters" for k in range(60))
    rows = [(1, base, "en", "s", 1), (2, base + " more", "en", "s", 1), (2, base + " more", "en", "s", 1), (3, None, "en", None, None),
            (4, "", "en", "s", 0), (None, "some other text without id " * 3, "en", "s", 1), (5, "bench mark item of words", None, "s", 1),
            (6, "le texte français de la maison " * 4, "fr", "s", 1), (7, "x" * 300 + " é " + "y" * 300, "en", "s", 1)]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "bench mark item of words"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str))
    assert kept[0] == sorted([1, 2, 2, None, 5, 6, 7], key=str)
    assert kept[1] == kept[2] == sorted([1, None, 5, 6, 7], key=str) and kept[3] == sorted([1, None, 6, 7], key=str)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id for r in final.collect()), key=str) == kept[3]
    empty = spark.createDataFrame([], columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    one, two, three = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    rows = [(None, one), (None, two), (None, one), (7, two + " end"), (7, three), (8, three)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {(None, one), (None, two), (7, three)}


def test_cut_leaves_other_texts_as_they_are(spark):
    same = " ".join(f"same{k}" for k in range(60))
    rows = [(1, "a \ufffd b"), (2, None), (3, "\ufffd x " + same), (4, "y " + same), (5, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    assert (got[1], got[2], got[5]) == ("a \ufffd b", None, "") and got[3].startswith("\ufffd x") and "same5" not in got[3]
