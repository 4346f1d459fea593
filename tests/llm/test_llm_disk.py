"""What operators of many steps leave on the disks, and what workers keep."""

import glob
import time

from pyspark.sql import functions as F

import corpus_pipeline
from changewatch.llm import jaccard, langid, pieces, toxicity, vec
from changewatch.session import BATCH, BATCH_ROWS, FREED


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*.data")}


def left_over(spark, before):
    """Shuffle files that are still there after a while."""
    for _ in range(20):
        new = shuffle_files(spark) - before
        if not new:
            break
        time.sleep(0.5)
    return new


def texts(n):
    words = [f"w{i * i % 97}" for i in range(60)]
    return [(i, " ".join([*words[: 40 + i % 7], f"own{i}", *words[40:]])) for i in range(n)]


def test_similar_sets_leaves_no_shuffle_files(spark):
    docs = spark.createDataFrame(texts(60), "doc_id bigint, text string")
    held = spark.conf.get(FREED, None)
    before = shuffle_files(spark)
    found = jaccard.similar_sets(docs)
    assert not left_over(spark, before)
    assert spark.conf.get(FREED, None) == held
    assert found.count() == 60


def test_fit_of_toxicity_leaves_no_shuffle_files(spark):
    docs = spark.createDataFrame([(i, f"good words {i % 9}" if i % 2 else f"bad insult {i % 7}") for i in range(60)], "doc_id bigint, text string")
    before = shuffle_files(spark)
    toxicity.fit(docs, docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert not left_over(spark, before)


def test_workers_keep_no_encoder_states(spark):
    docs = spark.createDataFrame(texts(40), "doc_id bigint, text string").coalesce(1)

    def held(batches):
        list(batches)
        import pyarrow as pa

        sizes = [len(p.states.units) for p in pieces._loaded.values()]
        yield pa.RecordBatch.from_arrays([pa.array([len(sizes)], pa.int32()), pa.array([sum(sizes)], pa.int32())], ["encoders", "states"])

    pieces.encoded(docs).collect()
    # as many tasks as there may be idle workers
    seen = spark.range(64).repartition(8).mapInArrow(held, "encoders int, states int").collect()
    assert sum(r["states"] for r in seen) == 0


def test_ids_of_no_piece_decode_to_replacement_characters(spark):
    rows = spark.createDataFrame([(1, [-1, 10**6, None])], "k int, piece_ids array<int>")
    assert pieces.decoded(rows).first()["decoded"] == "\ufffd" * 2  # the first one stands for the white space in front


def test_tasks_end_by_giving_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(vec, "freed", lambda: calls.append(1))
    rows = vec.freed_after(lambda batches: (b + 1 for b in batches))
    assert list(rows(iter([1, 2]))) == [2, 3] and len(calls) == 1
    begun = rows(iter([1, 2]))
    next(begun)
    begun.close()
    assert len(calls) == 2


def test_small_tables_of_a_sample_need_no_python_workers(spark):
    docs = spark.createDataFrame([(f"text {i}", "ab"[i % 2]) for i in range(20)], "text string, lang string").localCheckpoint()
    sample = langid.sample_by_label(docs, docs["lang"], "text", 100)
    assert "ExistingRDD[_" not in sample._jdf.queryExecution().toString()
    assert sorted((r["label"], r["weight"]) for r in sample.collect()) == [("a", 1.0)] * 10 + [("b", 1.0)] * 10


def test_stages_use_small_batches(spark):
    held = spark.conf.get(BATCH)
    docs = spark.range(5000).selectExpr("id as doc_id", "'some words' as text", "'en' as lang").coalesce(1)

    def rows(batches):
        import pyarrow as pa

        yield from (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches)

    try:
        corpus_pipeline.identify_language(spark, docs, "")
        assert max(r["n"] for r in docs.mapInArrow(rows, "n bigint").collect()) <= BATCH_ROWS
        spark.conf.set(BATCH, 7)
        corpus_pipeline.encode_pieces(spark, docs, "")
        assert spark.conf.get(BATCH) == "7"
    finally:
        spark.conf.set(BATCH, held)
