"""A corpus pipeline over ``documents``, of operators of ``changewatch.llm``.

STAGES lists (name, function); each function takes (spark, docs, folder) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``. Rows are told apart by doc_id and a hash of
the text, so ids that repeat or are null are judged row by row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changewatch.llm import decontaminate, jaccard, langid, pieces, suffix_dedup
from changewatch.llm.catalog import fold
from changewatch.session import use_checkpoint_dir, use_small_batches

BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` but for rows (doc_id, text_hash); few of them are broadcast (they are counted)."""
    dropped = dropped.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct().checkpoint()
    small = dropped.count() <= BROADCAST_ROWS
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash"))
    return docs.join(F.broadcast(dropped) if small else dropped, same, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents of no recognisable language."""
    use_small_batches(spark)
    held_out = fold(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.filter(~held_out & F.col("lang").isNotNull()))
    return langid.predict(docs, model).filter(langid.accepted()).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps of each group of similar documents the one of the smallest id (a row of it, if it repeats)."""
    use_checkpoint_dir(spark)
    use_small_batches(spark)
    sets = jaccard.similar_sets(docs, root=True).filter("n_shingles > 0").checkpoint()
    first = sets.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    judged = sets.join(first, "root").select("doc_id", "text_hash", "one")
    is_first = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_hash") == F.col("one.text_hash"))
    kept = _without(docs, judged.filter(~is_first))
    again = judged.filter(is_first).groupBy("doc_id", "text_hash").count().filter("count > 1").drop("count").checkpoint()
    if again.isEmpty():
        return kept
    # repeated rows of one id and text: one of each
    rows = kept.withColumns({"_text_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    marks = again.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    place = F.row_number().over(Window.partitionBy("doc_id", "_text_hash").orderBy(*others, "text"))
    single = rows.join(marks, same, "left_semi").withColumn("_place", place).filter("_place = 1")
    return rows.join(marks, same, "left_anti").select(*docs.columns).union(single.select(*docs.columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Removes repeated passages; bytes left of a character cut in two go as well. Other texts stay as they are."""
    use_small_batches(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = suffix_dedup.cut_repeats(docs.withColumn("_none", F.col("text").isNull()), keep=(*others, "_none"))
    whole = F.udf(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"), "string")
    rest = whole(F.when(F.col("n_removed") > 0, F.col("kept")))
    text = F.when(F.col("_none"), F.lit(None)).when(F.col("n_removed") > 0, rest).otherwise(F.col("kept").cast("string"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    use_checkpoint_dir(spark)
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    judged = decontaminate.contaminated(docs.select("doc_id", "text"), items)
    return _without(docs, judged.filter("contaminated"))


def encode_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The piece ids of each document left, with their number and digest and that of the text they decode to."""
    use_small_batches(spark)
    return pieces.digest_rows(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("pieces", encode_pieces),
]
ORACLE_SQL = None  # the language model and the encoder cannot be expressed in SQL; see tests/llm


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each result goes to a new folder of the shared checkpoint folder."""
    base = f"{use_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        out = f"{base}/{number}-{name}"
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
