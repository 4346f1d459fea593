"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Each 5-word shingle is hashed once. The top 8 bits of the hash choose one of 256 bins; a bin
keeps its smallest hash. An empty bin takes the value of another one: the first that is not
empty in its own fixed random order of all bins, which is the same for all documents. Of each
value the low 8 bits are kept, so a fingerprint is 256 bytes, written as 512 hex digits.
``likeness`` is the share of equal bytes, corrected for the 1 in 256 that agree by chance.

The bins of a document are found without grouping: its hashes and one end mark per bin are
sorted together, and the first value of each bin is its minimum, or the mark if it is empty.
All steps are built-in functions of arrays.

Defined cases: a text of 1 to 4 words is one shingle; a text without words (null included) has
the fingerprint '' (likeness 1 to another such, 0 to any other). Rows of equal ids follow each
other in the order of a hash of their texts; rows without an id come last.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import query, table
from .decontaminate import LOWER, UPPER

WIDTH = 5
BINS = 256
TRIES = 16
NEXT_ROWS = 1024
NEXT_BUCKETS = 10_000
LOW_56 = (1 << 56) - 1


def _mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ((1 << 64) - 1)
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ((1 << 64) - 1)
    return x ^ x >> 31


def donor_orders() -> list[list[int]]:
    """For each bin, the order in which the others are asked if it is empty."""
    return [sorted(range(BINS), key=lambda b, i=i: _mix(i * BINS + b)) for i in range(BINS)]


def _constant(values: list, kind: str) -> Column:
    """A constant array, which Spark folds to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def fingerprints(df: DataFrame, **texts: str) -> DataFrame:
    """``df`` with a fingerprint column for each given text column: ``name="text column"``."""
    marks = _constant([((b - BINS // 2) << 56) | LOW_56 for b in range(BINS)], "bigint")
    orders = donor_orders()
    names = list(texts)

    def step(df: DataFrame, made: str, fn) -> DataFrame:
        return df.withColumns({f"_{made}_{n}": fn(n) for n in names})

    def hashes(n: str) -> Column:
        words = F.col(f"_words_{n}")
        last = F.size(words) - WIDTH
        spread = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)])
        )
        short = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
        return F.sort_array(F.concat(F.when(last >= 0, spread).otherwise(short), marks))

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, 56)

    def minima(n: str) -> Column:
        ordered = F.col(f"_ordered_{n}")
        return F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1))))

    def values(n: str) -> Column:
        low = F.lit(LOW_56)
        return F.transform(F.col(f"_minima_{n}"), lambda x: F.when(x.bitwiseAND(low) != low, x.bitwiseAND(F.lit(255)).cast("int")))

    def dense(n: str) -> Column:
        got = F.col(f"_values_{n}")
        tries = [_constant([o[k] for o in orders], "int") for k in range(TRIES)]
        whole = _constant([b for o in orders for b in o], "int")

        def fill(v: Column, i: Column) -> Column:
            rest = F.get(F.filter(F.transform(F.slice(whole, i * BINS + 1, BINS), lambda b: F.get(got, b)), lambda x: x.isNotNull()), F.lit(0))
            return F.coalesce(v, *[F.get(got, F.get(t, i)) for t in tries], rest)

        return F.transform(got, fill)

    digits = _constant([f"{b:02x}" for b in range(256)], "string")
    df = step(df, "words", lambda n: F.filter(
        F.split(F.translate(F.coalesce(texts[n], F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = step(df, "ordered", hashes)
    df = step(df, "minima", minima)
    df = step(df, "values", values)
    df = step(df, "dense", dense)
    df = df.withColumns({
        n: F.when(F.size(f"_words_{n}") == 0, F.lit("")).otherwise(
            F.array_join(F.transform(f"_dense_{n}", lambda v: F.get(digits, v)), ""))
        for n in names
    })
    return df.drop(*[f"_{made}_{n}" for made in ("words", "ordered", "minima", "values", "dense") for n in names])


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1."""
    x, y = F.unhex(a), F.unhex(b)
    equal = F.aggregate(
        F.sequence(F.lit(1), F.lit(BINS)), F.lit(0),
        lambda n, i: n + (F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int"),
    )
    chance = 1 / 256
    corrected = (equal / BINS - chance) / (1 - chance)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(corrected, F.lit(0.0)))


def in_order(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, Window]:
    """``docs`` dealt to ranges of descending ids, and the window over a range.

    Of each range the first row also comes, marked ``_copy``, after the last row of the range
    before it (of the first range: after the last of all), so that the next document of
    any row is in its own range. There are at most NEXT_BUCKETS ranges, cut at quantiles.
    """
    count = docs.count()
    ranges = min(NEXT_BUCKETS, math.ceil(count / NEXT_ROWS))
    docs = docs.withColumn("_at", F.col(key).cast("double"))
    cuts: list[float] = []
    if ranges > 1:
        cuts = sorted(set(docs.approxQuantile("_at", [k / ranges for k in range(1, ranges)], 0.1 / ranges)))
    splits = [-math.inf, *(cuts or [0.0]), math.inf]
    docs = Bucketizer(splits=splits, inputCol="_at", outputCol="_range", handleInvalid="keep").transform(docs)
    docs = docs.withColumn("_range", F.when(F.col("_at").isNull(), -1).otherwise(F.col("_range").cast("int"))).drop("_at")
    heads = docs.groupBy("_range").agg(F.max(key).alias("_head")).orderBy(F.desc("_range")).collect()  # one row per range
    moved = [(heads[i]["_range"], heads[i]["_head"], heads[i - 1]["_range"]) for i in range(len(heads))]
    spark = docs.sparkSession
    heads = spark.createDataFrame(moved, "_of int, _head bigint, _to int")
    home = F.struct(F.col("_range"), F.lit(False).alias("_copy"))
    both = F.array(home, F.struct(F.col("_to").alias("_range"), F.lit(True).alias("_copy")))
    placed = (
        docs.join(F.broadcast(heads), F.col("_range") == F.col("_of"))
        .withColumn("_place", F.explode(F.when(F.col(key).eqNullSafe(F.col("_head")), both).otherwise(F.array(home))))
        .select(*[c for c in docs.columns if c != "_range"], "_place.*")
    )
    window = Window.partitionBy("_range").orderBy("_copy", F.col(key).desc_nulls_last(), "_tie")
    return placed, window


@query()
def op2_fingerprints(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed, window = in_order(docs.withColumn("_tie", F.xxhash64("text")), "doc_id", "text")
    kept = F.length("text") - F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), F.substring("_next", F.lit(1), F.length("text") - kept))
    texts = placed.withColumn("_next", F.lead("text").over(window)).withColumn("_edited", edited)
    marked = fingerprints(texts, fingerprint="text", edited_fingerprint="_edited").select(
        "doc_id", "_range", "_copy", "_tie", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
    )
    ahead = marked.withColumn("_following", F.lead("fingerprint").over(window)).filter("not _copy")
    return ahead.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        likeness(F.col("fingerprint"), F.col("_following")).alias("near_next"),
    )
