"""Benchmark decontamination: a prefix-filtered containment join over item-sized windows.

Both sides are cut into words. A window of an item is ``width`` consecutive words of it (all
its words if it has fewer). A document contains a window if the words occur in it in
a row; so at full containment every shingle of the window is necessary, and a prefix
of one shingle is enough: the one that is rarest in the documents. The steps:

1. count, over all documents, the shingles that occur in items (rarity);
2. take the rarest shingle of each distinct window and its offset in the window;
3. join it with the shingles of the documents; the shingle's position and the offset give
   the only place where the window can be, which must lie within the document (positional and
   length bounds);
4. compare that item-sized slice of the document with the window, word by word;
5. unite the hit spans of each document and gather the items it has windows of.

Everything is DataFrame operations. The items' shingles are broadcast only if there are at most
``BROADCAST_ROWS`` of them (counted); beyond that the same joins are shuffled.

Defined cases: null and empty texts have no words; an item without words has no window; equal
windows of several items count for each of them. Repeated rows of documents give a row each.
A null item id is no item. Rows of documents are told apart by id and a hash of the text.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import use_checkpoint_dir
from .catalog import query, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = 13
SHINGLE = 3
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingle_columns(words: Column, size: int) -> Column:
    """Array of structs of ``size`` words in a row, one for each start."""
    count = F.greatest(F.size(words) - (size - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(words, k + 1, count).alias(f"w{k}") for k in range(size)])


def shingles(df: DataFrame, size: int, *keep: str) -> DataFrame:
    """(keep..., pos, shingle) of each shingle of ``size`` words; pos from 0."""
    rows = df.select(*keep, F.posexplode(shingle_columns(F.col("words"), size)).alias("pos", "s"))
    parts = [F.col(f"s.w{k}") for k in range(size)] if size > 1 else [F.col("s.w0")]
    return rows.select(*keep, "pos", F.xxhash64(F.lit(size), *parts).alias("shingle"))


class _Items:
    """Distinct windows of the items and their shingles, in checkpoint files."""

    def __init__(self, items: DataFrame, key: str, text: str, width: int, shingle: int):
        use_checkpoint_dir(items.sparkSession)
        words = items.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
        words = words.filter(F.size("words") > 0)
        length = F.least(F.size("words"), F.lit(width))
        starts = F.sequence(F.lit(1), F.size("words") - length + 1)
        rows = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, length))).alias("words"))
        rows = rows.select("item", "words", F.xxhash64("words").alias("window")).distinct()
        self.by_item = rows.select("window", "item").checkpoint()
        self.windows = rows.groupBy("window", "words").agg(F.count(F.lit(1)).alias("items")).select("window", "words").checkpoint()
        sizes = self.windows.select(F.least(F.size("words"), F.lit(shingle)).alias("k")).distinct()
        self.sizes = sorted(r["k"] for r in sizes.collect())  # at most ``shingle`` numbers
        parts = [
            shingles(self.windows.filter(F.least(F.size("words"), F.lit(shingle)) == k), k, "window") for k in self.sizes
        ]
        self.shingles = None
        for part in parts:
            self.shingles = part if self.shingles is None else self.shingles.union(part)
        if self.shingles is not None:
            self.shingles = self.shingles.checkpoint()
            self.small = self.shingles.count() <= BROADCAST_ROWS


def _fits(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", width: int = WIDTH, shingle: int = SHINGLE,
) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, text_hash) of each row of ``docs``.

    ``text_hash`` is xxhash64 of the text, so that results of an id can be told apart.
    """
    bench = _Items(items, item_key, item_text, width, shingle)
    docs = docs.select(
        F.col(key).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), words_of(F.col(text)).alias("words")
    )
    counted = docs.select("id", "text_hash", F.size("words").cast("bigint").alias("n_words"))
    if bench.shingles is None:
        hits = counted.select("id", "text_hash", F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), F.lit("").alias("items")).filter("false")
    else:
        hits = _hits(docs, bench)
    joined = counted.join(
        hits.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "n_hit", "n_items", "items"),
        F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left",
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        F.col("id").alias(key), "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "text_hash",
    )


def _hits(docs: DataFrame, bench: _Items) -> DataFrame:
    """(id, text_hash, n_hit, n_items, items) of documents with a window."""
    wanted = bench.shingles.select("shingle").distinct()
    seen = None
    for k in bench.sizes:
        part = shingles(docs, k).join(_fits(wanted, bench.small), "shingle").select("shingle")
        seen = part if seen is None else seen.union(part)
    rarity = seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen"))
    order = bench.shingles.join(rarity, "shingle")  # a window with a shingle that no document has drops out below
    rarest = order.groupBy("window").agg(
        F.min(F.struct("seen", "shingle", "pos")).alias("first"), F.count(F.lit(1)).alias("known")
    )
    asked = bench.shingles.groupBy("window").agg(F.count(F.lit(1)).alias("asked"))
    prefix = (
        bench.windows.join(rarest, "window").join(asked, "window").filter("known = asked")
        .select("window", F.col("words").alias("window_words"), F.col("first.shingle").alias("shingle"), F.col("first.pos").alias("offset"))
        .checkpoint()
    )
    start, length = F.col("pos") - F.col("offset"), F.size("window_words")
    found = None
    for k in bench.sizes:
        if bench.small:
            places = shingles(docs, k, "id", "text_hash", "words").join(F.broadcast(prefix), "shingle")
        else:
            narrow = shingles(docs, k, "id", "text_hash").join(prefix, "shingle").filter(start >= 0)
            places = narrow.withColumnsRenamed({"id": "_id", "text_hash": "_hash"}).join(
                docs, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
            )
        part = (
            places.filter((start >= 0) & (start + length <= F.size("words")))
            .filter(F.slice("words", start + 1, length) == F.col("window_words"))
            .select("id", "text_hash", "window", start.alias("start"), (start + length).alias("end"))
        )
        found = part if found is None else found.union(part)
    found = found.distinct().checkpoint()
    # words hit: each span counts from where the earlier spans of the document end
    before = Window.partitionBy("id", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("id", "text_hash", "start").agg(F.max("end").alias("end"))
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    n_hit = spans.withColumn("new", new).groupBy("id", "text_hash").agg(F.sum("new").cast("bigint").alias("n_hit"))
    # the items of a document are at most those of the benchmark
    named = found.select("id", "text_hash", "window").distinct().join(_fits(bench.by_item, bench.small), "window")
    listed = named.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("list")).select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.size("list").cast("bigint").alias("n_items"), F.array_join("list", ",").alias("items")
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return n_hit.join(listed, same).select("id", "text_hash", "n_hit", "n_items", "items")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, unnest([array_to_string(w[i:i+least(len(w), 13)-1], ' ') FOR i IN range(1, len(w) - least(len(w), 13) + 2)]) AS win,
    least(len(w), 13) AS n FROM b WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, unnest([{'i': i, 'win': array_to_string(w[i:i+n-1], ' ')} FOR i IN range(1, len(w) - n + 2)]) AS p
  FROM d, lengths WHERE len(w) >= n
), hits AS (
  SELECT p.doc_id, p.p.i AS i, p.n, x.item_id FROM places p JOIN windows x ON x.win = p.p.win AND x.n = p.n
), hit_words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query(OP1_SQL)
def op1_decontamination(spark, folder):
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return contaminated(docs.select("doc_id", "text"), items.select("item_id", "text")).drop("text_hash")
