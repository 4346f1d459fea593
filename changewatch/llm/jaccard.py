"""Exact self-join of word-shingle sets at a Jaccard threshold, with set-relation skipping.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Documents of equal
sets are one class from the first pass on. Two classes can only reach the threshold if
they share a token of their prefixes (the first n - ceil(t n) + 1 tokens in one order of
all tokens), so the prefixes' tokens are indexed: one list of (set, size, position) per
token. The order puts rare tokens first: tokens known to be frequent come last, by
frequency, the others in hash order. Frequencies are counted over all documents, by
stretches of ``STRETCH`` tokens of which those seen less than ``STRETCH_MIN`` times are
not passed on; the order only steers work and never changes the result.

Two relations between sets then save work:

* *Positions in lists.* A list is cut into blocks of similar set size. A block is skipped
  if the best size and position in it cannot reach the overlap that the threshold asks for;
  the rows of the other blocks face the same test.
  The last lists of a set by position are skipped: sets that link share k tokens of their prefixes,
  k by their sizes, so where they first meet each has k lists left.
* *Answers of similar sets.* Each set is first compared only with the hubs of its lists (the
  sets with the largest share of their prefix in lists, so the likely originals of near
  copies). A hub's answers stand for those of the sets found similar to it: these are
  connected already and are not compared with each other. What is left in a list are
  sets outside its largest component; they are compared with all others of it, but for pairs
  which their answers to a common hub rule out:
  |x & y| <= min(|x & hub|, |y & hub|) + min(|x - hub|, |y - hub|).

So components are exact, while a group of m near copies costs about m comparisons.
Comparisons read both whole texts.

Defined cases: a text of 1 to 4 words is one shingle; a null or empty text or one without
words has no set and is linked with nothing, not even with its like. Repeated rows are
equal sets. A null id is passed through; it is ignored where the smallest id is taken.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffles_freed, use_checkpoint_dir
from .catalog import query, stored, table
from .components import components
from .vec import Hasher, freed_after, lower_table, shingle_hashes, slices, space_table, splitmix, word_spans

WIDTH = 5
THRESHOLD = (75, 100)
FREQUENT = 100_000
STRETCH = 2_000_000
STRETCH_MIN = 4
POSTINGS_PER_BUCKET = 128_000

BROADCAST_ROWS = 500_000

POSTING = np.dtype([("token", "<u8"), ("sid", "<i8"), ("pos", "<u4")])


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, tokens, row of each) by slice; a row's tokens are distinct and ascending."""
    lower, space, hasher = lower_table(), space_table(), Hasher(8)
    for first, data, offsets in slices(column):
        data = lower[data]
        start, end, row = word_spans(data, offsets, space)
        tokens, rows = shingle_hashes(hasher.spans(hasher.sums(data), start, end), row, len(offsets) - 1, WIDTH)
        order = np.argsort(tokens)
        small = rows[order].astype(np.uint16 if len(offsets) < 1 << 16 else np.uint32)
        order = order[np.argsort(small, kind="stable")]
        tokens, rows = tokens[order], rows[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])
        yield first, len(offsets) - 1, tokens[fresh], rows[fresh]


def digests(tokens: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(set digest, set size) of each row; the digest of an empty set is 0."""
    size = np.bincount(rows, minlength=n_rows)
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(splitmix(tokens), dtype=np.uint64, out=total[1:])
    ends = np.concatenate([[0], np.cumsum(size)])
    digest = total[ends[1:]] - total[ends[:-1]]
    return np.where(size > 0, splitmix(digest + size.astype(np.uint64)), 0).astype(np.uint64).view(np.int64), size


@freed_after
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: (id, digest, n) of each document, and (token, seen) of frequent tokens."""
    names = ["id", "th", "sid", "n", "token", "seen"]
    kept: list[np.ndarray] = []
    held, known = 0, set()

    def counted() -> pa.RecordBatch:
        tokens, seen = np.unique(np.concatenate(kept), return_counts=True)
        often = seen >= STRETCH_MIN
        tokens, seen = tokens[often].view(np.int64), seen[often]
        nothing = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.array(tokens), pa.array(seen)], names)

    for batch in batches:
        for first, n_rows, tokens, rows in shingle_sets(batch.column(1)):
            digest, size = digests(tokens, rows, n_rows)
            new = np.zeros(n_rows, bool)
            for i, d in enumerate(digest.tolist()):
                if d not in known:
                    known.add(d)
                    new[i] = True
            kept.append(tokens[new[rows]])
            held += len(kept[-1])
            nothing = pa.nulls(n_rows, pa.int64())
            ids = [batch.column(k).slice(first, n_rows) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(digest, mask=size == 0), pa.array(size), nothing, nothing], names
            )
            if held >= STRETCH:
                yield counted()
                kept, held, known = [], 0, set()
    if held:
        yield counted()


def prefix_length(size: np.ndarray, part: int, whole: int) -> np.ndarray:
    return size - -(-part * size // whole) + 1


def _index(frequent, buckets: int, part: int, whole: int):
    """Second pass: prefix postings, frequent tokens as rows and the others packed by bucket of tokens."""
    names = ["bucket", "packed", "token", "sid", "pos"]

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        posts = np.concatenate(held)
        posts = posts[np.argsort(posts["token"])]
        bucket = ((posts["token"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        parts = [_pack(p) for p in np.split(posts, first[1:])]
        nothing = pa.nulls(len(parts), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[first]), pa.array(parts, pa.binary()), nothing, nothing, pa.nulls(len(parts), pa.int32())], names
        )

    @freed_after
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = frequent.value
        held: list[np.ndarray] = []
        known: set[int] = set()
        for batch in batches:
            for _, n_rows, tokens, rows in shingle_sets(batch.column(0)):
                digest, size = digests(tokens, rows, n_rows)
                at = np.minimum(np.searchsorted(hot, tokens), max(len(hot) - 1, 0))
                is_hot = hot[at] == tokens if len(hot) else np.zeros(len(tokens), bool)
                # first the others, which are in hash order already, then the frequent ones by rank
                last = np.flatnonzero(is_hot)
                last = last[np.lexsort((rank[at[last]], rows[last]))] if len(last) else last
                n_hot = np.bincount(rows[last], minlength=n_rows)
                pos = np.empty(len(tokens), np.int64)
                for index, count, shift in ((np.flatnonzero(~is_hot), size - n_hot, 0 * size), (last, n_hot, size - n_hot)):
                    begin = np.cumsum(count) - count
                    pos[index] = np.arange(len(index)) - begin[rows[index]] + shift[rows[index]]
                new = np.zeros(n_rows, bool)
                for i, d in enumerate(digest.tolist()):
                    if d not in known:  # repeated documents once
                        known.add(d)
                        new[i] = True
                use = (pos < prefix_length(size, part, whole)[rows]) & new[rows]
                posts = np.zeros(int(use.sum()), POSTING)
                posts["token"], posts["pos"] = tokens[use], pos[use]
                posts["sid"] = digest[rows[use]]
                is_hot = is_hot[use]
                held.append(posts[~is_hot])
                often = posts[is_hot]
                if len(often):
                    n = len(often)
                    columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
                    columns += [pa.array(np.ascontiguousarray(often["token"]).view(np.int64))]
                    columns += [pa.array(np.ascontiguousarray(often["sid"])), pa.array(often["pos"].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names)
            if sum(map(len, held)) >= 1_000_000:
                yield packed(held)
                held, known = [], set()
        if sum(map(len, held)):
            yield packed(held)

    return indexed


def _pack(posts: np.ndarray) -> bytes:
    """Postings of a bucket by column, with the low half of the tokens.

    Of two tokens of a bucket with equal low halves the lists become one, which adds
    candidates but loses none.
    """
    return b"".join(
        (posts["token"].astype(np.uint32).tobytes(), np.ascontiguousarray(posts["sid"]).tobytes(), np.ascontiguousarray(posts["pos"]).tobytes())
    )


def _unpack(packed: bytes) -> np.ndarray:
    n = len(packed) // 16
    posts = np.zeros(n, POSTING)
    posts["token"] = np.frombuffer(packed, np.uint32, n)
    posts["sid"] = np.frombuffer(packed, np.int64, n, 4 * n)
    posts["pos"] = np.frombuffer(packed, np.uint32, n, 12 * n)
    return posts


def _lists(bucket: int, group: pa.Table) -> pa.Table:
    """Postings of the tokens of a bucket that more than one set has.

    A bucket holds about POSTINGS_PER_BUCKET postings of tokens that are not frequent.
    """
    posts = np.concatenate([_unpack(p) for p in group.column("packed").to_pylist()])
    token, n = np.unique(posts["token"], return_counts=True)
    posts = posts[n[np.searchsorted(token, posts["token"])] > 1]
    posts = posts[np.lexsort((posts["pos"], posts["sid"], posts["token"]))]
    again = np.zeros(len(posts), bool)  # a set that several stretches have
    again[1:] = (posts["token"][1:] == posts["token"][:-1]) & (posts["sid"][1:] == posts["sid"][:-1])
    again[1:] &= posts["pos"][1:] == posts["pos"][:-1]
    posts = posts[~again]
    same = np.flatnonzero(posts["token"][1:] == posts["token"][:-1])
    posts = posts[np.union1d(same, same + 1)]
    token = posts["token"].astype(np.int64) | bucket << 32
    return pa.table(
        {"token": pa.array(token), "sid": pa.array(np.ascontiguousarray(posts["sid"])), "pos": pa.array(posts["pos"].astype(np.int32))}
    )


@freed_after
def _matching_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sid, text) whose text has that digest; an id may stand for several texts."""
    for batch in batches:
        for first, n_rows, tokens, rows in shingle_sets(batch.column(1)):
            digest, _ = digests(tokens, rows, n_rows)
            part = batch.slice(first, n_rows)
            yield part.filter(pa.array(part.column(0).to_numpy(zero_copy_only=False) == digest))


@freed_after
def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, shared, united) of rows (a, b, text_a, text_b)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets: list[list[np.ndarray]] = [[], []]
            for side in (0, 1):
                for _, n_rows, tokens, rows in shingle_sets(part.column(2 + side)):
                    sets[side] += np.split(tokens, np.cumsum(np.bincount(rows, minlength=n_rows))[:-1])
            shared = np.array(
                [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)], np.int64
            )
            united = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)], np.int64) - shared
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(shared), pa.array(united)], ["a", "b", "shared", "united"]
            )


def _reachable(part: int, whole: int, nx: str, px: str, ny: str, py: str) -> Column:
    """Whether sets of these sizes that first meet at these positions may reach the threshold."""
    return F.expr(
        f"{whole} * least({nx}, {ny}) >= {part} * greatest({nx}, {ny})"
        f" and {whole + part} * least({nx} - {px}, {ny} - {py}) >= {part} * ({nx} + {ny})"
    )


class _Search:
    def __init__(self, docs: DataFrame, key: str, text: str, threshold: tuple[int, int]):
        self.spark = docs.sparkSession
        use_checkpoint_dir(self.spark)
        self.part, self.whole = threshold
        self.docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
        hashed = self.docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
        described = hashed.mapInArrow(
            _describe, "id bigint, th bigint, sid bigint, n bigint, token bigint, seen bigint"
        ).checkpoint()
        self.described = described.filter("token is null").select("id", "th", "sid", "n")
        self.frequent = described.filter("token is not null").select("token", "seen")
        self.classes = (
            self.described.filter("sid is not null").groupBy("sid").agg(F.min("id").alias("first_id"), F.max("n").alias("n"))
        )

    def postings(self) -> DataFrame:
        top = self.frequent.groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(FREQUENT)
        top = top.toPandas()
        hot = top["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hot)
        rank = np.arange(len(hot), 0, -1).astype(np.uint64)  # the most frequent last
        frequent = self.spark.sparkContext.broadcast((hot[order], rank[order]))
        sizes = self.described.agg(F.sum(F.floor(F.col("n") * (self.whole - self.part) / self.whole) + 1)).first()[0]
        buckets = max(8, math.ceil((sizes or 0) / POSTINGS_PER_BUCKET))
        rows = self.docs.select("text").mapInArrow(
            _index(frequent, buckets, self.part, self.whole),
            "bucket bigint, packed binary, token bigint, sid bigint, pos int",
        )
        # both kinds in one pass: frequent tokens have buckets of their own, by token and set
        tagged = rows.select(
            F.coalesce("bucket", -1 - F.pmod(F.xxhash64("token", "sid"), F.lit(buckets))).alias("bucket"),
            "packed", "token", "sid", "pos",
        )

        def lists(group: pa.Table) -> pa.Table:
            bucket = group.column("bucket")[0].as_py()
            hot = bucket < 0
            found = group.select(["token", "sid", "pos"]).group_by(["token", "sid", "pos"]).aggregate([]) if hot else _lists(bucket, group)
            return found.append_column("hot", pa.array(np.full(len(found), hot)))

        return tagged.groupBy("bucket").applyInArrow(lists, "token bigint, sid bigint, pos int, hot boolean").checkpoint()

    def texts(self, sids: DataFrame) -> DataFrame:
        """(sid, text) of these sets; few sets are broadcast (they are counted), others shuffled with the documents."""
        wanted = sids.distinct().join(self.classes.select("sid", "first_id"), "sid").checkpoint()
        chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        found = self.docs.join(chosen, F.col("id").eqNullSafe(F.col("first_id"))).select("sid", "text")
        return stored(found.mapInArrow(_matching_text, "sid bigint, text string"))

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(a, b, shared, united) of those pairs (a, b) of sets that their lists leave possible.

        What two sets share is at most the tokens of both prefixes, plus what one of them has
        after its prefix. That needs only the tokens that other sets have in their prefixes, too.
        """
        left = self.tokens.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
        right = self.tokens.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
        shared = F.size(F.array_intersect("ta", "tb")) + F.size("ta") - F.size(F.array_distinct("ta"))
        most = shared + F.greatest(F.col("na") - self.prefix("na"), F.col("nb") - self.prefix("nb"))
        possible = (self.whole + self.part) * most >= self.part * (F.col("na") + F.col("nb"))
        pairs = pairs.join(left, "a").join(right, "b").filter(possible).select("a", "b").checkpoint()
        texts = self.texts(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")))
        left = texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_compared, "a bigint, b bigint, shared bigint, united bigint")

    def prefix(self, n: str) -> Column:
        return F.col(n) - F.ceil(F.col(n) * self.part / self.whole) + 1

    def linked(self) -> Column:
        return F.expr(f"{self.whole} * shared >= {self.part} * united")

    def labelled(self, lists: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of lists with their component, without lists that are inside one component."""
        named = lists.join(roots.toDF("sid", "root"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")
        shares = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
        major = shares.groupBy("token").agg(
            F.max(F.struct("k", "comp"))["comp"].alias("major"), F.count(F.lit(1)).alias("comps")
        )
        return named.join(major.filter("comps > 1"), "token").checkpoint()

    def components(self) -> DataFrame:
        part, whole = self.part, self.whole
        posts = self.postings()
        # of tokens that are not frequent, only those of several sets are left
        often = posts.filter("hot")
        several = often.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token")
        several = posts.filter("not hot").union(often.join(several, "token", "left_semi")).drop("hot")
        share = (
            posts.groupBy("sid").agg(F.count(F.lit(1)).alias("k"))
            .join(self.classes, "sid").select("sid", "n", (F.col("k") / self.prefix("n")).alias("share"))
        )
        # how many lists a set has from each place on
        left = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("pos"), "token"))
        lists = several.join(share, "sid").withColumn("left", left).checkpoint()
        self.tokens = lists.groupBy("sid").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens")).checkpoint()
        # the hubs of each list; a set meets the one that it shares most lists with
        hubs = lists.groupBy("token").agg(F.max(F.struct("share", "sid", "n", "pos")).alias("hub"))
        met = (
            lists.join(hubs, "token")
            .filter("sid != hub.sid")
            .filter(_reachable(part, whole, "n", "pos", "hub.n", "hub.pos"))
            .groupBy("sid", F.col("hub.sid").alias("hub"))
            .agg(F.count(F.lit(1)).alias("k"))
            .groupBy("sid")
            .agg(F.max(F.struct("k", "hub"))["hub"].alias("hub"))
            .checkpoint()
        )
        pairs = met.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct()
        answers = self.compare(pairs).checkpoint()
        both = answers.select(F.col("a").alias("sid"), F.col("b").alias("hub"), "shared")
        both = both.union(answers.select("b", "a", "shared"))
        self.near = both.join(met, ["sid", "hub"], "left_semi").checkpoint()
        hubs_too = self.near.select(F.col("hub").alias("sid"), "hub").distinct().join(self.classes.select("sid", "n"), "sid")
        self.near = self.near.union(hubs_too.join(self.near.select("sid"), "sid", "left_anti").select("sid", "hub", "n"))
        links = answers.filter(self.linked()).select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = components(links)
        rest = self.labelled(lists.drop("share").join(self.near.withColumnRenamed("shared", "with_hub"), "sid", "left"), roots)
        if rest.isEmpty():
            return roots
        found = self.compare(self.remaining(rest)).filter(self.linked()).checkpoint()
        return roots if found.isEmpty() else components(roots.union(found.select("a", "b")))

    def by_hub(self) -> Column:
        """Whether the answers of a common hub leave a pair possible.

        What two sets share is at most what both share with the hub, as far as the smaller
        share goes, plus what the one with less beside the hub has there.
        """
        same = F.coalesce(F.col("hub") == F.col("hub_a"), F.lit(False))
        most = F.least("with_hub", "with_a") + F.least(F.col("n") - F.col("with_hub"), F.col("na") - F.col("with_a"))
        return ~same | ((self.whole + self.part) * most >= self.part * (F.col("n") + F.col("na")))

    def remaining(self, rest: DataFrame) -> DataFrame:
        """All pairs of a list in different components that nothing rules out."""
        part, whole = self.part, self.whole
        # sizes of one class differ by less than a factor of 4/3: linked sets are in the same or neighbouring ones
        size = F.floor(F.log(F.col("n").cast("double")) / math.log(whole / part)).cast("int")
        order = Window.partitionBy("sid").orderBy("pos", "token")
        rows = rest.withColumns({"size": size, "before": F.lag("token").over(order), "before2": F.lag("token", 2).over(order)})
        blocks = rows.groupBy("token", "size").agg(
            F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("pos").alias("pos_min"),
            F.min("comp").alias("comp_min"), F.max("comp").alias("comp_max"),
        )
        probes = rows.filter("comp != major").select(
            "token", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"),
            F.col("sid").alias("a"), F.col("comp").alias("comp_a"), F.col("n").alias("na"), F.col("pos").alias("pa"),
            F.col("left").alias("left_a"), F.col("before").alias("before_a"), F.col("before2").alias("before2_a"), F.col("hub").alias("hub_a"), F.col("with_hub").alias("with_a"),
        )
        probes = (
            probes.join(blocks, ["token", "size"])
            .filter("comp_min != comp_a or comp_max != comp_a")
            .filter(f"{whole} * n_max >= {part} * na and {whole} * na >= {part} * n_min")
            .filter(f"{whole + part} * least(na - pa, n_max - pos_min) >= {part} * (na + n_min)")
            .select("token", "size", "a", "comp_a", "na", "pa", "left_a", "before_a", "before2_a", "hub_a", "with_a")
        )
        # Two sets that link share at least k tokens of their prefixes, so where they meet first each has k lists
        # left from there on (one less, for tokens that became one list)
        k = (F.col("na") + F.col("n")) * part / (whole + part) - F.greatest("na", "n") * part / whole - 1e-9
        enough = F.least("left_a", "left") >= F.ceil(k) - 1
        met = F.expr("coalesce(before_a in (before, before2), false) or coalesce(before2_a in (before, before2), false)")
        return (
            probes.join(rows, ["token", "size"])
            .filter("comp != comp_a")
            .filter(_reachable(part, whole, "na", "pa", "n", "pos"))
            .filter(self.by_hub())
            .filter(enough)
            # once per pair, as far as can be told: not if they met in one of the two lists before, or meet the other way round
            .filter(~met & ((F.col("comp") == F.col("major")) | (F.col("a") < F.col("sid"))))
            .select(F.least("a", "sid").alias("a"), F.greatest("a", "sid").alias("b"))
            .distinct()
        )


def similar_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD, root: bool = False) -> DataFrame:
    """(key, n_shingles, component_id, text_hash) of each row of ``docs``, with ``root`` also (root).

    ``text_hash`` is xxhash64 of the text, so that results of an id can be told apart. ``root`` is a set
    of the component and tells components apart where ids are null or repeat; it is null without a set.
    """
    with shuffles_freed(docs.sparkSession):
        search = _Search(docs, key, text, threshold)
        roots = search.components().toDF("sid", "root")
    named = search.classes.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_set = named.join(smallest, "root").select("sid", "component_id", "root")
    has = search.described.filter("sid is not null").join(by_set, "sid").select("id", "n", "component_id", "th", "root")
    none = search.described.filter("sid is null").select("id", "n", F.col("id").alias("component_id"), "th", F.lit(None).cast("bigint"))
    found = has.union(none).toDF(key, "n_shingles", "component_id", "text_hash", "root")
    return found if root else found.drop("root")


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS both_n, count(*) AS k
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2, 3
), links AS (
  SELECT x, y FROM shared WHERE 100 * k >= 75 * (both_n - k)
), edges AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id
FROM sets s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = s.doc_id
"""


@query(OP8_SQL)
def op8_jaccard_join(spark, folder):
    return similar_sets(table(spark, folder, "documents").select("doc_id", "text")).drop("text_hash")
