"""Removal of repeated 200-byte strings across documents, by sorting suffixes.

A byte goes if it is in a ``WINDOW``-byte string that also starts elsewhere (in any document).
Sorting every suffix of the corpus would move each byte two hundred times, so suffixes are
sorted only where a repeat can begin:

1. *Anchors.* Of the ``GRAM``-byte strings in a window the one with the smallest hash (the
   last of equal ones) is its anchor. Equal windows have equal anchors at the same offset.
   The windows of one anchor form a run; the bytes they cover are its extent.
2. Anchors whose string occurs once cannot have repeated windows. The others are counted by
   extent: extents that occur twice are repeated as a whole, however many copies there are.
3. Of anchors with several distinct extents, one context (the bytes around it) per extent is
   sorted twice: suffixes starting at the anchor, and reversed prefixes ending before it.
   This is a deep-shallow sort: multikey quicksort on 8-byte characters to ``SHALLOW``
   bytes, and a blind trie for each group that is equal so far. The longest common prefixes of
   neighbours then tell, for every offset d, which contexts agree on d bytes to the left and
   WINDOW - d bytes to the right, which is when their windows at d are equal.

A sort handles a bucket of anchor groups of about ``CONTEXTS`` contexts. A group of more than
``GROUP`` distinct contexts is not sorted in one task: its windows are counted by a 128-bit
hash instead, with the same result. Spans are united per document when its text is cut, so
matches never cross documents and everything is judged on the input.

Defined cases: a null text is empty. Repeated rows are documents of their own and so repeats of
each other. Rows are told apart by id and a hash of the text. Texts of under WINDOW bytes
stay as they are. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import use_checkpoint_dir
from .catalog import query, stored, table, with_fields
from .vec import Hasher, freed_after, slices

SLICE = 1 << 18
WINDOW = 200
GRAM = 40
REACH = WINDOW - GRAM  # the largest offset of an anchor in its window
SHALLOW = 64
CONTEXTS = 5_000
GROUP = 20_000
PIECE = 1 << 23

ANCHOR = "ah bigint, eh bigint, id bigint, th bigint, at bigint, lo int, hi int"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, grams: Hasher, extents: Hasher):
    """Runs of windows: (anchor hash, extent hash, row, anchor position, first and last window)."""
    found = []
    # pieces overlap so that each window is in one of them as a whole
    for base in range(0, max(len(data) - WINDOW + 1, 0), PIECE):
        part = data[base : base + PIECE + WINDOW - 1]
        n = len(part) - WINDOW + 1
        sums = grams.sums(part)
        begin = np.arange(len(part) - GRAM + 1)
        value = grams.spans(sums, begin, begin + GRAM)
        keyed = (value & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - begin.astype(np.uint64))
        least = _sliding_min(keyed, REACH + 1)
        at = (np.uint64(0xFFFFFF) - (least & np.uint64(0xFFFFFF))).astype(np.int64)
        start = np.arange(n)
        row = np.searchsorted(offsets, start + base, side="right") - 1
        inside = start + base + WINDOW <= offsets[row + 1]
        start, at, row = start[inside], at[inside], row[inside]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        lo, hi, at, row = start[first], start[last], at[first], row[first]
        extent = extents.spans(extents.sums(part), lo, hi + WINDOW)
        found.append((value[at], extent, row, at + base, lo + base, hi + base))
    if not found:
        return [np.zeros(0, np.int64)] * 6
    return [np.concatenate(c) for c in zip(*found, strict=True)]


@freed_after
def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, extents = Hasher(51), Hasher(52)
    for batch in batches:
        for first, data, offsets in slices(batch.column(2), SLICE):
            value, extent, row, at, lo, hi = anchors(data, offsets, grams, extents)
            take = pa.array(first + row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(value.astype(np.uint64).view(np.int64)), pa.array(extent.astype(np.uint64).view(np.int64)),
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(at - offsets[row]),
                    pa.array((at - lo).astype(np.int32)), pa.array((at - hi).astype(np.int32)),
                ],
                ["ah", "eh", "id", "th", "at", "lo", "hi"],
            )


@freed_after
def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, eh, n, lo, hi, bytes from lo before the anchor to the end of its last window)."""
    for batch in batches:
        texts = batch.column(0).cast(pa.large_binary()).fill_null(b"")
        for i in range(batch.num_rows):
            spots = batch.column(1)[i].values
            if not len(spots):
                continue
            text = texts[i].as_py()
            spots = spots.flatten()
            lo, hi, at = (spots[k].to_pylist() for k in (3, 4, 5))
            yield pa.RecordBatch.from_arrays(
                [*spots[:5], pa.array([text[a - x : a - y + WINDOW] for a, x, y in zip(at, lo, hi, strict=True)], pa.binary())],
                ["ah", "eh", "n", "lo", "hi", "context"],
            )


class _Branch:
    """Inner node of a blind trie: strings below agree before ``pos`` and differ there."""

    __slots__ = ("kids", "pos")

    def __init__(self, pos: int, kids: dict):
        self.pos, self.kids = pos, kids


def _common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix of two strings of one length."""
    if x == y:
        return len(x)
    lo, hi = known, len(x)
    while hi - lo > 1:  # x[:lo] == y[:lo], x[:hi] != y[:hi]
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie_order(strings: list[bytes], known: int) -> list[int]:
    """Sorted order of strings of one length that agree on their first ``known`` bytes."""
    root: list[int] | _Branch = [0]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while type(node) is _Branch:  # blindly: only the branching bytes are looked at
            kids = node.kids
            node = kids.get(s[node.pos]) or next(iter(kids.values()))
        other = strings[node[0]]
        common = _common(s, other, known)
        if common == len(s):
            node.append(i)
            continue
        above, node = None, root
        while type(node) is _Branch and node.pos < common:
            above, node = node, node.kids[s[node.pos]]
        if type(node) is _Branch and node.pos == common:
            node.kids[s[common]] = [i]
            continue
        split = _Branch(common, {s[common]: [i], other[common]: node})
        if above is None:
            root = split
        else:
            above.kids[s[above.pos]] = split
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if type(node) is _Branch:
            todo += [node.kids[c] for c in sorted(node.kids, reverse=True)]
        else:
            order += node
    return order


def deep_shallow_order(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of bytes."""
    n, length = rows.shape
    order, group = np.arange(n), np.zeros(n, np.int64)
    depth = 0
    while depth < min(SHALLOW, length):
        # multikey quicksort: members of groups that are still tied, by their next character
        char = np.zeros((n, 8), np.uint8)
        char[:, : min(8, length - depth)] = rows[order, depth : depth + 8]
        char = char.view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((char, group))
        order, group, char = order[by], group[by], char[by]
        new = np.ones(n, bool)
        new[1:] = (group[1:] != group[:-1]) | (char[1:] != char[:-1])
        group = np.cumsum(new)
        depth += 8
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(first, n))
    for at, m in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        members = order[at : at + m]
        order[at : at + m] = members[blind_trie_order([rows[i].tobytes() for i in members], min(depth, length))]
    return order


def neighbour_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row and the one before it in the order; 0 for the first."""
    n, length = rows.shape
    out = np.zeros(n, np.int64)
    for at in range(1, n, 4096):
        here = order[at : at + 4096]
        differs = rows[here] != rows[order[at - 1 : at - 1 + len(here)]]
        out[at : at + len(here)] = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    return out


def repeated_offsets(contexts: list[bytes], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Matrix (context, d): whether its window that starts d before the anchor is also another's."""
    n = len(contexts)
    right, left = np.zeros((n, WINDOW), np.uint8), np.zeros((n, REACH), np.uint8)
    for i, (c, d) in enumerate(zip(contexts, lo.tolist(), strict=True)):
        b = np.frombuffer(c, np.uint8)
        right[i, : len(b) - d] = b[d:]
        left[i, :d] = b[:d][::-1]
    sorted_sides = []
    for side in (left, right):
        order = deep_shallow_order(side)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        sorted_sides.append((rank, neighbour_prefixes(side, order)))
    (left_rank, left_lcp), (right_rank, right_lcp) = sorted_sides
    out = np.zeros((n, REACH + 1), bool)
    for d in range(REACH + 1):
        have = np.flatnonzero((hi <= d) & (d <= lo))
        if len(have) < 2:
            continue
        same_left = np.cumsum(left_lcp < d)[left_rank[have]] if d else np.zeros(len(have), np.int64)
        same_right = np.cumsum(right_lcp < WINDOW - d)[right_rank[have]]
        _, at, count = np.unique(same_left * (n + 1) + same_right, return_inverse=True, return_counts=True)
        out[have, d] = count[at] > 1
    return out


def _sorted_bucket(group: pa.Table) -> pa.Table:
    """(ah, eh, from_d, to_d) of the repeated windows of contexts that occur once."""
    lo, hi = group.column("lo").to_numpy(), group.column("hi").to_numpy()
    flags = repeated_offsets(group.column("context").to_pylist(), lo, hi)
    flags[group.column("n").to_numpy() > 1] = False  # repeated as a whole
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    which, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return pa.table(
        {
            "ah": group.column("ah").take(pa.array(which)), "eh": group.column("eh").take(pa.array(which)),
            "from_d": pa.array(begin.astype(np.int32)), "to_d": pa.array((end - 1).astype(np.int32)),
        }
    )


@freed_after
def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, eh, d, h1, h2) of each window of a context."""
    one, two = Hasher(53), Hasher(54)
    for batch in batches:
        for i in range(batch.num_rows):
            lo, hi = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
            data = np.frombuffer(batch.column(5)[i].as_py(), np.uint8)
            start = np.arange(lo - hi + 1)
            h1, h2 = (h.spans(h.sums(data), start, start + WINDOW).view(np.int64) for h in (one, two))
            ah, eh = (pa.array([batch.column(k)[i].as_py()] * len(start), pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [ah, eh, pa.array((lo - start).astype(np.int32)), pa.array(h1), pa.array(h2)], ["ah", "eh", "d", "h1", "h2"]
            )


@freed_after
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text hash, rest, n_bytes, n_removed, n_spans, kept) of rows (id, text hash, rest, text, spans)."""
    names = ["id", "th", "rest", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        texts = batch.column(3).cast(pa.large_binary()).fill_null(b"")
        out: list[tuple[int, int, int, bytes]] = []
        held = done = 0

        def part() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            ids = [batch.column(k).slice(done, len(out)) for k in (0, 1, 2)]
            return pa.RecordBatch.from_arrays(
                [*ids, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names
            )

        for i in range(batch.num_rows):
            text = texts[i].as_py()
            kept, at, removed, spans = [], 0, 0, 0
            for begin, end in sorted((s["b"], s["e"]) for s in batch.column(4)[i].as_py() or []):
                if begin > at or spans == 0:
                    kept.append(text[at:begin])
                    removed, spans, at = removed + end - begin, spans + 1, end
                elif end > at:
                    removed, at = removed + end - at, end
            kept.append(text[at:])
            out.append((len(text), removed, spans, b"".join(kept)))
            held += len(out[-1][3])
            if held > 1 << 22:
                yield part()
                done, out, held = i + 1, [], 0
        if out:
            yield part()


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, text_hash, n_bytes, n_removed, n_spans, kept, *keep) of each row; kept is binary.

    ``text_hash`` is xxhash64 of the text, so that results of an id can be told apart.
    """
    use_checkpoint_dir(docs.sparkSession)
    rest = F.struct(F.lit(0).alias("_"), *keep)
    docs = docs.select(
        F.col(key).cast("bigint").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.col(text).alias("text"), rest.alias("rest")
    )
    found = docs.select("id", "th", "text").mapInArrow(_anchor_rows, ANCHOR)
    # read from files, so that AQE can split an anchor that very many texts have
    twice = found.groupBy("ah").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("ah").checkpoint()
    runs = stored(found.join(twice, "ah"))
    extents = runs.groupBy("ah", "eh").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "at", "lo", "hi")).alias("one")
    )
    extents = stored(extents.select("ah", "eh", "n", "one.*"))
    kinds = extents.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    # an extent of few windows may be inside another one, so all contexts of an anchor are compared
    asked = stored(extents.join(kinds, "ah"))
    total, most = asked.agg(F.count(F.lit(1)), F.max("kinds")).first()

    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    spots = asked.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(
        F.collect_list(F.struct("ah", "eh", "n", "lo", "hi", "at", "kinds")).alias("spots")
    )
    # all columns, so that both joins of the texts share one shuffle
    contexts = docs.join(spots, same).select("text", "spots", "rest").mapInArrow(
        _cut_contexts, "ah bigint, eh bigint, n bigint, lo int, hi int, context binary"
    )
    buckets = max(8, math.ceil((total or 0) / CONTEXTS))
    flagged = "ah bigint, eh bigint, from_d int, to_d int"
    if (most or 0) <= GROUP:
        large, small = None, contexts
    else:
        contexts = contexts.checkpoint()
        over = kinds.filter(F.col("kinds") > GROUP).select("ah")
        large, small = contexts.join(over, "ah", "left_semi"), contexts.join(over, "ah", "left_anti")
    small = small.withColumn("bucket", F.pmod(F.xxhash64("ah"), F.lit(buckets)))
    flags = small.groupBy("bucket").applyInArrow(_sorted_bucket, flagged)
    if large is not None:
        hashed = large.mapInArrow(_window_hashes, "ah bigint, eh bigint, d int, h1 bigint, h2 bigint")
        many = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h1", "h2")
        flags = flags.union(hashed.join(many, ["h1", "h2"]).select("ah", "eh", "d", "d"))

    begin = F.col("at") - F.col("lo")
    whole = runs.join(extents.filter("n > 1").select("ah", "eh"), ["ah", "eh"]).select(
        "id", "th", begin.alias("b"), (F.col("at") - F.col("hi") + WINDOW).alias("e")
    )
    single = asked.filter("n = 1").join(flags, ["ah", "eh"]).select(
        "id", "th", (F.col("at") - F.col("to_d")).alias("b"), (F.col("at") - F.col("from_d") + WINDOW).alias("e")
    )
    spans = whole.union(single).groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(
        F.collect_list(F.struct("b", "e")).alias("spans")
    )
    given = docs.join(spans, same, "left").select("id", "th", "rest", "text", "spans")
    cut = given.mapInArrow(
        _cut, with_fields(given.select("id", "th", "rest"), "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    )
    return cut.select(
        F.col("id").alias(key), F.col("th").alias("text_hash"), "n_bytes", "n_removed", "n_spans", "kept",
        *[F.col(f"rest.{c}").alias(c) for c in keep],
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, unnest(range(0, length(h) // 2 - 199)) AS p, h FROM d WHERE length(h) >= 400
), g AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS w FROM s
), r AS (
  SELECT doc_id, p FROM g WHERE w IN (SELECT w FROM g GROUP BY w HAVING count(*) > 1)
), runs AS (
  SELECT doc_id, min(p) AS b, max(p) + 200 AS e FROM (
    SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
      SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM r)
  ) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, b, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS g FROM runs
), heads AS (
  SELECT q.doc_id, string_agg(substr(h, 2 * g + 1, 2 * (b - g)), '' ORDER BY b) AS head FROM gaps q JOIN d USING (doc_id) GROUP BY 1
), sums AS (
  SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS tail FROM runs GROUP BY 1
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN heads USING (doc_id)
"""


@query(OP5_SQL)
def op5_suffix_dedup(spark, folder):
    cut = cut_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
