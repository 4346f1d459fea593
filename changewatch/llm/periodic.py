"""Periodic run detection: where a document says the same words over and over.

A run is a stretch of words with a smallest period q (words q apart are identical), of at least ``max(LEAST, TIMES * q)`` words,
that cannot be extended. All of them are found by a suffix automaton over words with link-cut access:

* the automaton's suffix links form a tree; every node stands for word sequences that end at the same places, ``length`` words at most;
* words are appended one by one, and each one accesses its node: the path from there to the root becomes one preferred path, of one
  colour, the place of that word. Before that, the path consists of segments (preferred paths, held as splay trees), each with the place
  where its sequences ended last;
* where a segment's last place is d words back and the segment is at least d long, the words that end here repeat with period d: a
  square. d is its smallest period, as a smaller one would have coloured the segment later. A run's squares are seen at each
  of its words from 2q on, so its first square, extended to both sides, gives the run.

An access meets O(log n) segments on average, so a stretch of n words takes O(n log n) steps.

Words are looked at in stretches that can hold a run. Each three consecutive words of a run occur at least three times in it, and next to
themselves at no more than its period, a quarter of its words. Places where that cannot be so split a text, until all
left may be part of a run (``stretches``). This drops no run and is computed with numpy for all words of a document at once; it
compares hashes of words, and the automaton the words themselves.

Defined cases: a null text has no words, and an empty or blank one neither: no runs, and the collapsed text is empty. Rows are judged one by one, so
ids that are null or repeat do no harm. A text of any length is taken whole; it takes about 400 bytes a word in the task that reads it,
and only in stretches that may hold runs. Runs of equal exponent: the one that starts first, then that of the smaller
period, counts as the greatest. Columns other than key and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import query, table, with_fields

LEAST = 6
TIMES = 4
_GRAM = 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SPACE = r"[\x20\x09-\x0D]+"


class Automaton:
    """Suffix links and lengths of the automaton of a sequence; state 0 is the empty sequence."""

    def __init__(self, words: list[int]):
        self.length, self.link, self.ends = [0], [-1], []
        following: list[dict[int, int]] = [{}]
        last = 0
        for word in words:
            state = self._add(following, self.length[last] + 1, {})
            at = last
            while at >= 0 and word not in following[at]:
                following[at][word] = state
                at = self.link[at]
            if at < 0:
                self.link[state] = 0
            else:
                target = following[at][word]
                if self.length[target] == self.length[at] + 1:
                    self.link[state] = target
                else:
                    clone = self._add(following, self.length[at] + 1, dict(following[target]))
                    self.link[clone] = self.link[target]
                    self.link[target] = self.link[state] = clone
                    while at >= 0 and following[at].get(word) == target:
                        following[at][word] = clone
                        at = self.link[at]
            last = state
            self.ends.append(state)

    def _add(self, following: list[dict[int, int]], length: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(-1)
        following.append(step)
        return len(following) - 1


class Paths:
    """Link-cut access over the tree of suffix links: preferred paths as splay trees, each of one colour."""

    def __init__(self, automaton: Automaton):
        # node 0 stands for "none", so states are counted from 1
        self.length = [0, *automaton.length]
        self.parent = [0, *(link + 1 for link in automaton.link)]
        n = len(self.length)
        self.left, self.right, self.colour = [0] * n, [0] * n, [-1] * n

    def _splay(self, x: int) -> None:
        """Makes ``x`` the top of its splay tree; the colour stays with the top."""
        left, right, parent = self.left, self.right, self.parent
        top = x
        while True:
            p = parent[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = parent[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner:
                if (left[g] == p) == (left[p] == x):
                    self._rotate(p)
                else:
                    self._rotate(x)
                top = g
            else:
                top = p
            self._rotate(x)
        if top != x:
            self.colour[x] = self.colour[top]

    def _rotate(self, x: int) -> None:
        left, right, parent = self.left, self.right, self.parent
        p = parent[x]
        g = parent[p]
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child:
            parent[child] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        parent[p], parent[x] = x, g

    def access(self, state: int, place: int) -> list[tuple[int, int]]:
        """(last place, greatest length) of each segment from ``state`` to the root; then all of it has the colour ``place``."""
        segments, below, x = [], 0, state + 1
        while x:
            self._splay(x)
            deeper = self.right[x]
            if deeper:  # cut off: it keeps its colour
                self.colour[deeper] = self.colour[x]
            segments.append((self.colour[x], self.length[x]))
            self.right[x] = below
            below, x = x, self.parent[x]
        self.colour[below] = place
        return segments


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, in no order."""
    automaton, n = Automaton(words), len(words)
    paths, until, out = Paths(automaton), {}, []
    for i, state in enumerate(automaton.ends):
        for last, length in paths.access(state, i):
            period = i - last
            if last < 0 or period > length or until.get(period, -1) >= i:
                continue
            start, end = i - length - period + 1, i + 1
            while end < n and words[end] == words[end - period]:
                end += 1
            until[period] = end - 1
            if end - start >= max(LEAST, TIMES * period):
                out.append((start, end - start, period))
    return out


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of words that may hold runs, by hashes of the words."""
    n = len(hashes) - _GRAM + 1
    if len(hashes) < LEAST:
        return []
    with np.errstate(over="ignore"):
        grams = hashes[:n] * np.int64(0x9E3779B97F4A7C1 | 1) + hashes[1 : n + 1] * np.int64(0x5851F42D4C957F2D)
        grams = (grams ^ (grams >> np.int64(29))) * np.int64(0x2545F4914F6CDD1D) + hashes[2 : n + 2]
    places = np.arange(n)
    while True:
        # stretches are maximal sequences of consecutive places
        stretch = np.cumsum(np.concatenate([[0], np.diff(places) != 1])) if len(places) else places
        sizes = np.bincount(stretch)[stretch] if len(places) else places
        value = grams[places]
        order = np.lexsort((places, value, stretch))
        at, of, gram = places[order], stretch[order], value[order]
        same = (of[1:] == of[:-1]) & (gram[1:] == gram[:-1])
        near = same & (at[1:] - at[:-1] <= (sizes[order][1:] + _GRAM - 1) // TIMES)
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(at) else np.zeros(0, np.int64)
        counts = np.repeat(np.diff(np.append(first, len(at))), np.diff(np.append(first, len(at))))
        fits = np.zeros(len(at), bool)
        if len(at):
            fits[1:] |= near
            fits[:-1] |= near
            fits &= (counts >= TIMES - 1) & (sizes[order] >= LEAST - _GRAM + 1)
        kept = np.sort(at[fits])
        if len(kept) == len(places):
            break
        places = kept
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) != 1)
    begins, ends = places[np.append(0, cuts + 1)], places[np.append(cuts, len(places) - 1)]
    return [(int(b), int(e) + _GRAM) for b, e in zip(begins, ends, strict=True)]


def document_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs of a document, by start and period."""
    if len(words) < LEAST:
        return []
    out = []
    for begin, end in stretches(np.fromiter(map(hash, words), np.int64, len(words))):
        ids: dict[bytes, int] = {}
        own = [ids.setdefault(w, len(ids)) for w in words[begin:end]]
        out += [(begin + start, length, period) for start, length, period in runs_of(own)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run contains after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(dropped).tolist()) if not d]


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed): all runs by start and period, and the text without repeated periods."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, flat, ends, kept = [], [], [0], []
            for value in batch.column(1).cast(pa.large_binary()):
                words = (value.as_py() or b"").split()  # bytes: at [\x20\x09-\x0D] only
                runs = document_runs(words)
                counts.append(len(words))
                flat += runs
                ends.append(len(flat))
                kept.append(b" ".join(collapse(words, runs)))
            parts = [pa.array(c, pa.int64()) for c in (zip(*flat, strict=True) if flat else [()] * 3)]
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), runs, texts], names)

    names = [key, "n_words", "runs", "collapsed"]
    given = df.select(key, F.col(text).cast("string").alias("_text"))
    return given.mapInArrow(found, with_fields(df.select(key), f"n_words bigint, runs {RUNS}, collapsed string"))


def greatest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; null if there is none."""
    def better(one: Column, other: Column) -> Column:
        mine, its = other["length"] * one["period"], one["length"] * other["period"]
        before = (other["start"] < one["start"]) | ((other["start"] == one["start"]) & (other["period"] < one["period"]))
        return one.isNull() | (mine > its) | ((mine == its) & before)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda one, other: F.when(better(one, other), other).otherwise(one))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of ids whose crc32 is divisible by ten, the text goes on with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    cut = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).select(
        "*", F.size("words").cast("bigint").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int")))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark, folder):
    found = periodic_runs(with_periods(table(spark, folder, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", greatest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
