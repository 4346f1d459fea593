"""Token counts with offset-mapped attribution to fields and sections.

A document is encoded once, as a whole: its fields in order, each after the first preceded by
``SEPARATOR``. Tokens of the byte-level vocabulary concatenate to the text, so their byte lengths
give each token's span, and spans in characters follow from the bytes that start one. Sections
(fields, and within them lines or stretches of a fixed number of characters) are spans of the same text, so each token meets the sections it
overlaps by an interval join in sorted order (binary search). A token within one section counts
there. A token that crosses a boundary is allocated by ``rule``:

* ``first`` - to the section of its first byte;
* ``last`` - to the section of its last byte;
* ``largest`` - to the section that has most of its bytes, the earliest of equal ones.

So the counts of the sections add up to the count of the whole document under every rule, which
sums of separately encoded sections do not. A line includes its line feed; the separator belongs to
the section before it.

Defined cases: a null field is empty; an empty field is a section of no tokens, as is the empty
text after a last line feed. Fields of equal names are told apart by position. Other columns are not
read, whatever their names. The vocabulary is a file of ranks, given by a path executors can read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query, table, with_fields

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# --- fixed value: how the vocabulary's texts are split before merging ---
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = "\n"
STRETCH = 1000
RULES = ("first", "last", "largest")


class Encoder:
    """The vocabulary and the byte length of each token."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte offsets): token i covers bytes offsets[i] to offsets[i + 1]."""
        ids = np.asarray(self.encoding.encode_ordinary(text), np.int64)
        return ids, np.concatenate([[0], np.cumsum(self.lengths[ids])])


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The vocabulary as loaded by this Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def allocate(offsets: np.ndarray, begins: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary).

    Sections tile the text: section s starts at byte begins[s] and ends where the next begins.
    """
    start, end = offsets[:-1], offsets[1:]
    first = np.searchsorted(begins, start, side="right") - 1
    last = np.searchsorted(begins, end - 1, side="right") - 1
    crossing = last > first
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    if rule != "largest":
        raise ValueError(f"rule must be one of {RULES}")
    chosen = first.copy()
    ends = np.append(begins[1:], offsets[-1])
    for i in np.flatnonzero(crossing):  # few: tokens over a boundary
        across = np.arange(first[i], last[i] + 1)
        shares = np.minimum(ends[across], end[i]) - np.maximum(begins[across], start[i])
        chosen[i] = across[int(shares.argmax())]
    return chosen, crossing


def sections_of(fields: list[str], by: str | int) -> tuple[str, np.ndarray, np.ndarray]:
    """(whole text, byte where each section begins, field of each section)."""
    begins, owner, at, pieces = [], [], 0, []
    for k, field in enumerate(fields):
        data = (field + (SEPARATOR if k < len(fields) - 1 else "")).encode("utf-8", "replace")
        cuts = [0]
        own = np.frombuffer(field.encode("utf-8", "replace"), np.uint8)
        if by == "lines":
            cuts += (np.flatnonzero(own == 10) + 1).tolist()
        elif by != "fields":
            cuts += np.flatnonzero((own & 0xC0) != 0x80)[by::by].tolist()
        begins += [at + c for c in cuts]
        owner += [k] * len(cuts)
        pieces.append(data)
        at += len(data)
    return b"".join(pieces).decode(), np.array(begins, np.int64), np.array(owner, np.int64)


def attributed(
    df: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = ("text",), by: str | int = "lines",
    rule: str = "largest", path: str = RANKS,
) -> DataFrame:
    """(key, n_tokens, n_sections, n_crossing, field_tokens, section_tokens) of each row.

    Sections are "fields", "lines" or stretches of ``by`` characters. ``field_tokens`` has a count per field; ``section_tokens`` (field, from, to, tokens) per section,
    with its span in characters of the whole text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names[1:-1]}
            spans: list[tuple[np.ndarray, ...]] = []
            for i in range(batch.num_rows):
                text, begins, owner = sections_of([batch.column(1 + k)[i].as_py() or "" for k in range(len(fields))], by)
                ids, offsets = enc.spans(text)
                at, crossing = allocate(offsets, begins, rule) if len(ids) else (np.zeros(0, np.int64),) * 2
                tokens = np.bincount(at, minlength=len(begins))
                out["n_tokens"].append(len(ids))
                out["n_sections"].append(len(begins))
                out["n_crossing"].append(int(crossing.sum()))
                out["field_tokens"].append(np.bincount(owner, tokens, minlength=len(fields)).astype(np.int64).tolist())
                data = np.frombuffer(text.encode(), np.uint8)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                begin, end = chars[begins], chars[np.append(begins[1:], len(data))]
                spans.append((owner, begin, end, tokens))
            columns = [pa.array(out[n], t) for n, t in zip(names[1:-1], types, strict=True)]
            ends = np.concatenate([[0], np.cumsum(out["n_sections"])]).astype(np.int32)
            parts = [pa.array(np.concatenate(x) if spans else [], f.type) for x, f in zip(zip(*spans) if spans else [()] * 4, span, strict=True)]
            sections = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(span)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, sections], names)

    span = pa.struct([("field", pa.int32()), ("from", pa.int64()), ("to", pa.int64()), ("tokens", pa.int64())])
    names = [key, "n_tokens", "n_sections", "n_crossing", "field_tokens", "section_tokens"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    given = df.select(key, *[F.col(f).cast("string").alias(f"_{k}") for k, f in enumerate(fields)])
    counts = "n_tokens bigint, n_sections bigint, n_crossing bigint, field_tokens array<bigint>"
    sections = "section_tokens array<struct<field:int,`from`:bigint,`to`:bigint,tokens:bigint>>"
    return given.mapInArrow(rows, with_fields(df.select(key), f"{counts}, {sections}"))


@query()
def op7_token_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    counted = attributed(docs, fields=("source", "text"), by=STRETCH)
    joined = F.array_join(F.transform("section_tokens", lambda s: F.concat_ws(":", s["field"], s["from"], s["to"], s["tokens"])), ",")
    return counted.select(
        "doc_id", "n_tokens", "n_sections", "n_crossing", F.element_at("field_tokens", 1).alias("source_tokens"),
        F.element_at("field_tokens", 2).alias("text_tokens"), "section_tokens", F.sha2(joined, 256).alias("sections_sha256"),
    )
