"""A Merkle manifest of a table, and octopus multiproofs of its rows.

Rows are leaves: hashes of named fields. Per group (a language) leaves stand in the order of their key, and every
``ARITY`` consecutive nodes (the last run may have fewer, even one) become their hash, until one is left: the subroot.
Subroots, in the order of their groups, become the root in the same way; they are the leaves of the tree ``TOP``.
All hashes are SHA-256 in lowercase hex, and a node hashes the hex texts of its children, concatenated.

Places come from a range-partitioned order (``places.placed``), so neither a large group nor a repeated key gathers in one
task. Levels are built from blocks of ``ARITY**LEVELS`` consecutive nodes, ``LEVELS`` levels a round.

A proof of a leaf has one step per level, from its own tree to the root: the siblings before and after the node in its
run. Proofs are made by leaf partitions, blocks of so many leaves: each one works out the least set of
nodes that its leaves cannot derive (the octopus), all of which are fetched by one join; it then derives the nodes that its leaves
share, once, and writes each leaf's proof from them. ``folded`` recomputes a root from a leaf and its proof by built-in functions.

Defined cases: a null field is ``-``, so it differs from an empty one; null keys and groups come first; equal keys stand in the
order of their leaves, and wholly equal rows are leaves of their own. A lone leaf is its group's subroot, a lone group's subroot the root;
their proofs have no steps. An empty table has no root and no proofs. Texts are hashed whole, whatever their length. Columns other
than the named fields are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .catalog import query, stored, table
from .places import placed

ARITY = 8
LEVELS = 3  # levels built in one round; a leaf partition has ARITY**LEVELS leaves
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of upper levels, fetched by many leaf partitions each, are broadcast as far as all of them are so few.
BROADCAST_ROWS = 50_000
PROOF = "array<struct<before:string,after:string>>"
NODES = "tree bigint, level int, idx bigint, n bigint, hash string"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, concatenated."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the given rows with (tree, idx, n); ``nodes``: all levels above them, and all of TOP."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame  # tree, subroot
    groups: int
    root: str | None
    levels: int

    @property
    def block(self) -> Column:
        """The leaf partition of a row of ``leaves``, within its tree."""
        return F.floor(F.col("idx") / ARITY**self.levels).alias("block")


def _hash(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _raise_blocks(levels: int):
    def of_block(block: pa.Table) -> pa.Table:
        """The next levels above one block of a tree's level."""
        tree, level, n = (block.column(c)[0].as_py() for c in ("tree", "level", "n"))
        idx = block.column("idx").to_numpy()
        hashes = block.column("hash").take(pa.array(np.argsort(idx))).to_pylist()
        first, out = int(idx.min()), []
        for _ in range(levels):
            if n == 1:
                break
            hashes = [_hash(hashes[i : i + ARITY]) for i in range(0, len(hashes), ARITY)]
            first, level, n = first // ARITY, level + 1, -(-n // ARITY)
            out += [(tree, level, first + i, n, h) for i, h in enumerate(hashes)]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*out, strict=True) if out else [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["tree", "level", "idx", "n", "hash"])

    return of_block


def _raised(level: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """Tables of the nodes above ``level``, whose trees have at most ``largest`` nodes."""
    out, at, block = [], 0, ARITY**levels
    while largest > 1:
        level = level.filter((F.col("level") == at) & (F.col("n") > 1))
        level = stored(level.groupBy("tree", F.floor(F.col("idx") / block)).applyInArrow(_raise_blocks(levels), NODES))
        out.append(level)
        at, largest = at + levels, -(-largest // block)
    return out


def manifest(rows: DataFrame, group: str, key: str, hash: str = "leaf", levels: int = LEVELS) -> Manifest:
    """The manifest of ``rows``, which have a group, a key and a leaf (and may have more columns)."""
    leaves = stored(placed(rows, group, [key, hash]))
    spark = rows.sparkSession
    size = leaves.agg(F.max("n"), F.max("tree")).first()
    if size[0] is None:
        none = spark.createDataFrame([], NODES)
        return Manifest(leaves, none, none.selectExpr("tree", "hash AS subroot"), 0, None, levels)
    largest, groups = size[0], size[1] + 1
    ground = leaves.select("tree", F.lit(0).alias("level"), "idx", "n", F.col(hash).alias("hash"))
    above = _raised(ground, largest, levels)
    tops = [f.filter("n = 1") for f in [ground, *above]]
    trees = tops[0]
    for f in tops[1:]:
        trees = trees.union(f)
    trees = stored(trees.select("tree", F.col("hash").alias("subroot")))
    ground = trees.select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"),
                          F.lit(groups).cast("bigint").alias("n"), F.col("subroot").alias("hash"))
    upper = _raised(ground, groups, levels)
    nodes = ground
    for f in [*upper, *above]:
        nodes = nodes.union(f)
    root = (upper[-1] if upper else ground).filter("n = 1").first()["hash"]
    return Manifest(leaves, nodes, trees, groups, root, levels)


def _climb(known: np.ndarray, size: int):
    """(level, known nodes, all nodes of their runs) at each level from which nodes are hashed."""
    level = 0
    while size > 1:
        parents = np.unique(known // ARITY)
        runs = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        yield level, known, runs[runs < size]
        known, size, level = parents, -(-size // ARITY), level + 1


def _ways(tree: int, idx: np.ndarray, n: int, groups: int):
    """The two trees that a partition of leaves climbs."""
    return (tree, np.unique(idx), n), (TOP, np.array([tree], np.int64), groups)


def _missing(groups: int):
    """The least set of nodes that a partition of leaves has to be given."""

    def of_partition(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        idx = part.column("idx").to_numpy()
        out = [(of, level, int(i))
               for of, known, size in _ways(key[0].as_py(), idx, part.column("n")[0].as_py(), groups)
               for level, known, runs in _climb(known, size) for i in np.setdiff1d(runs, known)]
        names = ["tree", "block", "of", "level", "idx"]
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        types = (pa.int64(), pa.int32(), pa.int64())
        own = [pa.array([k.as_py()] * len(out), pa.int64()) for k in key]
        return pa.table([*own, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return of_partition


def _expanded(groups: int, names: list[str], hash: str):
    """Each leaf's proof, from the leaves of a partition and the nodes it was given."""

    def of_partition(key: tuple[pa.Scalar, ...], part: pa.Table, given: pa.Table) -> pa.Table:
        rows = part.num_rows
        befores: list[list[str]] = [[] for _ in range(rows)]
        afters: list[list[str]] = [[] for _ in range(rows)]
        if rows == 0:
            return pa.table([*(part.column(c) for c in names), pa.array([], _PROOF_ARROW)], names=[*names, "proof"])
        nodes = {(t, v, i): h for t, v, i, h in zip(*(given.column(c).to_pylist() for c in ("of", "level", "idx", "hash")), strict=True)}
        idx, hashes = part.column("idx").to_numpy(), part.column(hash).to_pylist()
        at, carried = idx.tolist(), dict(zip(idx.tolist(), hashes, strict=True))
        for of, known, size in _ways(key[0].as_py(), idx, part.column("n")[0].as_py(), groups):
            if of == TOP:  # all leaves of the partition have arrived at their subroot
                at, carried = [key[0].as_py()] * rows, {key[0].as_py(): carried[0]}
            for level, own, runs in _climb(known, size):
                one = [carried[i] if i in carried else nodes[of, level, i] for i in runs.tolist()]
                above, sides = {}, {}
                starts = np.flatnonzero(runs % ARITY == 0).tolist()
                for begin, end in zip(starts, [*starts[1:], len(one)], strict=True):
                    run, first = one[begin:end], int(runs[begin])
                    above[first // ARITY] = _hash(run)
                    for k in range(len(run)):
                        if first + k in carried:
                            sides[first + k] = "".join(run[:k]), "".join(run[k + 1 :])
                for r, i in enumerate(at):
                    before, after = sides[i]
                    befores[r].append(before)
                    afters[r].append(after)
                at, carried = [i // ARITY for i in at], above
        steps = np.concatenate([[0], np.cumsum([len(b) for b in befores])]).astype(np.int32)
        flat = [pa.array([s for row in side for s in row], pa.string()) for side in (befores, afters)]
        proof = pa.ListArray.from_arrays(pa.array(steps), pa.StructArray.from_arrays(flat, names=["before", "after"]))
        return pa.table([*(part.column(c) for c in names), proof], names=[*names, "proof"])

    return of_partition


_PROOF_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _fetched(missing: DataFrame, held: Manifest, hash: str) -> DataFrame:
    """``missing`` with the hashes of its nodes, by one look-up of each."""
    key = ["of", "level", "idx"]
    nodes = held.nodes.select(F.col("tree").alias("of"), "level", "idx", "hash")
    # an upper node is asked for by as many partitions as stand below it
    counts = {r["level"]: r["n"] for r in held.nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}
    few = min((v for v in counts if sum(n for k, n in counts.items() if k >= v) <= BROADCAST_ROWS), default=max(counts, default=0) + 1)
    found = missing.join(F.broadcast(nodes.filter(F.col("level") >= few)), key)
    if few > 0:
        found = found.unionByName(missing.filter(F.col("level") < few).join(nodes.filter(F.col("level") < few), key))
    beside = missing.filter((F.col("level") == 0) & (F.col("of") != TOP))
    if beside.isEmpty():  # where whole blocks are proved, no leaf has to be fetched
        return found
    ground = held.leaves.select(F.col("tree").alias("of"), F.lit(0).alias("level"), "idx", F.col(hash).alias("hash"))
    return found.unionByName(beside.join(ground, key))


def multiproofs(held: Manifest, queried: DataFrame | None = None, hash: str = "leaf") -> DataFrame:
    """``queried`` (rows of ``held.leaves``; all, where none are given) with their proofs."""
    queried = held.leaves if queried is None else queried
    wanted = queried.select("tree", "idx", "n").groupBy("tree", held.block)
    missing = stored(wanted.applyInArrow(_missing(held.groups), "tree bigint, block bigint, of bigint, level int, idx bigint"))
    given = _fetched(missing, held, hash)
    shape = StructType([*queried.schema.fields, *StructType.fromDDL(f"proof {PROOF}").fields])
    parts = queried.groupBy("tree", held.block).cogroup(given.groupBy("tree", "block"))
    return parts.applyInArrow(_expanded(held.groups, queried.columns, hash), shape)


def crc(doc_id: Column) -> Column:
    """crc32 of the decimal id; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


# --- crc32 of an id in SQL: the fixed reversed polynomial, a bit at a time ---
SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [1000 + ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 1000 THEN xor(c, x - 1000) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT)"""


def _sql_field(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if f == "text" else f) for f in FIELDS) + ")"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, lang, {_sql_leaf("text")} AS leaf,
    CASE WHEN {SQL_CRC} % 3 = 0 THEN {_sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed
  FROM documents),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM rows_),
nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS hash FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(hash, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // {ARITY}, n),
trees AS (SELECT tree, hash AS subroot, count(*) OVER () AS groups FROM nodes WHERE n = 1),
uppers AS (
  SELECT 0 AS level, tree AS idx, groups AS n, subroot AS hash FROM trees
  UNION ALL
  SELECT level + 1, idx // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(hash, '' ORDER BY idx))
  FROM uppers WHERE n > 1 GROUP BY level, idx // {ARITY}, n),
every AS (SELECT tree, level, idx, n, hash FROM nodes UNION ALL SELECT {TOP}, level, idx, n, hash FROM uppers),
climb AS (
  SELECT tree AS own, idx AS row_, tree, 0 AS level, idx, n, 0 AS step, coalesce(changed, leaf) AS hash, '' AS proof FROM leaves
  UNION ALL
  SELECT * FROM (
    SELECT c.own, c.row_, c.tree, c.level + 1, c.idx // {ARITY}, (c.n + {ARITY - 1}) // {ARITY}, c.step + 1,
      sha256(string_agg(CASE WHEN e.idx = c.idx THEN c.hash ELSE e.hash END, '' ORDER BY e.idx)),
      any_value(c.proof) || coalesce(string_agg(e.hash, '' ORDER BY e.idx) FILTER (WHERE e.idx <> c.idx), '')
    FROM climb c JOIN every e ON e.tree = c.tree AND e.level = c.level AND e.idx // {ARITY} = c.idx // {ARITY}
    WHERE c.n > 1 GROUP BY c.own, c.row_, c.tree, c.level, c.idx, c.n, c.step
    UNION ALL
    SELECT c.own, c.row_, {TOP}, 0, c.own, t.groups, c.step, c.hash, c.proof
    FROM climb c JOIN trees t ON t.tree = c.own WHERE c.n = 1 AND c.tree <> {TOP}))
SELECT l.doc_id, l.leaf, t.subroot, r.hash AS root, sha256(c.proof) AS proof_sha256, c.hash AS folded_root, c.hash = r.hash AS verified
FROM leaves l JOIN trees t USING (tree) JOIN climb c ON c.own = l.tree AND c.row_ = l.idx AND c.tree = {TOP} AND c.n = 1
CROSS JOIN (SELECT hash FROM uppers WHERE n = 1) r
"""


@query(OP11_SQL)
def op11_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    values = {f: F.col(f) for f in FIELDS}
    lowered = values | {"text": F.translate("text", _UPPER, _LOWER)}
    rows = stored(docs.select(
        "doc_id", "lang", leaf(list(values.values())).alias("leaf"),
        F.when(crc(F.col("doc_id")) % 3 == 0, leaf(list(lowered.values()))).alias("changed"),
    ))
    held = manifest(rows, "lang", "doc_id")
    proved = multiproofs(held).join(held.trees, "tree")
    out = proved.select(
        "doc_id", "leaf", "subroot", F.lit(held.root).alias("root"), F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
