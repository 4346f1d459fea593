"""Merkle manifest, shards and periodic runs, against plain Python."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from changewatch.llm import merkle, periodic, registered, shuffle
from changewatch.llm.catalog import stored
from changewatch.llm.places import placed

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 7001}" for i in range(30_000))
# ids null or repeated, equal rows, empty, blank and long texts, and columns of names that the operators use themselves
CLASHING = "tree bigint, idx bigint, n bigint, leaf string, level int, hash string, proof string, shard int, slot bigint, size bigint, row string, bucket int, copy int, runs string, words string, place int"
FILLER = (1, 1, 1, "l", 1, "h", "p", 1, 1, 1, "r", 1, 1, "u", "w", 1)
EDGES = [
    (None, "de", "no id"), (None, "de", "no id"), (None, None, None), (2, None, None), (3, "en", ""), (3, "en", ""), (3, "en", ""), (3, "en", "Other"),
    (4, "en", " \n\t "), (5, "", "one"), (6, "fr", "é ü 漢 \U0001f600"), (7, "en", LONG), (-8, "en", "NEGATIVE id"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *FILLER) for r in rows], f"doc_id bigint, lang string, text string, {CLASHING}")


# --- places ------------------------------------------------------------------------------


def test_places_are_gapless_and_ordered(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, "a", "b", "é", ""]) if i % 3 else "hot", rnd.randrange(40) if i % 5 else 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(7)
    got = [tuple(r) for r in placed(df, "g", ["k"]).select("g", "k", "tree", "idx", "n").collect()]
    groups = sorted({g for g, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    for at, g in enumerate(groups):
        own = sorted((r[3], r[1], r[2], r[4]) for r in got if r[0] == g)
        keys = sorted(k for h, k in rows if h == g)
        assert own == [(i, k, at, len(keys)) for i, k in enumerate(keys)]


# --- op11 --------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(leaves):
    """leaves: (lang, doc_id, leaf) -> (root, {lang: subroot}, [(lang, doc_id, leaf, proof)])."""
    def climb(level, at):
        proof = []
        while len(level) > 1:
            run = [k for k in range(len(level)) if k // 8 == at // 8]
            proof += [level[k] for k in run if k != at]
            level, at = [sha(*level[k : k + 8]) for k in range(0, len(level), 8)], at // 8
        return level[0], proof

    langs = sorted({g for g, _, _ in leaves}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted((k for k in leaves if k[0] == g), key=lambda k: (k[1] is not None, k[1] or 0, k[2])) for g in langs}
    subroots = [climb([x[2] for x in trees[g]], 0)[0] for g in langs]
    out = []
    for t, g in enumerate(langs):
        for i, (_, doc, leaf) in enumerate(trees[g]):
            own = climb([x[2] for x in trees[g]], i)[1]
            root, upper = climb(subroots, t)
            out.append((g, doc, leaf, "".join(own + upper)))
    return root if leaves else None, dict(zip(langs, subroots)), out


@pytest.mark.parametrize("levels,rare", [(3, 50_000), (1, 0)])
@pytest.mark.parametrize("langs", [1, 70])
def test_manifest_and_proofs(spark, monkeypatch, levels, rare, langs):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", rare)
    rows = [(d, g, sha(str(d), str(g), t or "")) for d, g, t in EDGES]
    rows += [(i, "hot" if i % 3 else f"g{i % langs}", sha(str(i))) for i in range(600)]
    held = merkle.manifest(spark.createDataFrame(rows, "doc_id bigint, lang string, leaf string"), "lang", "doc_id", levels=levels)
    root, subroots, want = brute_manifest([(g, d, h) for d, g, h in rows])
    assert held.root == root and held.groups == len(subroots)
    assert sorted(r.subroot for r in held.trees.collect()) == sorted(subroots.values())
    proved = merkle.multiproofs(held)
    got = proved.select("lang", "doc_id", "leaf", merkle.siblings(F.col("proof"))).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert proved.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.lit(root)).count() == 0
    assert proved.filter(merkle.folded(F.lit(sha("x")), F.col("proof")) == F.lit(root)).count() == 0
    # some rows only: nodes beside them have to be fetched, leaves too
    some = merkle.multiproofs(held, held.leaves.filter("idx % 11 = 3"))
    assert some.count() == held.leaves.filter("idx % 11 = 3").count() > 0
    assert some.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.lit(root)).count() == 0


def test_missing_nodes_are_the_least(spark):
    import pyarrow as pa

    part = pa.table({"tree": [0] * 9, "idx": [*range(8), 9], "n": [70] * 9})
    found = merkle._missing(3)((pa.scalar(0), pa.scalar(0)), part).to_pydict()
    # the run of 9 but for 9; of the nine nodes above it those of the first run but 0 and 1, and the second run; two subroots
    want = [(0, 0, i) for i in (8, *range(10, 16))] + [(0, 1, i) for i in range(2, 8)] + [(0, 2, 1)] + [(-1, 0, 1), (-1, 0, 2)]
    assert list(zip(found["of"], found["level"], found["idx"])) == want


def test_manifest_of_few_rows(spark):
    shape = "doc_id bigint, lang string, leaf string"
    empty = merkle.manifest(spark.createDataFrame([], shape), "lang", "doc_id")
    assert empty.root is None and merkle.multiproofs(empty).count() == 0
    lone = merkle.manifest(spark.createDataFrame([(1, "x", "ab")], shape), "lang", "doc_id")
    assert lone.root == "ab" and merkle.multiproofs(lone).first()["proof"] == []


def test_leaf_fields(spark):
    row = spark.createDataFrame([(1, None, "é", "")], "a int, b string, c string, d string").select(
        merkle.leaf([F.col(c) for c in "abcd"]).alias("h")).first()
    assert row.h == sha("1:1-2:é0:")


def read_docs(path):
    import pyarrow.parquet as pq

    return pq.read_table(path).to_pylist()


def with_table(spark, tmp_path, rows):
    """A folder whose documents are these rows of (doc_id, lang, text), with columns of clashing names."""
    df = frame(spark, rows).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("bigint"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_manifest_query_of_edge_rows(spark, tmp_path):
    folder = with_table(spark, tmp_path, EDGES)
    got = registered.QUERIES["op11_merkle_manifest"](spark, folder).collect()
    assert len(got) == len(EDGES)
    for r in got:
        text = [t for d, _, t in EDGES if d == r.doc_id]
        altered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        changes = {altered and t is not None and re.search("[A-Z]", t) is not None for t in text}
        assert (not r.verified) in changes and r.verified == (r.folded_root == r.root)


# --- op12 --------------------------------------------------------------------------------


def test_fisher_yates_is_a_keyed_permutation():
    one, other = shuffle.fisher_yates(500, 1, 0), shuffle.fisher_yates(500, 1, 1)
    assert sorted(one) == sorted(other) == list(range(500)) and list(one) != list(other)
    assert shuffle.fisher_yates(0, 1, 0).tolist() == [] and shuffle.fisher_yates(1, 1, 0).tolist() == [0]
    # every place is about equally likely for the first record
    places = collections.Counter(int(np.flatnonzero(shuffle.fisher_yates(5, 1, b) == 0)[0]) for b in range(5000))
    assert all(850 < places[p] < 1150 for p in range(5))


def check_shards(rows, shards):
    counts = collections.Counter(s for s, _ in rows)
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1 and set(counts) <= set(range(shards))
    for s in counts:
        assert sorted(slot for x, slot in rows if x == s) == list(range(counts[s]))


@pytest.mark.parametrize("bucket_bytes", [1, 300, 1 << 30])
def test_shuffled(spark, bucket_bytes):
    rows = EDGES[:-2] + [(i, "en", f"text {i}") for i in range(300)] + [(9999, "en", "copy")] * 200
    results = []
    for parts in (1, 6):
        out = shuffle.shuffled(frame(spark, rows).repartition(parts), shards=7, bucket_bytes=bucket_bytes).collect()
        assert collections.Counter((r.row.doc_id, r.row.lang, r.row.text) for r in out) == collections.Counter(rows)
        assert all(r.size == len((r.row.text or "").encode()) + 1 and r.row.slot == 1 and r.row.bucket == 1 for r in out)
        check_shards([(r.shard, r.slot) for r in out], 7)
        results.append(sorted((r.shard, r.slot, str(r.row.doc_id), r.row.text or "") for r in out))
    assert results[0] == results[1]
    # copies are spread over all shards
    held = collections.Counter(s for s, _, d, _ in results[0] if d == "9999")
    assert all(8 <= held[s] <= 60 for s in range(7))
    assert [r[2] for r in results[0]] != [r[2] for r in sorted(results[0], key=lambda r: (len(r[2]), r[2]))]


def test_shards_depend_on_the_seed_and_files_are_in_order(spark, tmp_path):
    docs = frame(spark, [(i, "en", f"text {i}") for i in range(200)])
    one = shuffle.write_shards(docs, f"{tmp_path}/one", seed=1, bucket_bytes=400)
    other = shuffle.write_shards(docs, f"{tmp_path}/other", seed=2, bucket_bytes=400)
    order = lambda df: [r.doc_id for r in df.orderBy("shard", "slot").select("row.doc_id").collect()]
    assert sorted(order(one)) == sorted(order(other)) and order(one) != order(other)
    for folder, _, names in os.walk(f"{tmp_path}/one"):
        for name in names:
            if name.endswith(".parquet"):
                slots = [r["slot"] for r in read_docs(os.path.join(folder, name))]
                assert slots == sorted(slots)


def test_shards_of_few_rows(spark, tmp_path):
    assert shuffle.write_shards(frame(spark, []), f"{tmp_path}/none").collect() == []
    few = shuffle.write_shards(frame(spark, EDGES[:3]), f"{tmp_path}/few").collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (5, 0), (10, 0)]


def test_shards_query_of_edge_rows(spark, tmp_path):
    got = registered.QUERIES["op12_shards"](spark, with_table(spark, tmp_path, EDGES)).collect()
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, _, t in EDGES)
    check_shards([(r.shard, r.slot) for r in got], 16)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


# --- op13 --------------------------------------------------------------------------------


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(all(w[i + k] == w[i + k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2]), default=(None,) * 3)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def repetitive(rnd, n, k):
    w = [rnd.randrange(k) for _ in range(n)]
    for _ in range(rnd.randrange(4)):
        if n > 8:
            a, p = rnd.randrange(n - 5), rnd.randrange(1, 9)
            for i in range(a, min(n, a + rnd.randrange(4, 70))):
                w[i] = w[a + (i - a) % p]
    return w


def test_runs_equal_brute_force():
    rnd = random.Random(8)
    for _ in range(1500):
        w = repetitive(rnd, rnd.randrange(90), rnd.choice([1, 2, 3, 6]))
        words = [b"%d" % x for x in w]
        assert periodic.document_runs(words) == brute_runs(w)
        assert sorted(periodic.runs_of(w), key=lambda r: (r[0], r[2])) == brute_runs(w)


def test_stretches_leave_no_run_out():
    rnd = random.Random(9)
    for _ in range(300):
        w = [rnd.randrange(50) for _ in range(400)]
        for _ in range(3):
            a, p = rnd.randrange(380), rnd.randrange(1, 12)
            for i in range(a, min(400, a + rnd.randrange(20, 120))):
                w[i] = w[a + (i - a) % p]
        kept = periodic.stretches(np.array([hash(b"%d" % x) for x in w], np.int64))
        for s, length, _ in brute_runs(w):
            assert any(b <= s and s + length <= e for b, e in kept)
    plain = np.array([hash(b"%d" % rnd.randrange(300)) for _ in range(5000)], np.int64)
    assert periodic.stretches(plain) == []


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(10)
    docs = EDGES[:-2] + [(i, "en", " \n".join(f"w{x}" for x in repetitive(rnd, rnd.randrange(120), 3))) for i in range(100, 400)]
    docs += [(400, "en", "la " * 500), (401, "en", "           ")]
    got = registered.QUERIES["op13_periodic_runs"](spark, with_table(spark, tmp_path, docs)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((brute_row(d, t) for d, _, t in docs), key=str)
    assert sum(r.n_runs > 1 for r in got) > 20


def test_periodic_runs_of_long_and_empty_inputs(spark):
    long = " ".join([*(f"a{i}" for i in range(20_000)), *(f"b{i % 3001}" for i in range(14_000))])
    row = periodic.periodic_runs(frame(spark, [(1, "en", long), (2, "en", LONG)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in row[0].runs] == [(20_000, 14_000, 3001)]
    assert len(row[0].collapsed.split()) == 23_001 and [tuple(r) for r in row[1].runs] == [(0, 30_000, 7001)]
    assert periodic.periodic_runs(frame(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_periodic_query_of_the_tables(spark):
    got = {r.doc_id: tuple(r) for r in registered.QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    docs = [d for d in read_docs(f"{FOLDER}/documents.parquet") if len((d["text"] or "").split()) < 1500]
    assert len(docs) > 150 and all(got[d["doc_id"]] == brute_row(d["doc_id"], d["text"]) for d in docs)
