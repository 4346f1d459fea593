"""Operators with exact results, against brute force and SQL."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest

from changewatch.llm import decontaminate, fingerprint, jaccard, pieces, registered, revisits, suffix_dedup, token_counts
from changewatch.llm.components import components
from check import TABLES, cell

FOLDER = "/root/testdata/sf0.001"
#: Names that the operators use themselves.
CLASHING = "id bigint, sid bigint, th bigint, n bigint, words string, token string, bucket string, rest string, _id string, text_hash string, label string, spans string"


def documents(spark, rows, clashing=False):
    """(doc_id, text) rows, with further columns of awkward names."""
    if not clashing:
        return spark.createDataFrame(rows, "doc_id bigint, text string")
    filler = (7, 7, 7, 7, "w", "t", "b", "r", "i", "h", "l", "s")
    return spark.createDataFrame([(*r, *filler) for r in rows], f"doc_id bigint, text string, {CLASHING}")


def words(n, seed, vocabulary=400):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def edited(ws, k, seed):
    rnd, out = random.Random(seed), list(ws)
    for i in rnd.sample(range(len(out)), k):
        out[i] = f"x{rnd.randrange(10**6)}"
    return out


LONG = " ".join(words(30_000, 99, 30_000))
EDGES = [(None, "no id"), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, "one"), (6, "one"), (6, "two three"), (7, "é ü x ▁ 漢 \U0001f600"), (8, LONG)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = registered.QUERIES[name](spark, FOLDER)
    got = db.execute(registered.ORACLES[name])
    cols = sorted(c[0] for c in got.description)
    names = [c[0] for c in got.description]
    assert cols == sorted(df.columns)
    want = sorted(tuple(cell(dict(zip(names, r))[c]) for c in cols) for r in got.fetchall())
    assert sorted(tuple(cell(r[c]) for c in cols) for r in df.collect()) == want and want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 130)] + [(100, 101), (200, 200)]
    found = {r.u: r.v for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**{i: 0 for i in range(1, 31)}, **{k: 100 for k in range(101, 130)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# --- op1 ---------------------------------------------------------------------------------


def brute_contaminated(docs, items, width=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = []
    for item, text in items:
        w = cut(text)
        n = min(width, len(w))
        windows += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n and item is not None]
    out = []
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    item = words(20, 1)
    items = [(1, " ".join(item)), (2, "Short, item"), (10, "one"), (3, " ".join(item)), (4, ""), (5, None), (None, "two three"),
             (6, "a a a a a a a a a a a a a a a")]
    docs = EDGES[:-1] + [
        (20, " ".join(words(40, 2) + item[3:17] + words(5, 3))), (21, "say: SHORT item. short-item"), (22, "a " * 40),
        (23, " ".join(item[:12])), (24, " ".join(item[:13])), (25, " ".join(words(500, 4) + item)), (25, " ".join(words(500, 4) + item))]
    frame = documents(spark, docs, clashing=True)
    table = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id bigint, text string, window bigint, shingle string")
    got = decontaminate.contaminated(frame, table).drop("text_hash").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_contaminated(docs, items)


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.contaminated(documents(spark, []), items).count() == 0
    got = decontaminate.contaminated(documents(spark, [(1, "a b")]), items.filter("false")).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (2, 0, False)


# --- op5 ---------------------------------------------------------------------------------


def brute_cut(docs, n=200):
    data = [(t or "").encode() for _, t in docs]
    seen = {}
    for d, b in enumerate(data):
        for i in range(len(b) - n + 1):
            seen.setdefault(b[i : i + n], []).append((d, i))
    out = []
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + n] = b"\1" * n
    for (doc, _), b, g in zip(docs, data, gone):
        spans = len(re.findall(b"\1+", bytes(g)))
        out.append((doc, len(b), sum(g), spans, bytes(x for x, y in zip(b, g) if not y)))
    return sorted(out, key=str)


def repeats():
    base, other = " ".join(words(120, 5)), " ".join(words(120, 6))
    passage = " ".join(words(60, 7))
    docs = [(1, base), (2, base[:300] + other), (3, other[50:] + base[100:420]), (4, passage + " end four"), (5, "start five " + passage),
            (6, "é" * 400), (7, "ab" * 90), (8, "ab" * 101), (9, passage[:199]), (10, "q" + passage[:200] + "z"), (10, "q" + passage[:200] + "z"),
            (11, "\0" * 250), (12, " ".join(words(300, 8)))]
    docs += [(100 + k, " ".join(words(20, 1000 + k)) + " " + passage[k % 40 :][:260] + " " + " ".join(words(20, 2000 + k))) for k in range(60)]
    return docs + EDGES[:-1]


@pytest.mark.parametrize("group", [20_000, 3])
def test_suffix_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    docs = repeats()
    got = suffix_dedup.cut_repeats(documents(spark, docs, clashing=True)).collect()
    rows = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str)
    assert rows == brute_cut(docs)
    assert suffix_dedup.cut_repeats(documents(spark, [])).count() == 0


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    text = " ".join(words(1500, 11))
    docs = [(1, text), (2, "x" + text[900:4000] + "y"), (3, LONG[:9000])]
    got = suffix_dedup.cut_repeats(documents(spark, docs)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute_cut(docs)


def test_deep_shallow_order():
    rnd = np.random.default_rng(3)
    rows = rnd.integers(0, 2, (300, 200)).astype(np.uint8)
    rows[50:150, :120] = rows[0, :120]  # long common prefixes
    rows[200:220] = rows[10]
    order = suffix_dedup.deep_shallow_order(rows)
    strings = [r.tobytes() for r in rows]
    assert [strings[i] for i in order] == sorted(strings)
    lcp = suffix_dedup.neighbour_prefixes(rows, order)
    assert lcp[5] == len(os.path.commonprefix([strings[order[4]], strings[order[5]]]))


# --- op8 ---------------------------------------------------------------------------------


def brute_similar(docs):
    cut = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    sets = []
    for _, t in docs:
        w = cut(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


def groups():
    docs, at = [], 1000
    for size, edits, seed in ((40, 6, 1), (25, 9, 2), (12, 3, 3), (2, 1, 4)):
        base = words(250, seed, 5000)
        for k in range(size):
            docs.append((at, " ".join(edited(base, edits, 100 * seed + k))))
            at -= 7
    chain = words(100, 9, 5000)
    for k in range(8):  # each links with the next only
        docs.append((2000 + k, " ".join(chain[6 * k :] + words(6 * k, 50, 5000))))
    common = words(60, 10)
    docs += [(3000 + k, " ".join(common + words(100, 500 + k, 5000))) for k in range(30)]
    docs += [(5, " ".join(words(250, 1, 5000))), (3, " ".join(words(250, 1, 5000)).upper())]
    return docs + EDGES


@pytest.mark.parametrize("frequent,stretch,broadcast", [(100_000, 1, 0), (100_000, 4, 10**6), (0, 4, 10**6)])
def test_similar_sets(spark, monkeypatch, frequent, stretch, broadcast):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(jaccard, "FREQUENT", max(frequent, 1))
    monkeypatch.setattr(jaccard, "STRETCH_MIN", stretch)
    docs = groups()
    got = jaccard.similar_sets(documents(spark, docs, clashing=True)).drop("text_hash").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_similar(docs)


def test_similar_sets_of_an_empty_table(spark):
    assert jaccard.similar_sets(documents(spark, [])).count() == 0


# --- op2 ---------------------------------------------------------------------------------


def test_fingerprints(spark):
    base = words(300, 21, 5000)
    docs = [(k, " ".join(edited(base, 4 * k, k))) for k in range(8)] + EDGES
    frame = fingerprint.fingerprints(documents(spark, docs, clashing=True), mark="text")
    rows = {(r.doc_id, r.text): r.mark for r in frame.collect()}
    assert rows[5, "one"] == rows[6, "one"] and rows[2, None] == rows[3, ""] == "" and len(rows[8, LONG]) == 512
    shingles = lambda k: {tuple(docs[k][1].split()[i : i + 5]) for i in range(296)}
    pairs = [(a, b) for a in range(8) for b in range(8)]
    near = spark.createDataFrame([(a, b, rows[docs[a]], rows[docs[b]]) for a, b in pairs], "a int, b int, x string, y string")
    for r in near.withColumn("s", fingerprint.likeness(near.x, near.y)).collect():
        true = len(shingles(r.a) & shingles(r.b)) / len(shingles(r.a) | shingles(r.b))
        assert abs(r.s - true) < 0.15 and (r.a != r.b or r.s == 1.0)


def test_next_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprint, "NEXT_ROWS", 3)
    rows = [(k * k, f"{'é' * k} text of {k} and more") for k in range(1, 20)] + [(500, ""), (501, None)]
    for name, part in (("many", rows), ("one", rows[:1]), ("none", [])):
        documents(spark, part).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = {r.doc_id: r for r in fingerprint.op2_fingerprints(spark, str(tmp_path / name)).collect()}
        order = sorted(part, reverse=True)
        assert len(got) == len(part)
        for i, (d, t) in enumerate(order):
            t, following = t or "", order[(i + 1) % len(order)][1] or ""
            k = len(t) // 3
            want = t[: len(t) - k] + following[:k]
            assert got[d].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[d].n_chars == len(t)
            assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1


# --- op3 ---------------------------------------------------------------------------------

RECORD = "record_id bigint, record_type string, url string, ts bigint, status int, headers map<string,string>, payload_digest string, last string, _block int"


def captures():
    u, v = "http://A.example:80/x#f", "http://a.example/x"
    rows = []
    for k in range(40):  # one address many times
        if k % 7 == 3:
            rows.append((k, "response", u, k // 2, 200, {"ETag": f'"{k}"', "X": str(k), "Content-Length": "9"}, f"d{k}"))
        else:
            rows.append((k, "revisit", v, k // 2, 304, {"etag": f'W/"{k - k % 7 + 3}"' if k % 7 > 3 else '"0"', "Content-Length": "0", "Date": str(k)}, None))
    return rows + [
        (100, "response", "https://b.example", 1, 404, {"ETag": '"1"'}, "d"), (101, "revisit", "https://B.example/", 2, 304, {"ETag": '"1"'}, None),
        (102, "response", "https://c.example/", 1, 200, {"Last-Modified": "m", "Keep": "k"}, "d"), (103, "revisit", "https://c.example:443", 2, 304, {"last-modified": "m", "Connection": "Keep, X", "X": "1", "Keep": "n"}, None),
        (104, "revisit", "https://c.example/", 3, 304, None, None), (105, "revisit", None, 3, 304, {}, None), (106, "revisit", "/relative", 3, 304, {}, None),
        (107, "revisit", "https://c.example/", None, 304, {"ETag": '"1"', "etag": "2"}, None), (108, "request", "https://c.example/", 4, None, {}, None),
        (103, "revisit", "https://c.example:443", 2, 304, {"last-modified": "m", "Connection": "Keep, X", "X": "1", "Keep": "n"}, None)]


@pytest.mark.parametrize("every", [2, 10**6])
def test_revisits(spark, every):
    rows = captures()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], RECORD)
    got = {r.record_id: r for r in revisits.resolve_revisits(frame, every).collect()}
    assert revisits.resolve_revisits(frame, every).count() == sum(r[1] == "revisit" for r in rows)
    for k in range(40):
        if k % 7 != 3:
            before = [r[0] for r in rows[:40] if r[1] == "response" and (r[3], r[0]) < (k // 2, k)]
            want = "no_response" if not before else "resolved" if k % 7 > 3 else "validator_mismatch"
            assert got[k].outcome == want and got[k].refers_to == (before[-1] if want == "resolved" else None), k
    assert got[10 + 2].headers == {"etag": 'W/"10"', "x": "10", "content-length": "9", "date": "12"} and got[12].payload_digest == "d10"
    assert got[101].outcome == "no_response" and got[103].headers == {"last-modified": "m", "keep": "k"}
    assert [got[k].outcome for k in (104, 105, 106, 107)] == ["unvalidated", "no_url", "no_url", "no_response"]
    assert got[107].headers == {"etag": '"1"'} and revisits.resolve_revisits(frame.filter("false"), every).count() == 0


# --- op7 ---------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", token_counts.RULES)
@pytest.mark.parametrize("by", ["lines", "fields", 5])
def test_token_counts(spark, rule, by):
    rows = [(None, "src", "One line.\n\nAnother — ünïcode 漢字 line\n"), (2, None, None), (3, "", ""), (4, "s", "x" * 3000), (4, "s", "x" * 3000), (5, "s\n", "\n\n")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, source string, text string, n_tokens int, _0 string")
    got = token_counts.attributed(df, fields=("source", "text"), by=by, rule=rule).collect()
    enc = token_counts.Encoder(token_counts.RANKS)
    for r, (d, s, t) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0])), strict=True):
        text = f"{s or ''}\n{t or ''}"
        ids = enc.encoding.encode_ordinary(text)
        assert r.n_tokens == len(ids) == sum(r.field_tokens) == sum(x.tokens for x in r.section_tokens)
        assert "".join(text[x["from"] : x["to"]] for x in r.section_tokens) == text and len(r.section_tokens) == r.n_sections
        # brute force: byte by byte
        owner = [i for i, x in enumerate(r.section_tokens) for _ in text[x["from"] : x["to"]].encode()]
        at, want, crossing = 0, [0] * r.n_sections, 0
        for i in ids:
            mine = owner[at : at + enc.lengths[i]]
            at += int(enc.lengths[i])
            crossing += len(set(mine)) > 1
            pick = {"first": mine[0], "last": mine[-1], "largest": max(sorted(set(mine)), key=mine.count)}[rule]
            want[pick] += 1
        assert want == [x.tokens for x in r.section_tokens] and crossing == r.n_crossing
    with pytest.raises(ValueError):
        token_counts.attributed(df, rule="none")


# --- op10 --------------------------------------------------------------------------------


def test_pieces(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain, dropped = pieces.Pieces(pieces.MODEL), pieces.Pieces(pieces.MODEL, 0.2, 7)
    texts = [t or "" for _, t in EDGES] + ["  two  spaces ", "a▁b▁▁ c", "x" * 500, "\0\r\n\t", "ﬁ　"]
    for t in texts:
        if pieces.SPACE not in t:
            assert plain.encode(t) == library.encode(t)
        for key in ("1", "2", ""):
            assert dropped.decode(dropped.encode(t, key, 3)) == t and plain.decode(plain.encode(t, key)) == t
    # both agendas agree, and seeds and documents vary the pieces
    units = ["▁understandable", "▁▁▁a", "x" * 40, "▁été—漢", "a", "▁"]
    for one, ids in zip(units, dropped.merged_many(units, np.full(len(units), 5, np.int64)), strict=True):
        assert spelled(dropped, ids) == [b for p in dropped.merged_long(one, 5) for b in ([dropped.ids[p]] if p in dropped.ids else dropped._in_bytes(p))]
    ways = {tuple(pieces.Pieces(pieces.MODEL, 0.2, seed).encode("an understandable sentence about roads")) for seed in range(6)}
    assert len(ways) > 1
    assert len({tuple(dropped.encode("understandable " * 5, str(k), 3)) for k in range(20)}) > 1
    df = documents(spark, EDGES, clashing=True)
    back = pieces.decoded(pieces.encoded(df, dropout=0.2)).collect()
    assert [r.decoded for r in back] == [r.text for r in back] and len(back) == len(EDGES)
    figures = {(r.doc_id, r.decoded_sha256): r for r in pieces.digest_rows(df).collect()}
    for d, t in EDGES:
        assert (d, hashlib.sha256(t.encode()).hexdigest() if t is not None else None) in figures
    assert pieces.digest_rows(documents(spark, [])).count() == 0


def spelled(vocabulary, ids):
    return vocabulary._spelled(np.array(ids, np.int32), np.array([len(ids)]))[0].tolist()


def test_pieces_of_each_occurrence():
    some = pieces.Pieces(pieces.MODEL, 0.1, 7)
    units = ["▁understandable", "▁roads", "▁é漢", "x" * 60]
    want = pieces.Pieces(pieces.MODEL, 0.1, 7)
    # as many ways as chance gives, not one or two for all occurrences
    n = 4000
    ids = some.encode("understandable " * n, "1")
    cut = [tuple(x) for x in np.split(ids, np.flatnonzero(np.isin(ids, [i for p, i in some.ids.items() if p[0] == pieces.SPACE]))[1:])]
    assert len(set(cut)) > 30
    # every candidate is drawn for: so many occurrences have no skip at all
    start = some.states.of_unit["▁understandable"]
    draws = len("▁understandable") - len(pieces.Pieces(pieces.MODEL).encode("understandable"))
    streams = np.random.default_rng(1).integers(0, 1 << 63, n).astype(np.uint64)
    assert some.states.draws.data[start] == draws
    ends, more = some._drawn(np.full(n, start), streams)
    ends[more] = -1
    assert abs((ends == start).mean() - 0.9**draws) < 0.03
    assert abs(len(more) / n - (1 - 0.9**draws - draws * 0.1 * 0.9 ** (draws - 1))) < 0.05
    # in a long unit, a candidate is dropped in one place and not in another
    assert len(set(want.merged_long("ab" * 3000, 3))) > 2
    # what is kept of former occurrences changes no ids: each equals a run of the agenda with its own draws
    text, keys = " ".join(u[1:] for u in units[:3]) + " " + "y" * 60, [str(k) for k in range(300)]
    again = some.encode_many([text] * 300, keys)
    for k in (0, 17, 299):
        assert again[k] == pieces.Pieces(pieces.MODEL, 0.1, 7).encode(text, str(k)) != some.encode(text, str(k), 1)
    for unit in units[:3]:
        start = some.states.of_unit[unit]
        ends, more = some._drawn(np.full(500, start), streams[:500])
        kept = np.setdiff1d(np.arange(500), more)
        assert len(kept) < 500 or draws < 2 or unit != units[0]
        for s, ids in zip(ends[kept], want.merged_many([unit] * len(kept), streams[:500][kept]), strict=True):
            a, k = some.states.begin.data[s], some.states.n_ids.data[s]
            assert some.states.ids.data[a : a + k].tolist() == spelled(want, ids)
        own = want.merged_many([unit] * len(more), streams[:500][more]) if len(more) else []
        assert some._own_agendas([unit] * len(more), streams[:500][more]) == [spelled(want, ids) for ids in own]


def test_words_that_stand_alone_keep_no_states():
    some, again = pieces.Pieces(pieces.MODEL, 0.3, 7), pieces.Pieces(pieces.MODEL, 0.3, 7)
    text = "understandable roads  and roads ▁é漢\n alone"
    keys = [str(k) for k in range(40)]
    one = [some.encode(text, k) for k in keys]
    assert "▁roads" in some.states.of_unit and "▁understandable" not in some.states.of_unit
    # the same ids as by states, all texts at once
    assert again.encode_many([text] * 40, keys) == one and "▁understandable" in again.states.of_unit
    assert [some.decode(x) for x in one] == [text] * 40


def test_queries_give_their_full_results(spark, tmp_path):
    rows = [(1, "s", "some words of a text " * 90), (2, None, None), (None, "", "é▁漢")]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    reader = pieces.Pieces(pieces.MODEL)
    found = {r.doc_id: r for r in pieces.op10_pieces(spark, str(tmp_path)).collect()}
    for d, _, t in rows:
        r = found[d]
        assert (r.piece_ids is None) == (t is None) and (t is None or reader.decode(r.piece_ids) == t)
        want = (None,) * 3 if t is None else (len(r.piece_ids), sha(",".join(map(str, r.piece_ids))), sha(t))
        assert (r.n_pieces, r.piece_ids_sha256, r.decoded_sha256) == want
    for r in token_counts.op7_token_counts(spark, str(tmp_path)).collect():
        assert sum(x.tokens for x in r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections
        assert r.sections_sha256 == sha(",".join(":".join(map(str, x)) for x in r.section_tokens))
