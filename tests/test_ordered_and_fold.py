import random

import pytest
from pyspark.sql import functions as F

from changewatch.model import SNAPSHOT
from changewatch.operators import diff
from changewatch.operators.ordered import Scan, ranked


def numbers(spark, n=300, seed=1):
    rnd = random.Random(seed)
    data = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(30)}", i * 7 % 1009, rnd.choice(["a", "b", None])) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, at bigint, v string")


@pytest.mark.parametrize("every", [3, 10, 10**6])
def test_scan_equals_plain_loop(spark, every):
    data, df = numbers(spark)
    scan = Scan(df, ["k"], "at", every)
    assert scan.hot == (every < 10**6)
    out = scan.rank(scan.df, "rank")
    out = scan.previous(out, ["v"], "prev")
    out = scan.latest(out, {"last_v": F.col("v")})
    out = scan.done(scan.is_last(out, "final"))
    got = {(r.k, r.at): (r["rank"], r.prev and (r.prev.v,), r.last_v, r.final) for r in out.collect()}
    want, state = {}, {}
    for k, at, v in sorted(data, key=lambda r: (r[0], r[1])):
        n, prev, last = state.get(k, (0, None, None))
        last = v if v is not None else last
        want[k, at] = [n + 1, prev, last, False]
        state[k] = (n + 1, (v,), last)
    for k in state:
        want[max((k2, a) for k2, a in want if k2 == k)][3] = True
    assert got == {k: tuple(v) for k, v in want.items()}


def test_ranked(spark):
    df = spark.createDataFrame([("a", 5), ("a", 3), ("b", 9)], "k string, at bigint")
    assert sorted(map(tuple, ranked(df, ["k"], "at").collect())) == [("a", 3, 1), ("a", 5, 2), ("b", 9, 1)]


INCOMING = ("key string, seq bigint, source string, title string, owner string, areas array<string>, source_url string,"
            " raw_status string, status string, infer_status boolean, content_hash string, c string, cs string")


def answers(df):
    return df.withColumns({"c_scope": F.when(F.col("changed"), F.col("c")), "c_reasoning": F.when(F.col("changed"), F.concat(F.lit("why "), "c")),
                           "c_status": F.when(F.col("changed"), F.col("cs"))})


def replay(stored, incoming):
    """One upsert after the other, as plain Python."""
    db, steps = {k: dict(v) for k, v in stored.items()}, {}
    for r in sorted(incoming, key=lambda r: r["seq"]):
        old = db.get(r["key"])
        changed = old is None or old["content_hash"] != r["content_hash"]
        status = r["status"]
        if changed:
            scope, why = r["c"], "why " + r["c"]
            if r["infer_status"] and r["cs"]:
                status = r["cs"]
        else:
            scope, why = old["scope"], old["scope_reasoning"] or ""
            if r["infer_status"]:
                status = old["status"]
        steps[r["key"], r["seq"]] = (
            changed, old is None, status, scope, why,
            (old["status"], status) if old and old["status"] != status else None,
            (old["scope"], scope) if old and old["scope"] != scope else None)
        db[r["key"]] = dict(content_hash=r["content_hash"], status=status, scope=scope, scope_reasoning=why,
                            inserted=old["inserted"] if old else "now")
    return steps, db


@pytest.mark.parametrize("every", [4, 10**6])
def test_fold_equals_sequential_upserts(spark, every):
    rnd = random.Random(7)
    scopes, statuses = ["in_scope", "out_of_scope", "unclassified"], ["on_going", "completed", "unknown"]
    stored = {f"k{i}": dict(content_hash=rnd.choice(["h1", "h2", None]), status=rnd.choice(statuses), scope=rnd.choice(scopes),
                            scope_reasoning=rnd.choice(["old", None]), inserted="old") for i in range(0, 40, 2)}
    incoming = []
    for seq in range(260):
        key = "k1" if rnd.random() < 0.35 else "k2" if rnd.random() < 0.3 else f"k{rnd.randrange(30)}"
        incoming.append(dict(key=key, seq=seq, source="s", title="t" + key, owner="o", areas=["a"], source_url=f"u{seq}",
                             raw_status="r", status=rnd.choice(statuses), infer_status=rnd.random() < 0.5,
                             content_hash=rnd.choice(["h1", "h2"]), c=rnd.choice(scopes), cs=rnd.choice(statuses + [None])))
    old, now = "2024-01-01 00:00:00", "2024-02-02 00:00:00"
    snap = spark.createDataFrame(
        [(k, "t" + k, "o", ["a"], "u", v["status"], "r", v["scope"], v["scope_reasoning"], v["content_hash"], None, None, None)
         for k, v in stored.items()], SNAPSHOT).withColumns({c: F.lit(old).cast("timestamp") for c in ("last_seen_at", "inserted_at", "updated_at")})
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in INCOMING.split(", ")) for r in incoming], INCOMING)
    out = diff.fold(df.repartition(3), snap, answers, F.lit(now).cast("timestamp"), every).withColumns(
        {c: F.col(c).cast("string") for c in ("inserted_at", "updated_at", "last_seen_at")}).collect()
    steps, db = replay(stored, incoming)
    pair = lambda x: (x["from"], x["to"]) if x else None
    assert {(r.key, r.seq): (r.changed, r.is_new, r.status, r.scope, r.scope_reasoning, pair(r.status_changed), pair(r.scope_changed))
            for r in out if r.seq >= 0} == steps
    final = {r.key: r for r in out if r.is_final}
    assert sum(r.is_final for r in out) == len(final) == len(db)
    for k, v in db.items():
        r = final[k]
        assert (r.content_hash, r.status, r.scope, r.scope_reasoning) == (v["content_hash"], v["status"], v["scope"], v["scope_reasoning"])
        touched = any(x["key"] == k for x in incoming)
        assert r.inserted_at == (old if v["inserted"] == "old" else now)
        assert (r.updated_at, r.last_seen_at) == ((now, now) if touched else (old, old))


def test_insert_if_absent_and_repeats(spark):
    inc = spark.createDataFrame([("s", "f1", 2, "later"), ("s", "f1", 1, "first"), ("s", "f2", 3, "x"), ("t", "f2", 4, "y")],
                                "k string, f string, ord int, v string")
    stored = spark.createDataFrame([("s", "f2")], "k string, f string")
    new = diff.insert_if_absent(inc, stored, ["k", "f"], ["ord"])
    assert sorted(r.v for r in new.collect()) == ["first", "y"]
    assert sorted(r.v for r in diff.newly_inserted(inc, new, ["k", "f"]).collect()) == ["first", "later", "y"]


def test_merge_documents_precedence(spark):
    links = spark.createDataFrame([("s", "u1", "A", "May", 0), ("s", "u2", "B", None, 1), ("s", "u1", "A2", "June", 2)],
                                  "k string, url string, title string, published_label string, ord int")
    ext = spark.createDataFrame([("s", "u1", "no", "d", 0), ("s", "", "no", "d", 1), ("s", None, "no", "d", 2), ("s", "u3", None, "d3", 3),
                                 ("s", "u3", "late", "d", 4)], "k string, url string, notes string, event_date string, ord int")
    got = diff.merge_documents(links, ext, ["k"]).orderBy("ord").collect()
    assert [(r.url, r.title, r.published_label) for r in got] == [("u1", "A2", "June"), ("u2", "B", None), ("u3", "u3", "d3")]


def test_lookup_and_orphans(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "owner string, x int")
    dim = spark.createDataFrame([("a", 10)], "name string, id int")
    ok, missed = diff.lookup(df, dim, "owner", "name")
    assert [(r.owner, r.id) for r in ok.collect()] == [("a", 10)] and missed.count() == 2
    assert [tuple(r) for r in diff.orphans(df, dim, "owner", "name").collect()] == [("b", 2)]
    assert diff.without_orphans(df, dim, "owner", "name").count() == 1
