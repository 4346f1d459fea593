import pytest
from pyspark.sql import functions as F

from changewatch.operators import notify

DIFF = ("study_key string, seq bigint, municipalities array<string>, title string, source_url string, status string, scope string,"
        " scope_reasoning string, is_new boolean, status_changed struct<from:string,to:string>, scope_changed struct<from:string,to:string>")
EVENT = "study_key string, seq bigint, ord int, type string, event_date string, end_date string, location string, url string, notes string"
DOC = "study_key string, seq bigint, ord bigint, title string, url string, published_label string"
PAST, FUTURE = "2000-01-01", "2999-01-01"


def d(status="on_going", scope="in_scope", new=False, st=None, sc=None):
    return dict(status=status, scope=scope, new=new, st=st, sc=sc)


def e(start=None, end=None, **kw):
    return dict(start=start, end=end, **kw)


# name: (diff, events, documents, expected kinds, mention)
CASES = {
    "not relevant, not new": (d(scope="out_of_scope"), [], 0, [], None),
    "new completed": (d("completed", new=True), [], 0, [], None),
    "new deferred": (d("deferred", new=True), [], 0, [], None),
    "completed before": (d("completed"), [], 0, [], None),
    "deferred before": (d("deferred", st=("on_going", "on_going")), [], 0, [], None),
    "became deferred": (d("deferred", st=("on_going", "deferred")), [], 0, ["status"], False),
    "new in scope": (d(new=True), [], 0, ["new"], True),
    "new out of scope": (d(new=True, scope="out_of_scope"), [e()], 1, [], None),
    "status": (d(st=("unknown", "on_going")), [], 0, ["status"], False),
    "scope": (d(sc=("out_of_scope", "in_scope")), [], 0, ["scope"], False),
    "event without dates": (d(), [e()], 0, ["event"], True),
    "event ends ahead": (d(), [e(PAST, FUTURE)], 0, ["event"], True),
    "event ended": (d(), [e(FUTURE, PAST)], 0, [], None),
    "end only": (d(), [e(None, FUTURE)], 0, ["event"], True),
    "starts ahead": (d(), [e(FUTURE)], 0, ["event"], True),
    "started": (d(), [e(PAST)], 0, [], None),
    "today with time": (d(), [e("2024-05-05T10:00")], 0, ["event"], True),
    "completed now": (d("completed", st=("on_going", "completed")), [e(None, FUTURE)], 1, ["status", "documents"], False),
    "documents": (d(), [], 1, ["documents"], False),
    "nothing": (d(), [], 0, [], None),
    "irrelevant with all": (d(scope="out_of_scope", st=("unknown", "on_going")), [e()], 1, [], None),
    "all in order": (d(st=("unknown", "on_going"), sc=("out_of_scope", "in_scope")), [e(), e(FUTURE)], 2,
                     ["status", "scope", "event", "event", "documents"], True),
}


@pytest.fixture(scope="module")
def result(spark):
    diffs, events, docs = [], [], []
    for name, (x, evs, n, _, _) in CASES.items():
        diffs.append((name, 1, ["Oakville", "Milton"], "Ninth Line Bridge", "https://town.example.org/bridge", x["status"], x["scope"], "because",
                      x["new"], x["st"], x["sc"]))
        events += [(name, 1, i, "open_house", v["start"], v["end"], None, None, None) for i, v in enumerate(evs)]
        docs += [(name, 1, i, f"Doc{i}", f"u{i}", "May" if i else None) for i in range(n)]
    m = notify.messages(spark.createDataFrame(diffs, DIFF), spark.createDataFrame(events, EVENT),
                        spark.createDataFrame(docs, DOC), F.lit("2024-05-05")).cache()
    return m, {r.study_key: r for r in notify.payloads(m).collect()}


@pytest.mark.parametrize("name", CASES)
def test_rules(result, name):
    kinds, mention = CASES[name][3:]
    row = result[1].get(name)
    assert [m.kind for m in row.messages] == kinds if row else kinds == []
    assert (row.mention if row else None) == mention


def test_message_content(result):
    by = {m.kind: m for m in result[1]["all in order"].messages}
    study = ("Study", "Ninth Line Bridge", False)
    assert by["status"].title == "UPDATED: Ninth Line Bridge"
    assert [tuple(f) for f in by["status"].fields] == [study, ("Municipalities", "Oakville, Milton", False), ("Status", "Unknown → On Going", True)]
    assert [tuple(f) for f in by["event"].fields] == [study, ("Type", "Open House / PIC", True), ("Date", "January 1, 2999", True)]
    assert by["event"].title == "NEW: Public Engagement Announced for Ninth Line Bridge" and by["event"].url == "https://town.example.org/bridge"
    assert tuple(by["documents"].fields[1]) == ("Documents", "[Doc0](u0)\n[Doc1](u1) — May", False)
    new = result[1]["new in scope"].messages[0]
    assert new.title == "NEW: Ninth Line Bridge" and tuple(new.fields[2]) == ("Summary", "because", False)


@pytest.mark.parametrize("every", [3, 10**6])
def test_chunks_and_long_document_lists(spark, every):
    diffs = spark.createDataFrame([("s", 1, ["A"], "T", "u", "on_going", "in_scope", "r", True, None, None)], DIFF)
    events = spark.createDataFrame([("s", 1, i, "hearing", FUTURE, None, "Hall", "eu", "n") for i in range(23)], EVENT)
    docs = spark.createDataFrame([("s", 1, i, f"D{i}", f"u{i}", None) for i in range(25)], DOC)
    m = notify.messages(diffs, events, docs, F.lit("2024-05-05"), per_part=10, every=every)
    rows = notify.payloads(m, every=every).orderBy("chunk_no").collect()
    assert [len(r.messages) for r in rows] == [10, 10, 5]
    assert [r.mention for r in rows] == [True, False, False]
    assert [x.message_no for r in rows for x in r.messages] == list(range(1, 26))
    text = "\n".join(x.fields[1].value for r in rows for x in r.messages if x.kind == "documents")
    assert text == "\n".join(f"[D{i}](u{i})" for i in range(25))
    event = rows[0].messages[1]
    assert [tuple(f)[:2] for f in event.fields[3:]] == [("Location", "Hall"), ("Notes", "n")] and event.url == "eu"
