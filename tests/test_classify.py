import pandas as pd
from pyspark.sql import functions as F

from changewatch.operators import classify as C

ROW = ("title string, owner string, description string, infer_status boolean, changed boolean,"
       " document_links array<struct<title:string,url:string,date:string>>")


def frame(spark):
    return spark.createDataFrame([
        ("Speers Road Widening Study", "o", "The study is underway.", True, True, []),
        ("Creek Erosion Control", "o", "Works on hold.", True, True, None),
        ("Main Street Watermain", "o", "x", False, True, []),
        ("Budget", "o", "", True, True, [("Notice of Study Completion", "u", None)]),
        ("Roundabout", "o", "", True, False, [])], ROW)


def test_rules(spark):
    got = {r.title: (r.c_scope, r.c_status) for r in C.classify_by_rules()(frame(spark)).collect()}
    assert got == {"Speers Road Widening Study": ("in_scope", "on_going"), "Creek Erosion Control": ("out_of_scope", "deferred"),
                   "Main Street Watermain": ("out_of_scope", None), "Budget": ("unclassified", "completed"), "Roundabout": (None, None)}


def test_function_sees_changed_rows_only_and_is_checked(spark):
    def judge(batch: pd.DataFrame) -> pd.DataFrame:
        assert "Roundabout" not in set(batch["title"])
        return pd.DataFrame({"scope": ["bad" if t == "Budget" else "in_scope" for t in batch["title"]],
                             "reasoning": batch["title"].str.upper(), "status": "completed"}, index=batch.index)

    rows = C.classify_by_function(judge)(frame(spark)).collect()
    got = {r.title: (r.c_scope, r.c_reasoning, r.c_status) for r in rows}
    assert got["Speers Road Widening Study"] == ("in_scope", "SPEERS ROAD WIDENING STUDY", "completed")
    assert got["Main Street Watermain"][2] is None
    assert got["Budget"] == (None, None, None) and got["Roundabout"] == (None, None, None)
    assert {r.title: r.c_error for r in rows if r.c_error} == {"Budget": "classifier gave no valid answer"}


def test_one_failing_record_does_not_fail_its_batch(spark):
    def judge(batch):
        if "Budget" in set(batch["title"]):
            raise ValueError("down")
        return pd.DataFrame({"scope": "in_scope", "reasoning": "r", "status": None}, index=batch.index)

    rows = {r.title: r for r in C.classify_by_function(judge)(frame(spark).coalesce(1)).filter("changed").collect()}
    assert rows["Budget"].c_scope is None and "down" in rows["Budget"].c_error
    assert {r.c_scope for t, r in rows.items() if t != "Budget"} == {"in_scope"}


def test_event_rules_see_cleaned_text(spark):
    pages = ["<p>An open&nbsp;house is planned for June 5, 2025.</p>", "<p>An open <b>house</b> is planned for June 5, 2025.</p>",
             "<p>A public information<br>centre is planned for June&#32;5, 202&#53;.</p>", "<p>An open house is planned.</p>"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    got = {r.i: [(x.type, x.event_date) for x in r.e] for r in df.select("i", C.items_by_rules("h").alias("e")).collect()}
    assert got == {0: [("open_house", "2025-06-05")], 1: [("open_house", "2025-06-05")], 2: [("open_house", "2025-06-05")], 3: []}


EVENTS = [
    ("Open house: June 5, 2025<br>Workshop: July 8, 2025", [("open_house", "2025-06-05", None)]),
    ("Open house: June 5, 2025<br/>Comments due July 8, 2025<br>Public hearing: <b>August</b> 9, 2025, 7 p.m.",
     [("open_house", "2025-06-05", None), ("comment_deadline", None, "2025-07-08"), ("hearing", "2025-08-09T19:00", None)]),
    ("Open houses:<br>June 5, 2025, 6 p.m.<br>June&nbsp;12, 2025<br>2025-06-19 at 10:30 a.m.",
     [("open_house", "2025-06-05T18:00", None), ("open_house", "2025-06-12", None), ("open_house", "2025-06-19T10:30", None)]),
    ("Comments are taken from June 1, 2025 to Monday, June 30, 2025 and the hearing is on July 2, 2025",
     [("comment_deadline", "2025-06-01", "2025-06-30"), ("hearing", "2025-07-02", None)]),
    ("Send feedback between June 1, 2025 and June 30, 2025", [("comment_deadline", "2025-06-01", "2025-06-30")]),
    ("An open house on June 5, 2025 and another on June 6, 2025", [("open_house", "2025-06-05", None), ("open_house", "2025-06-06", None)]),
    ("From 6 p.m. to 8 p.m. on June 5, 2025 an open house takes place", [("open_house", "2025-06-05T18:00", None)]),
    ("The hearing of June 5, 2025 &ndash; June 6, 2025", [("hearing", "2025-06-05", "2025-06-06")]),
    ("Public hearing on the<br>crossing is on<br>June 5, 2025", [("hearing", "2025-06-05", None)]),
    ("The hearing is on February 30, 2025", []), ("Built in 2025 after a hearing", []),
]


def test_several_events_in_lines_and_sentences(spark):
    df = spark.createDataFrame([(i, f"<p>{h}</p>") for i, (h, _) in enumerate(EVENTS)], "i int, h string")
    got = {r.i: [(x.type, x.event_date, x.end_date) for x in r.e] for r in df.select("i", C.items_by_rules("h").alias("e")).collect()}
    for i, (html, want) in enumerate(EVENTS):
        assert got[i] == want, html


def test_events_of_lines_keep_their_own_place_and_link(spark):
    html = ('Open house: June 5, 2025 at Town Hall, <a href="/one">map</a><br>Open house: June 6, 2025, online<br>'
            'Hearing: June 7, 2025 at Hall Two <a href="/two?a&amp;b">more</a>')
    row = spark.createDataFrame([(html,)], "h string").select(C.items_by_rules("h").alias("e")).first()
    assert [(x.location, x.url, x.notes) for x in row.e] == [
        ("Town Hall", "/one", "Open house: June 5, 2025 at Town Hall, map"), ("Online", None, "Open house: June 6, 2025, online"),
        ("Hall Two", "/two?a&b", "Hearing: June 7, 2025 at Hall Two more")]


def test_items_by_rules(spark):
    html = ('<p>An open house will be held on June 5, 2025 at 6:30 p.m. at Town Hall. See <a href="https://x.ca/a?b&amp;c">more</a>.</p>'
            "<ul><li>Comments are due by July 1st, 2025.</li><li>Comment period: 2025-06-01 to 2025-06-30</li></ul>"
            "The public hearing is online on August 9, 2025, 10 a.m.<br>Nothing dated about feedback.")
    df = spark.createDataFrame([(html,), ("  ",), (None,)], "h string")
    rows = df.select(C.items_by_rules("h").alias("i")).collect()
    got = [(x.type, x.event_date, x.end_date, x.location) for x in rows[0].i]
    assert got == [("open_house", "2025-06-05T18:30", None, "Town Hall"), ("comment_deadline", None, "2025-07-01", None),
                   ("comment_deadline", "2025-06-01", "2025-06-30", None), ("hearing", "2025-08-09T10:00", None, "Online")]
    assert rows[1].i == [] and rows[2].i == []


def test_items_by_function(spark):
    def find(page):
        if "bad" in page:
            raise ValueError
        return [{"type": "hearing", "notes": page}, {"type": "party"}]

    df = spark.createDataFrame([("a",), ("bad",), (" ",)], "h string")
    rows = df.select(C.items_by_function(find)("h").alias("i")).collect()
    assert [x.type for x in rows[0].i] == ["hearing", "party"] and rows[1].i is None and rows[2].i == []
    items = df.select(F.explode(C.items_by_function(find)("h")).alias("i")).select("i.*")
    ok, bad = C.split_valid(items)
    assert ok.count() == 1 and bad.count() == 1
