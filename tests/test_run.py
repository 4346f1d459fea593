import json
from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from changewatch.model import LANDED
from changewatch.operators import classify as C
from changewatch.plans.run import Settings, run
from changewatch.plans.state import QUARANTINE, State
from changewatch.sources.registry import BURLINGTON, BURLINGTON_NEWS, HALTON_REGION, OAKVILLE
from changewatch.streaming.watch import watch

OAK, BURL, NEWS, HAL = "https://www.oakville.ca", "https://www.getinvolvedburlington.ca", "https://www.burlington.ca", "https://www.halton.ca"
NEWS_PATH = "/en/news/current-city-projects-and-construction/"
EVENT = "<p>An open house will be held on June 5, 2025 at 6:30 p.m. at Town Hall.</p>"


def card(href, title):
    return f'<a class="card" href="{href}"><div class="card-title">{title}</div></a>'


def landed(spark, speers="Road widening is underway.", doc=False, extra=(), fallback="x"):
    hal_row = '<tr><td><a href="{}">{}</a></td><td>{}</td><td>{}</td></tr>'
    table = '<table class="hal-generic-smart-search-results-table"><tbody>' + "".join(
        hal_row.format(*r) for r in [("/dundas", "Dundas Street Widening", "Oakville", "On-going"),
                                     ("/dundas-(1)", "Dundas Street Widening", "Milton", "On-going"),
                                     ("/gone", "No Page", "Milton", "Deferred")]) + "</tbody></table>"
    links = '<div class="widget-link-listing"><ul><li><a href="/getmedia/1">Notice</a></li></ul></div>' if doc else ""
    tile = ("<div class='project-tile' data-state='published'><a class='project-tile__link' href='/tuck'>"
            "<span class='project-tile__meta__name'>Tuck Creek</span></a></div>")
    rows = [
        ("halton_region", "listing", 1, "l1", table), ("halton_region", "listing", 2, "l2", table),
        ("halton_region", "detail", 0, HAL + "/dundas",
         f'<div class="hal-ea-studies-detail"><div class="hal-ea-studies-detail-bottom"><div class="ck-text">{EVENT}</div></div></div>'),
        ("oakville", "listing", 1, "o", '<div class="widget-page-cards">' + card("/speers", "Speers Road Study") + card("/park", "Park") + "</div>"),
        ("oakville", "detail", 0, OAK + "/speers", f'<div class="widget-text">{speers}</div>{links}'),
        ("oakville", "detail", 0, OAK + "/park", f"<main>Creek erosion {fallback}</main>"),
        ("burlington", "listing", 1, "b", tile),
        ("burlington", "detail", 0, BURL + "/tuck", '<div class="shared-content-block">Flood study</div>'),
        ("burlington_news", "listing", 1, "n", json.dumps([{"title": "Tuck Creek", "link": NEWS_PATH + "t.aspx"}])),
        ("burlington_news", "detail", 0, NEWS + NEWS_PATH + "t.aspx", '<div class="ge-content">Pedestrian bridge</div>'),
    ]
    return spark.createDataFrame([*rows, *extra], LANDED)


def at(day):
    return datetime(2025, 5, day, tzinfo=timezone.utc)


def titles(state, name="outbox"):
    df = state.spark.read.parquet(f"{state.root}/outbox/run={state.run}")
    return sorted(m.title for r in df.collect() for m in r.messages)


def metric(state, name):
    df = state.spark.read.parquet(f"{state.root}/metrics/run={state.run}").filter(F.col("metric") == name)
    out = {}
    for r in df.collect():
        out[r.category] = out.get(r.category, 0) + r.n
    return out


def test_runs(spark, tmp_path):
    # blocks of two rows: the large-key path of every ordered scan is taken
    root, s = str(tmp_path / "state"), Settings(buckets=4, every=2)
    state = run(landed(spark), root, "2025-05-01", at(1), s)
    rows = {(r.owner, r.title): r for r in state.snapshot().collect()}
    assert set(rows) == {("Halton Region", "Dundas Street Widening"), ("Town of Oakville", "Speers Road Study"),
                         ("Town of Oakville", "Park"), ("City of Burlington", "Tuck Creek")}
    dundas, tuck = rows["Halton Region", "Dundas Street Widening"], rows["City of Burlington", "Tuck Creek"]
    assert (dundas.areas, dundas.status, dundas.scope, dundas.source_url) == (["Oakville", "Milton"], "on_going", "in_scope", HAL + "/dundas")
    # the two sources of one owner fold into one record: the later one is stored
    assert tuck.source_url == NEWS + NEWS_PATH + "t.aspx" and tuck.scope == "in_scope" and tuck.raw_status == ""
    assert [(e.event_date, e.location) for e in state.events().collect()] == [("2025-06-05T18:30", "Town Hall")]
    assert titles(state) == ["NEW: Dundas Street Widening", "NEW: Public Engagement Announced for Dundas Street Widening",
                             "NEW: Speers Road Study", "UPDATED: Tuck Creek"]
    bad = state.table("quarantine", QUARANTINE).collect()
    assert [(r.stage, r.error, r.url) for r in bad] == [("record", "no detail page", HAL + "/gone")]

    # the same input again: only the two alternating records of one key count as changed
    state = run(landed(spark), root, "2025-05-02", at(2), s)
    assert metric(state, "outcome") == {"unchanged": 3, "changed": 2}
    assert state.events().count() == 1 and metric(state, "new_events") == {}
    again = {(r.owner, r.title): r for r in state.snapshot().collect()}
    park = again["Town of Oakville", "Park"]
    assert (park.inserted_at.day, park.updated_at.day, park.last_seen_at.day) == (1, 2, 2)

    # an edited page, a new document, a fallback page that changed, a record no longer listed
    third = landed(spark, "Notice of study completion: road widening.", doc=True, fallback="y").filter("source = 'oakville'")
    state = run(third, root, "2025-05-03", at(3), s)
    rows = {(r.owner, r.title): r for r in state.snapshot().collect()}
    assert len(rows) == 4 and rows["Town of Oakville", "Speers Road Study"].status == "completed"
    assert rows["Halton Region", "Dundas Street Widening"].last_seen_at.day == 2
    assert titles(state) == ["NEW: Documents Published for Speers Road Study", "UPDATED: Speers Road Study"]
    assert metric(state, "outcome") == {"changed": 2}
    assert [d.url for d in state.documents().collect()] == [OAK + "/getmedia/1"]


def test_split_sources_is_a_no_op_when_repeated(spark, tmp_path):
    root, s = str(tmp_path / "state"), Settings(specs=(BURLINGTON, BURLINGTON_NEWS), buckets=2, split_sources=True)
    run(landed(spark), root, "2025-05-01", at(1), s)
    state = run(landed(spark), root, "2025-05-02", at(2), s)
    assert metric(state, "outcome") == {"unchanged": 2} and titles(state) == []


def test_failed_extraction_is_retried(spark, tmp_path):
    root = str(tmp_path / "state")

    def broken(page):
        raise ValueError

    state = run(landed(spark), root, "2025-05-01", at(1), Settings(specs=(HALTON_REGION,), buckets=2, items=C.items_by_function(broken)))
    assert state.events().count() == 0
    state = run(landed(spark), root, "2025-05-02", at(2), Settings(specs=(HALTON_REGION,), buckets=2))
    assert state.events().count() == 1
    assert "NEW: Public Engagement Announced for Dundas Street Widening" in titles(state)


def test_unpublished_run_leaves_no_trace(spark, tmp_path):
    root, s = str(tmp_path / "state"), Settings(specs=(OAKVILLE,), buckets=2)

    def fail(df):
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        run(landed(spark), root, "2025-05-01", at(1), Settings(specs=(OAKVILLE,), buckets=2, classify=fail))
    assert State(spark, root, 2).run == 0 and State(spark, root, 2).snapshot().count() == 0
    assert run(landed(spark), root, "2025-05-01", at(1), s).snapshot().count() == 2


def test_stream_applies_each_batch_once(spark, tmp_path):
    inbox, root, ck = (str(tmp_path / n) for n in ("in", "state", "ck"))
    s = Settings(specs=(OAKVILLE,), buckets=2)
    landed(spark).coalesce(1).write.parquet(inbox)
    watch(spark, inbox, root, ck, "2025-05-01", at(1), s).awaitTermination(300)
    state = State(spark, root, 2)
    assert (state.run, state.batch_id) == (1, 0) and state.snapshot().count() == 2
    watch(spark, inbox, root, ck, "2025-05-01", at(1), s).awaitTermination(300)
    assert State(spark, root, 2).run == 1
    # a replayed batch changes nothing
    assert run(landed(spark), root, "2025-05-01", at(1), s, batch_id=0).run == 1
    landed(spark, doc=True).coalesce(1).write.mode("append").parquet(inbox)
    watch(spark, inbox, root, ck, "2025-05-02", at(2), s).awaitTermination(300)
    assert State(spark, root, 2).run == 2 and State(spark, root, 2).documents().count() == 1


def quarantined(state):
    rows = state.table("quarantine", QUARANTINE).filter(F.col("run") == state.run).collect()
    return sorted((r.source, r.stage, r.error) for r in rows)


def test_unreadable_pages_change_nothing_and_are_reported(spark, tmp_path, monkeypatch):
    root, s = str(tmp_path / "state"), Settings(specs=(HALTON_REGION, OAKVILLE), buckets=2)
    first = run(landed(spark), root, "2025-05-01", at(1), s)
    before = {r.title: r for r in first.snapshot().collect()}
    # a NULL body cannot be read: the middle page of a listing, and a detail page
    broken = landed(spark).filter("source in ('halton_region', 'oakville')").withColumn(
        "body", F.when((F.col("url") != "l2") & ~F.col("url").endswith("/speers"), F.col("body")))
    tail = '<table class="hal-generic-smart-search-results-table"><tbody><tr><td><a href="/late">Late Road Study</a></td><td>Milton</td><td>On-going</td></tr></tbody></table>'
    extra = spark.createDataFrame([("halton_region", "listing", 3, "l3", tail),
                                   ("halton_region", "detail", 0, HAL + "/late", '<div class="hal-ea-studies-detail"><div class="hal-ea-studies-detail-bottom"><div class="ck-text">Road widening</div></div></div>'),
                                   ("nowhere", "listing", 1, "x", "<p>"), ("oakville", "picture", 1, "y", "<p>")], LANDED)
    state = run(broken.unionByName(extra), root, "2025-05-02", at(2), s)
    after = {r.title: r for r in state.snapshot().collect()}
    assert "Late Road Study" in after  # an unreadable page does not end a listing
    assert after["Speers Road Study"].content_hash == before["Speers Road Study"].content_hash
    assert after["Speers Road Study"].last_seen_at.day == 1
    assert quarantined(state) == sorted([
        ("halton_region", "listing", "unreadable page"), ("halton_region", "record", "no detail page"),
        ("oakville", "record", "unreadable page"), ("nowhere", "landing", "no source reads this kind: listing"),
        ("oakville", "landing", "no source reads this kind: picture")])


def test_failed_classification_keeps_scope_and_is_retried(spark, tmp_path):
    root = str(tmp_path / "state")

    def judge(scope):
        def answer(batch):
            if scope is None:
                raise ValueError("down")
            return pd.DataFrame({"scope": scope, "reasoning": "r", "status": "on_going"}, index=batch.index)

        return Settings(specs=(OAKVILLE,), buckets=2, classify=C.classify_by_function(answer))

    oak = F.col("source") == "oakville"
    run(landed(spark).filter(oak), root, "2025-05-01", at(1), judge("in_scope"))
    state = run(landed(spark, "Edited.").filter(oak), root, "2025-05-02", at(2), judge(None))
    row = {r.title: r for r in state.snapshot().collect()}["Speers Road Study"]
    assert (row.scope, row.status, row.content_hash) == ("in_scope", "on_going", None)
    assert [(a, b) for a, b, _ in quarantined(state)] == [("oakville", "classify")]
    state = run(landed(spark, "Edited.").filter(oak), root, "2025-05-03", at(3), judge("out_of_scope"))
    row = {r.title: r for r in state.snapshot().collect()}["Speers Road Study"]
    assert row.scope == "out_of_scope" and row.content_hash is not None and quarantined(state) == []
