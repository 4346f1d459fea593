import pytest
from pyspark.sql import functions as F

from changewatch.functions import html as H
from changewatch.functions import text as T
from changewatch.functions import urls as U

BASE = "https://www.example.ca"


def each(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalise_status(spark):
    got = each(spark, T.normalise_status,
               ["On-Going", "\ton-going ", "deferred", "DeferreD", "COMPLETED", "completed ",
                " ", "Under way", "on going", " Completed﻿"])
    assert got == ["on_going"] * 2 + ["deferred"] * 2 + ["completed"] * 2 + ["unknown"] * 3 + ["completed"]


def test_has_suffixed_url(spark):
    urls = ["https://h.example/pond-(1)", "https://h.example/x/mill-(3)",
            "https://h.example/k-(27)", "https://h.example/pond",
            "https://h.example/pond/mill/", "https://h.example/pond?v=-(4)",
            "https://h.example/pond#-(4)"]
    assert each(spark, U.has_suffixed_url, urls) == [True] * 3 + [False] * 4


@pytest.mark.parametrize("base,href,want", [
    (BASE, "https://second.net/p", "https://second.net/p"),
    (BASE, "http://second.net/p", "http://second.net/p"),
    (BASE, "//files.third.net/p", "https://files.third.net/p"),
    (BASE, "/one/two", BASE + "/one/two"),
    (BASE + "/", "pond/plan", BASE + "/pond/plan"),
    (BASE, "pond/plan", BASE + "/pond/plan"),
    (BASE, "http://[::bad", "http://[::bad"),
    (BASE, "", BASE + "/"),
    (BASE, "?q=1", BASE + "/?q=1"),
    (BASE + "/a/b?z", "#top", BASE + "/a/b?z#top"),
    (BASE + "/a/b", "c", BASE + "/a/c"),
    (BASE + "/a/b/", "../c", BASE + "/a/c"),
    (BASE, "/a/./b/../c/..", BASE + "/a/"),
    (BASE, "/../x", BASE + "/x"),
    (BASE, "HTTPS://Other.COM:443", "https://other.com/"),
    (BASE, "http://other.com:8080/x", "http://other.com:8080/x"),
    (BASE, "http://other.com:99999/x", "http://other.com:99999/x"),
    (BASE, "mailto:a@b.c", "mailto:a@b.c"),
    (BASE, "  /x y\t ", BASE + "/x%20y"),
    (BASE, "/für", BASE + "/f%C3%BCr"),
    (BASE, "/a\\b", BASE + "/a/b"),
    (BASE, "https:rel", BASE + "/rel"),
    (BASE, "/x?a='b'", BASE + "/x?a=%27b%27"),
])
def test_absolute_url(spark, base, href, want):
    assert each(spark, lambda c: U.absolute_url(c, base), [href]) == [want]


def test_absolutise_hrefs(spark):
    got = each(spark, lambda c: U.absolutise_hrefs(c, BASE), [
        '<a href="/files/map.pdf">map</a>', '<a href="//files.third.net/p">files</a>',
        '<a href="https://second.net/p">x</a>',
        '<p><a href="/a">a</a> and <a href="//files.third.net/b">b</a></p>', '<a href="/">home</a>'])
    assert got == [
        f'<a href="{BASE}/files/map.pdf">map</a>', '<a href="https://files.third.net/p">files</a>',
        '<a href="https://second.net/p">x</a>',
        f'<p><a href="{BASE}/a">a</a> and <a href="https://files.third.net/b">b</a></p>',
        '<a href="/">home</a>']


def test_decode_entities(spark):
    got = each(spark, T.decode_entities, [
        "Roads &amp; Cycling", "plain", "&amp;lt;b&amp;gt;", "&lt;&#39;&#x27;&apos;&gt;", "caf&eacute; &copy;",
        "&#36;5 &#92;", "&unknown; &", "&#38;lt;", "&#128512;", None])
    assert got == ["Roads & Cycling", "plain", "&lt;b&gt;", "<'''>", "café ©", "$5 \\", "&unknown; &",
                   "&lt;", "\U0001F600", None]


def test_whitespace(spark):
    assert each(spark, T.collapse_ws, ["  Lots   of\n\t  space  ", " a b﻿", "", None]) == [
        "Lots of space", "a b", "", None]
    assert each(spark, T.trim_ws, ["\n a  b  "]) == ["a  b"]


def test_labels(spark):
    assert each(spark, T.format_status, ["on_going", "completed"]) == ["On Going", "Completed"]
    assert each(spark, T.format_event_type, ["open_house", "comment_deadline", "hearing", "x"]) == [
        "Open House / PIC", "Comment Deadline", "Public Hearing", "x"]
    df = spark.createDataFrame([
        (0, None, None), (1, "2026-01-05", None), (2, "2026-01-05T10:00", ""), (3, None, "2026-02-01T13:30"),
        (4, "2026-01-05", "2026-02-01"), (5, "2026-01-05T09:15", "2026-02-01"), (6, "soon", None)],
        "i int, s string, e string")
    got = [r.o for r in df.select("i", T.format_date_range("s", "e").alias("o")).orderBy("i").collect()]
    assert got == [
        "Date TBD", "January 5, 2026", "January 5, 2026 at 10:00 a.m.", "February 1, 2026 at 1:30 p.m.",
        "January 5, 2026 at 12:00 a.m. – February 1, 2026 at 11:59 p.m.",
        "January 5, 2026 at 9:15 a.m. – February 1, 2026 at 11:59 p.m.", "soon"]


def test_fingerprint_and_document_label(spark):
    df = spark.createDataFrame([("hearing", None, None, "T", "u", None), ("x", "u", "d", "T", "u", "May"),
                                ("x", "", "", "T", "u", "")], "t string, u string, d string, ti string, l string, lab string")
    rows = df.select(T.event_fingerprint(F.col("t"), F.col("u"), F.col("d")).alias("f"),
                     T.document_label(F.col("ti"), F.col("l"), F.col("lab")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [("hearing::", "[T](u)"), ("x:u:d", "[T](u) — May"), ("x::", "[T](u)")]


def test_native_html(spark):
    page = """<ul><li><A class="doc x" href='/a?b=1&amp;c'>One <b>two</b></A></li><li><a>none</a></li></ul>"""
    df = spark.createDataFrame([(page,)], "h string")
    r = df.select(H.elements("h", "a").alias("all"), H.elements("h", "a", "doc").alias("doc")).first()
    assert len(r["all"]) == 2 and len(r["doc"]) == 1
    r = df.select(H.elements("h", "a").alias("a")).select(
        F.transform("a", lambda x: H.attribute(x, "href")).alias("href"),
        F.transform("a", lambda x: H.clean_text(x)).alias("text")).first()
    assert r.href == ["/a?b=1&c", None] and r.text == ["One two", "none"]
