from changewatch.functions.elements import Rule, of_rule, with_matches

CARD = Rule("cards", ".widget-page-cards a.card", {"href": ((), "attr:href"), "title": ((".card-title",), "text")})
TEXT = {"text": ((), "text")}


def pick(spark, page, *rules):
    found = with_matches(spark.createDataFrame([(page,)], "page string"), "page", {"": rules}).first().m
    return None if found is None else [(m.rule, m["values"]) for m in found]


def test_nested_blocks_and_inner_html(spark):
    page = ('<div class="t x"><div>a<div>b</div></div><p>one<p>two<br>&amp;</div>'
            "<DIV data-n=1 CLASS = 't'><a href='/q?a=1&amp;b'>l</a><!-- <div> --></DIV><script>if (a<b) {}</script>")
    out = [v for _, v in pick(spark, page, Rule("t", ".t", {**TEXT, "html": ((), "html"), "href": (("a",), "attr:href"), "n": (("div",), "count")}))]
    assert [v["text"] for v in out] == ["abonetwo&", "l"] and [v["n"] for v in out] == ["2", "0"]
    assert out[0]["html"] == "<div>a<div>b</div></div><p>one<p>two<br>&amp;" and out[0]["href"] is None
    assert out[1]["html"] == "<a href='/q?a=1&amp;b'>l</a><!-- <div> -->" and out[1]["href"] == "/q?a=1&b"


def test_within_first_match_or_body(spark):
    rule = Rule("m", ":root", TEXT, within="main", otherwise="body", first=True)
    text = lambda page: pick(spark, page, rule)[0][1]["text"]
    assert text("<body><h1>a</h1><main>b</main></body>") == "b"
    assert text("<html><body>x<i>y</i><script>z</script></body></html>") == "xyz"
    assert text("just text") == "just text" and text("") == ""
    assert pick(spark, "<p>x</p>", Rule("m", "p", TEXT, within="main")) == []


def test_end_tags_that_are_missing_or_stray(spark):
    rule = Rule("r", ".res tbody tr", {"n": (("td",), "count"), "c": (("td@1",), "text"), "a": (("td", "a"), "attr:href")})
    page = '<table class="res"><tr><td><a href="/1">x</a><td>two<td>3<tr><td>y</table>'
    assert [v for _, v in pick(spark, page, rule)] == [{"n": "3", "c": "two", "a": "/1"}, {"n": "1", "c": None, "a": None}]
    page = "<ul><li>a<ul><li>b<li>c</ul><li>d</b></p></ul><p>e<div>f</div><select><option>g<option>h</select><p>i"
    got = pick(spark, page, Rule("li", "li", TEXT), Rule("p", "p", TEXT), Rule("o", "option", TEXT))
    assert [(r, v["text"]) for r, v in got] == [("li", "abc"), ("li", "b"), ("li", "c"), ("li", "d"), ("p", "e"), ("p", "i"), ("o", "g"), ("o", "h")]


def test_inner_table_does_not_end_outer_rows(spark):
    page = "<table class='t'><tbody><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr></tbody></table>"
    (_, first), (_, second) = pick(spark, page, Rule("r", ".t tr", {**TEXT, "n": (("td",), "count")}))
    assert (first["text"], first["n"], second["text"]) == ("ainb", "3", "in")


def test_selectors(spark):
    page = ('<nav id="top"><ul><li class="a b"><a href=/1>1</a></li><li class="ab"><a title="x > y" href="/2">2</a></li></ul></nav>'
            '<div id="x"><a class="a" href="/3">3</a><img class="a" src="i"></div>')
    hrefs = lambda item, **scope: [v["h"] for _, v in pick(spark, page, Rule("r", item, {"h": ((), "attr:href")}, **scope))]
    assert hrefs("nav li a") == ["/1", "/2"] and hrefs("li.a a") == ["/1"] and hrefs("li.a.b a") == ["/1"] and hrefs("li.b.c a") == []
    assert hrefs("#x a") == ["/3"] and hrefs("a", within="#x") == ["/3"] and hrefs("#top a", first=True) == ["/1"]
    assert hrefs(".a") == [None, "/3", None] and hrefs("li li a") == []


def test_pages_of_several_sources_in_one_pass(spark):
    page = '<div class="widget-page-cards"><a class="card" href="/x/"><div class="card-title">T</div></a></div>'
    df = spark.createDataFrame([("one", page), ("one", None), ("two", ""), ("two", "<p>1</p>"), ("none", page), (None, page)], "k string, html string")
    rows = with_matches(df, "html", {"one": (CARD,), "two": (Rule("p", "p", TEXT),)}, "k").select("k", of_rule("m", "cards").alias("c"), "m").collect()
    assert rows[0].c[0]["values"] == {"href": "/x/", "title": "T"} and rows[1].m is None and rows[2].m == []
    assert [m["values"] for m in rows[3].m] == [{"text": "1"}] and rows[4].m is None and rows[5].m is None


def test_no_python_in_the_plan(spark):
    df = with_matches(spark.createDataFrame([("<p>1</p>",)], "html string").repartition(2), "html", {"": (CARD,)})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bad_markup_stays_cheap(spark):
    pages = ["<a " + '="' * 50_000, "<" * 50_000, "<div>" * 5_000, "<a b='" * 20_000, "<!-- x>" * 20_000, "<script>" * 20_000, "<p>x" * 5_000]
    df = with_matches(spark.createDataFrame([(p,) for p in pages], "html string"), "html", {"": (CARD, Rule("d", "div", {"n": (("div",), "count")}))})
    found = [len(r.m) for r in df.collect()]
    assert found == [0, 0, 5_000, 0, 0, 0, 0]
    link = '<a href="' + "x" * 50_000 + '">far</a>'
    assert pick(spark, link, Rule("a", "a", TEXT)) == [("a", {"text": "far"})]
