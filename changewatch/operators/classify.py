"""Classification of changed records and extraction of dated events.

The default is a table of keyword rules compiled to one native CASE. A function
on pandas batches can take its place; it then sees changed records only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewatch.functions import html as H
from changewatch.functions import text as T
from changewatch.model import EVENT_TYPES, EXTRACTED_ITEM, EXTRACTED_TYPES, SCOPES, STATUSES


@dataclass(frozen=True)
class Keyword:
    """First matching rule wins; ``pattern`` is searched case-insensitively."""

    label: str
    pattern: str
    reason: str


SCOPE_RULES = (
    Keyword("in_scope", r"grade separation|overpass|underpass", "Grade separation."),
    Keyword("in_scope", r"intersection|roundabout", "Intersection improvements."),
    Keyword("in_scope", r"cycl|bike|multi-use p|pedestrian|sidewalk|active transportation|crosswalk",
            "Active transportation."),
    Keyword("in_scope", r"traffic calming|road safety|speed (?:limit|cushion|hump)", "Traffic calming."),
    Keyword("in_scope", r"transit|bus rapid|light rail", "Transit project with road implications."),
    Keyword("in_scope", r"\b(?:road|street|avenue|drive|boulevard|corridor|line)\b.{0,60}"
            r"(?:widening|extension|improvement|reconstruction|corridor|study|environmental)",
            "Road corridor study."),
    Keyword("out_of_scope", r"wastewater|water ?main|watermain|sewer|reservoir|pumping station|water supply",
            "Water or wastewater infrastructure."),
    Keyword("out_of_scope", r"biosolid|compost|landfill|waste management", "Waste management."),
    Keyword("out_of_scope", r"energy|substation|transmission line|solar|hydro corridor", "Energy project."),
    Keyword("out_of_scope", r"flood|creek|erosion|stormwater|utility|utilities",
            "Utility or creek works without a road component."),
)

STATUS_RULES = (
    Keyword("completed", r"notice of (?:study )?completion|environmental study report|"
            r"study (?:is|has been|was) (?:now )?(?:complete|finished)", "Completed."),
    Keyword("deferred", r"on hold|paused|deferred|postponed", "Deferred."),
    Keyword("on_going", r"underway|in progress|on-?going|active(?:ly)?\b.{0,20}study|public information centre|"
            r"notice of (?:study )?commencement", "Active."),
)


def by_rules(text: Column, rules: tuple[Keyword, ...], default: str, reason: str) -> Column:
    """``struct(label, reason)`` of the first rule that matches ``text``."""

    def result(label: str, why: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(why).alias("reason"))

    out = result(default, reason)
    for rule in reversed(rules):
        hit = F.regexp_like(text, F.lit("(?is)" + rule.pattern))
        out = F.when(hit, result(rule.label, rule.reason)).otherwise(out)
    return out


def study_text(title: Column, description: Column) -> Column:
    return F.concat_ws("\n", title, T.truncate(description))


def classify_by_rules(
    scope_rules: tuple[Keyword, ...] = SCOPE_RULES, status_rules: tuple[Keyword, ...] = STATUS_RULES
) -> Callable[[DataFrame], DataFrame]:
    """Classifier for :func:`changewatch.operators.diff.fold`; changed rows only."""

    def classify(df: DataFrame) -> DataFrame:
        text = study_text(F.col("title"), F.col("description"))
        links = T.blank_to_null(
            F.array_join(F.transform("document_links", lambda x: x["title"]), "\n")
        )
        status_text = F.concat_ws("\n", text, links)
        # CASE branches are lazy, so unchanged rows run no pattern
        scope = F.when(F.col("changed"), by_rules(text, scope_rules, "unclassified", "No rule matched."))
        status = F.when(
            F.col("changed") & F.col("infer_status"),
            by_rules(status_text, status_rules, "unknown", "No rule matched."),
        )
        return (
            df.withColumns({"_c": scope, "_s": status})
            .withColumns({"c_scope": F.col("_c.label"), "c_reasoning": F.col("_c.reason"), "c_status": F.col("_s.label")})
            .drop("_c", "_s")
        )

    return classify


def classify_by_function(
    fn: Callable[[pd.DataFrame], pd.DataFrame],
) -> Callable[[DataFrame], DataFrame]:
    """Classifier around ``fn``: a batch of changed records -> scope, reasoning, status.

    ``fn`` gets title, owner, description, infer_status and must return one row per
    input row. Its output is checked: an answer outside the enumerations, or an
    exception, is an error of that record (``c_error``): the fold then keeps what is
    stored and the run reports it and tries again. A batch that fails is asked again
    row by row, so that one bad record does not fail the others.
    """
    wanted = ["scope", "reasoning", "status"]

    @F.pandas_udf("struct<scope:string,reasoning:string,status:string,error:string>")
    def judged(batch: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({c: None for c in (*wanted, "error")}, index=batch.index, dtype=object)
        asked = batch[batch["title"].notna()]
        parts = [asked] if len(asked) else []
        while parts:
            part = parts.pop()
            try:
                out.loc[part.index, wanted] = fn(part)[wanted].to_numpy()
            except Exception as err:  # noqa: BLE001 - one bad record must not end the run
                if len(part) == 1:
                    out.loc[part.index, "error"] = f"classifier failed: {err}"
                else:
                    parts += [part.iloc[i : i + 1] for i in range(len(part))]
        return out

    def classify(df: DataFrame) -> DataFrame:
        # unchanged rows travel as NULLs and never reach the function
        asked = F.struct(
            *(F.when(F.col("changed"), F.col(c)).alias(c) for c in ("title", "owner")),
            F.when(F.col("changed"), T.truncate("description")).alias("description"),
            F.col("infer_status"),
        )
        answer = F.col("_answer")
        ok = F.coalesce(answer["scope"].isin(*SCOPES) & answer["reasoning"].isNotNull(), F.lit(False))
        good = F.col("changed") & ok
        return (
            df.withColumn("_answer", judged(asked))
            .withColumns(
                {
                    "c_scope": F.when(good, answer["scope"]),
                    "c_reasoning": F.when(good, answer["reasoning"]),
                    "c_status": F.when(
                        good & F.col("infer_status") & answer["status"].isin(*STATUSES), answer["status"]
                    ),
                    "c_error": F.when(
                        F.col("changed") & ~ok,
                        F.coalesce(answer["error"], F.lit("classifier gave no valid answer")),
                    ),
                }
            )
            .drop("_answer")
        )

    return classify


# --- dated events ---------------------------------------------------------------------

_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_DATE = rf"(?:{_MONTHS})\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s+[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:T[0-9]{{2}}:[0-9]{{2}})?"
_TIME = r"\b[0-9]{1,2}(?::[0-9]{2})?\s*[ap]\.?m\b"

EVENT_RULES = (
    Keyword("hearing", r"\bhearing\b", ""),
    Keyword("comment_deadline", r"\bcomments?\b|\bfeedback\b|\bsubmissions?\b", ""),
    Keyword("open_house", r"open house|information cent(?:re|er)|\bPICs?\b|online consultation|public meeting", ""),
)


def _iso_date(found: Column) -> Column:
    months = F.split(F.lit(_MONTHS), "[|]")
    name = F.lower(F.regexp_extract(found, "^([A-Za-z]+)", 1))
    month = F.array_position(months, name)
    day = F.concat_ws(
        "-",
        F.regexp_extract(found, "([0-9]{4})$", 1),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(F.regexp_extract(found, "^[A-Za-z]+\\s+([0-9]+)", 1), 2, "0"),
    )
    iso = F.when(F.regexp_like(found, F.lit("^[0-9]{4}-")), found).otherwise(day)
    return T.let(iso, lambda d: F.when(F.left(d, F.lit(10)).try_cast("date").isNotNull(), d))


def _clock(found: Column) -> Column:
    """``T18:30`` of a time of day; NULL if it is none."""
    hour = T.blank_to_null(F.regexp_extract(found, r"^([0-9]+)", 1)).try_cast("int")
    minute = F.regexp_extract(found, r":([0-9]{2})", 1)
    full = F.pmod(hour, F.lit(12)) + F.when(F.contains(F.lower(found), F.lit("p")), 12).otherwise(0)
    return F.when(
        hour.between(1, 12),
        F.concat(F.lit("T"), F.lpad(full.cast("string"), 2, "0"), F.lit(":"),
                 F.when(minute == "", F.lit("00")).otherwise(minute)),
    )


BREAK = "\u0002"  # a line break inside a sentence


def sentences(html: Column | str) -> Column:
    """Sentences of an HTML fragment, their links kept, as an array; ``BREAK`` marks their line breaks."""
    html = F.col(html) if isinstance(html, str) else html
    lines = F.regexp_replace(html, r"(?i)<br\s*/?>", f" {BREAK} ")  # a line break ends no sentence
    blocks = F.regexp_replace(lines, r"(?i)</(?:p|li|h[1-6]|div|td|tr)>", "\u0001")
    ends = F.regexp_replace(blocks, r"([.!?])(\s+)(<?[A-Z])", "$1\u0001$3")
    # an abbreviated time ends in a full stop too
    whole = F.regexp_replace(ends, r"(?i)([ap]\.m\.)\u0001", "$1 ")
    return F.filter(F.split(whole, "\u0001", -1), T.has_text)


def _across_lines(pattern: str) -> str:
    return pattern.replace(" ", rf"[\s{BREAK}]+")


_KEYWORDS = "|".join(_across_lines(rule.pattern) for rule in EVENT_RULES)
_RANGES = ("to", "through", "until", "till", "–", "—", "-")
_RANGE = r"\b(?:to|through|until|till)\b|[–—-]"
_TOKEN = rf"(?i){_DATE}|{_TIME}|{_KEYWORDS}|{_RANGE}|\bbetween\b|\band\b|{BREAK}"
#: A range word joins two dates if it is so near to them (a weekday or "on" may stand between).
_NEAR = 15
_WORDS = "array<struct<s:int,e:int,line:int,rank:int>>"
_DATES = "array<struct<s:int,e:int,line:int,day:string,time:string,until:string>>"


def _typed_tokens(text: Column) -> Column:
    """Dates, times, keywords, range words and line breaks of a sentence, in order, with the text length before each."""
    # the gaps are bound once: inside the transform they would be cut anew for every token
    found = F.struct(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)).alias("tokens"), F.split(text, _TOKEN, -1).alias("gaps"))

    def typed(gaps: Column, w: Column, k: Column) -> Column:
        # what a token is shows at its start; only keywords are looked at again
        digit = F.left(w, F.lit(1)).between("0", "9")
        iso = digit & (F.substr(w, F.lit(5), F.lit(1)) == "-")
        is_date = iso | (~digit & F.regexp_like(w, F.lit(rf"(?i)^(?:{_MONTHS})\s")))
        small = F.lower(w)
        ranged, other = small.isin(*_RANGES), small.isin("between", "and", BREAK)
        rank = F.lit(None).cast("int")
        for at, rule in reversed(list(enumerate(EVENT_RULES))):
            rank = F.when(F.regexp_like(w, F.lit("(?is)" + _across_lines(rule.pattern))), F.lit(at)).otherwise(rank)
        return F.struct(
            F.length(F.get(gaps, k)).alias("gap"), F.length(w).alias("n"),
            F.when(is_date, _iso_date(w)).alias("day"), F.when(digit & ~iso, _clock(w)).alias("time"),
            F.when(~digit & ~ranged & ~other, rank).alias("rank"),
            ranged.alias("range"), (small == "between").alias("between"), (small == "and").alias("both"),
            F.when(F.contains(w, F.lit(BREAK)), F.size(F.split(w, BREAK, -1)) - 1).otherwise(0).alias("breaks"),
        )

    return T.let(found, lambda x: F.transform(x["tokens"], lambda w, k: typed(x["gaps"], w, k)))


def _scan(tokens: Column) -> Column:
    """One pass over the tokens: (words, dates), each with its place and line; a date may have a time and an end."""

    def step(a: Column, t: Column) -> Column:
        start = a["pos"] + t["gap"]
        end = start + t["n"]
        line = a["line"] + t["breaks"]
        last = F.get(a["dates"], F.size(a["dates"]) - 1)
        follows = F.coalesce(last["line"] == line, F.lit(False))
        joins = follows & (a["link"] >= 0) & (start - a["link"] <= _NEAR) & last["until"].isNull()
        timed = follows & last["time"].isNull() & last["until"].isNull()
        earlier = F.slice(a["dates"], F.lit(1), F.greatest(F.size(a["dates"]) - 1, F.lit(0)))

        def entry(s: Column, ln: Column, day: Column, time: Column, until: Column) -> Column:
            names = (s.alias("s"), end.alias("e"), ln.alias("line"), day.alias("day"), time.alias("time"), until.alias("until"))
            return F.array(F.struct(*names)).cast(_DATES)

        none = F.lit(None).cast("string")
        dates = (
            F.when(t["day"].isNotNull() & joins, F.concat(earlier, entry(last["s"], line, last["day"], last["time"], t["day"])))
            .when(t["day"].isNotNull(), F.concat(a["dates"], entry(start, line, t["day"], a["pending"], none)))
            .when(t["time"].isNotNull() & timed, F.concat(earlier, entry(last["s"], line, last["day"], t["time"], none)))
            .otherwise(a["dates"])
        )
        word = F.array(F.struct(start.alias("s"), end.alias("e"), line.alias("line"), t["rank"].alias("rank"))).cast(_WORDS)
        ranged = follows & (start - last["e"] <= _NEAR) & (t["range"] | (t["both"] & a["between"]))
        return F.struct(
            end.alias("pos"), line.alias("line"),
            # a time before its date waits for it; the first of several counts
            F.when(t["day"].isNotNull() | (t["breaks"] > 0), none)
            .when(t["time"].isNotNull() & ~follows, F.coalesce(a["pending"], t["time"])).otherwise(a["pending"]).alias("pending"),
            F.when(ranged, end).when(t["time"].isNotNull(), a["link"]).otherwise(F.lit(-1)).alias("link"),
            ((a["between"] | t["between"]) & (t["breaks"] == 0)).alias("between"),
            F.when(t["rank"].isNotNull(), F.concat(a["words"], word)).otherwise(a["words"]).alias("words"),
            dates.alias("dates"),
        )

    start = F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("pending"), F.lit(-1).alias("link"),
        F.lit(False).alias("between"), F.array().cast(_WORDS).alias("words"), F.array().cast(_DATES).alias("dates"),
    )
    return F.aggregate(tokens, start, step, lambda a: F.struct(a["words"].alias("words"), a["dates"].alias("dates")))


def _kind(date: Column, words: Column, dates: Column) -> Column:
    """The keyword nearest to a date: on its own line, else on lines without dates.

    A keyword that is nearer to another date counts only if there is no other; earlier rules count first where two are equally near.
    """
    def apart(w: Column, d: Column) -> Column:
        return F.greatest(w["s"] - d["e"], d["s"] - w["e"], F.lit(0))

    def distance(w: Column) -> Column:
        taken = F.exists(dates, lambda d: (d["line"] == w["line"]) & (apart(w, d) < apart(w, date)))
        return F.struct(w["line"] != date["line"], taken, apart(w, date), w["rank"].alias("rank"))

    usable = F.filter(words, lambda w: (w["line"] == date["line"]) | ~F.exists(dates, lambda d: d["line"] == w["line"]))
    rank = F.array_min(F.transform(usable, distance))["rank"]
    return F.get(F.array(*(F.lit(rule.label) for rule in EVENT_RULES)), rank)


_KEYWORD = "(?is)" + _KEYWORDS


def dated_items(sentence: Column) -> Column:
    """The events a sentence speaks of, as an array: one for each date, or range of dates, that has a keyword.

    Dates and keywords are looked for in the cleaned text, where entities are decoded and inner tags gone. Only
    a sentence with a digit, or an entity that may stand for one, is cleaned at all. Where several lines
    of a sentence have dates, place, link and notes of an event are those of its line.
    """
    none = F.array().cast(f"array<{EXTRACTED_ITEM}>")

    def items(t: Column) -> Column:
        return T.let(
            F.struct(_scan(_typed_tokens(t)).alias("f"), F.split(t, BREAK, -1).alias("lines"), F.split(sentence, BREAK, -1).alias("raw")),
            lambda x: F.filter(F.transform(x["f"]["dates"], lambda d: _item(d, x, t, sentence)), lambda i: i.isNotNull()),
        )

    def speaking(t: Column) -> Column:
        speaks = F.regexp_like(t, F.lit(_KEYWORD)) & F.regexp_like(t, F.lit("[0-9]{4}"))
        return F.when(speaks, items(t)).otherwise(none)

    return F.when(F.regexp_like(sentence, F.lit("[0-9&]")), T.let(H.clean_text(sentence), speaking)).otherwise(none)


def _item(date: Column, found: Column, text: Column, sentence: Column) -> Column:
    dates, words = found["f"]["dates"], found["f"]["words"]
    several = F.exists(dates, lambda d: d["line"] != date["line"])
    own = T.collapse_ws(F.when(several, F.get(found["lines"], date["line"])).otherwise(F.regexp_replace(text, BREAK, " ")))
    markup = F.when(several, F.get(found["raw"], date["line"])).otherwise(sentence)
    timed = F.when(F.length(date["day"]) == 10, F.concat(date["day"], F.coalesce(date["time"], F.lit("")))).otherwise(date["day"])

    def item(x: Column) -> Column:
        due = (x["kind"] == "comment_deadline") & date["until"].isNull()
        place = F.regexp_extract(x["text"], r"\b(?:at|At) (?:the )?([A-Z][\w'&.\-]*(?: [A-Z0-9][\w'&.\-]*)*)", 1)
        place = F.regexp_replace(place, r"[.\-]+$", "")
        return F.struct(
            x["kind"].alias("type"),
            F.when(~due, timed).alias("event_date"),
            F.when(due, timed).otherwise(date["until"]).alias("end_date"),
            F.when(F.regexp_like(x["text"], F.lit(r"(?i)\bonline\b|\bvirtual")), F.lit("Online"))
            .otherwise(T.blank_to_null(place))
            .alias("location"),
            T.blank_to_null(T.decode_entities(F.regexp_extract(markup, 'href="([^"]+)"', 1))).alias("url"),
            x["text"].alias("notes"),
        ).cast(EXTRACTED_ITEM)

    return T.let(F.struct(_kind(date, words, dates).alias("kind"), own.alias("text")), lambda x: F.when(x["kind"].isNotNull(), item(x)))


def items_by_rules(html: Column | str) -> Column:
    """``array<item>`` of a page's dated events; no HTML, no work."""
    html = F.col(html) if isinstance(html, str) else html
    found = F.flatten(F.transform(sentences(html), dated_items))
    return F.when(T.has_text(html), found).otherwise(F.array().cast(f"array<{EXTRACTED_ITEM}>"))


def items_by_function(fn: Callable[[str], list[dict]]) -> Callable[[Column | str], Column]:
    """Extraction by a plug-in: page HTML -> list of items, or an exception.

    A page on which ``fn`` fails gives NULL, which the run reports as quarantined.
    """

    def run(html: Column | str) -> Column:
        col = F.col(html) if isinstance(html, str) else html

        @F.pandas_udf(f"array<{EXTRACTED_ITEM}>")
        def items(pages: pd.Series) -> pd.Series:
            names = ("type", "event_date", "end_date", "location", "url", "notes")

            def one(page):
                if page is None or not page.strip():
                    return []
                try:
                    return [{n: x.get(n) for n in names} for x in fn(page)]
                except Exception:  # noqa: BLE001
                    return None

            return pages.map(one)

        return items(col)

    return run


def valid_item(item: Column, types: tuple[str, ...] = EXTRACTED_TYPES) -> Column:
    """Required fields and enumeration membership of an extracted item."""
    return F.coalesce(item["type"].isin(*types), F.lit(False))


def valid_classification(scope: Column, reasoning: Column) -> Column:
    return F.coalesce(scope.isin(*SCOPES), F.lit(False)) & reasoning.isNotNull()


def split_valid(items: DataFrame, types: tuple[str, ...] = EVENT_TYPES) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows for quarantine) of a frame with a ``type`` column."""
    ok = F.coalesce(F.col("type").isin(*types), F.lit(False))
    return items.filter(ok), items.filter(~ok)
