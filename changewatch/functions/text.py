"""Text functions: whitespace, entities, hashes, labels. All native Columns."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from changewatch.model import DESCRIPTION_CHARS

# --- fixed values: the whitespace set of ECMAScript \s and trim() -----------------
SPACES = (
    r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# --- fixed values: scraped status labels ----------------------------------------
STATUS_LABELS = {"on-going": "on_going", "deferred": "deferred", "completed": "completed"}

# --- fixed values: display labels of event types --------------------------------
EVENT_LABELS = {
    "open_house": "Open House / PIC",
    "comment_deadline": "Comment Deadline",
    "hearing": "Public Hearing",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``, a function or SQL text on ``it``.

    A Column used several times is repeated in the expression tree at each use;
    nested re-use makes that tree grow exponentially. A lambda variable does not.
    SQL text costs one call to the JVM, whatever its length.
    """
    if callable(body):
        return F.element_at(F.transform(F.array(value), body), 1)
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"it -> {body}")), 1)


def let_sql(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``value`` bound to ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def trim_ws(c: Column | str) -> Column:
    """Trim every kind of Unicode white space, not only U+0020."""
    return F.btrim(_col(c), F.lit(SPACE_CHARS))


def has_text(c: Column | str) -> Column:
    """Whether anything but white space is there."""
    return F.regexp_like(_col(c), F.lit(f"[^{SPACES}]"))


def collapse_ws(c: Column | str) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), f"[{SPACES}]+", " "))


def blank_to_null(c: Column | str) -> Column:
    """Empty text counts as missing (a falsy test); NULL stays NULL."""
    return F.nullif(_col(c), F.lit(""))


def truncate(c: Column | str, n: int = DESCRIPTION_CHARS) -> Column:
    return F.left(_col(c), F.lit(n))


_CODES = {name: chr(code) for name, code in name2codepoint.items() if name != "amp"}
_CODES["apos"] = "'"
_TABLE = f"""from_json(r'{json.dumps(_CODES).replace("'", chr(92) + "u0027")}', 'map<string,string>')"""

_NAMED = f"""aggregate(
    filter(array_distinct(regexp_extract_all(it, r'&([A-Za-z][A-Za-z0-9]*);', 1)),
           n -> map_contains_key({_TABLE}, n)),
    it, (acc, n) -> replace(acc, concat('&', n, ';'), element_at({_TABLE}, n)))"""


# --- fixed values: code points that browsers give to the numeric references 128 to 159 ---
WINDOWS_1252 = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030,
    0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022,
    0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}
_C1 = "map(" + ", ".join(f"'{a:08X}', '{b:08X}'" for a, b in WINDOWS_1252.items()) + ")"


def _numeric(text: str, prefix: str, digits: str, as_hex: str) -> str:
    """Replace numeric references; "$" and backslash are special in a replacement."""
    shown = f"coalesce(element_at({_C1}, {as_hex}), {as_hex})"
    return rf"""aggregate(
    filter(array_distinct(regexp_extract_all({text}, r'&#{prefix}({digits});', 1)),
           n -> {as_hex} <> '00000026' AND {as_hex} < '00110000'),
    {text}, (acc, n) -> regexp_replace(acc, concat('&#{prefix}', n, ';'),
        regexp_replace(decode(unhex({shown}), 'UTF-32'), r'([\\$])', r'\\$1')))"""


_DECODED = let_sql(
    let_sql(_NAMED, "d", _numeric("d", "", "[0-9]{1,7}", "lpad(hex(int(n)), 8, '0')")),
    "h",
    _numeric("h", "[xX]", "[0-9A-Fa-f]{1,6}", "upper(lpad(n, 8, '0'))"),
)


#: SQL text that decodes ``it``, a text with an ampersand.
DECODED = f"regexp_replace({_DECODED}, r'&(amp|#0*38|#[xX]0*26);', '&')"


def decode_entities(c: Column | str) -> Column:
    """Decode ONE layer of character references; plain text passes unchanged.

    Only texts that hold an ``&`` pay for the look-up. Named references come from
    the HTML 4 table, numeric ones are decoded to their code point, and the
    ampersand itself is decoded last so that ``&amp;lt;`` gives ``&lt;``.
    """
    return let(_col(c), f"CASE WHEN contains(it, '&') THEN {DECODED} ELSE it END")


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def normalise_status(c: Column | str) -> Column:
    """Scraped label to status; anything unknown is ``unknown``."""
    label = F.lower(trim_ws(c))
    out = F.lit("unknown")
    for text, status in STATUS_LABELS.items():
        out = F.when(label == text, F.lit(status)).otherwise(out)
    return out


def content_hash(blocks: Column, links: Column | None = None) -> Column:
    """Digest of block HTML, followed by title+url of each document link."""
    text = F.array_join(blocks, "")
    if links is not None:
        text = F.concat(
            text,
            F.array_join(
                F.transform(
                    links,
                    lambda x: F.concat(
                        F.coalesce(x["title"], F.lit("")), F.coalesce(x["url"], F.lit(""))
                    ),
                ),
                "",
            ),
        )
    return F.sha2(text, 256)


def event_fingerprint(type_: Column, url: Column, event_date: Column) -> Column:
    """``type:url:date`` with missing parts empty (concat_ws would drop them)."""
    empty = F.lit("")
    return F.concat(
        type_, F.lit(":"), F.coalesce(url, empty), F.lit(":"), F.coalesce(event_date, empty)
    )


def record_key(owner: Column, title: Column) -> Column:
    """Deterministic id of a record: no sequence, so no global order is needed."""
    return F.sha2(F.concat(owner, F.lit("\u0001"), title), 256)


def format_status(c: Column | str) -> Column:
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def format_event_type(c: Column | str) -> Column:
    out = _col(c)
    for value, label in EVENT_LABELS.items():
        out = F.when(_col(c) == value, F.lit(label)).otherwise(out)
    return out


def _shown_time(x: str) -> str:
    at = f"try_cast({x} AS timestamp_ntz)"
    return (
        f"concat(date_format({at}, 'MMMM d, yyyy \\'at\\' h:mm '), "
        f"CASE WHEN hour({at}) < 12 THEN 'a.m.' ELSE 'p.m.' END)"
    )


def _shown_date(x: str) -> str:
    day = f"date_format(try_cast({x} AS timestamp_ntz), 'MMMM d, yyyy')"
    return f"coalesce(CASE WHEN contains({x}, 'T') THEN {_shown_time(x)} ELSE {day} END, {x})"


def _shown_with(x: str, clock: str) -> str:
    """Date and time, the time being ``clock`` if ``x`` has none."""
    full = f"CASE WHEN contains({x}, 'T') THEN {x} ELSE concat({x}, 'T{clock}') END"
    return f"coalesce({let_sql(full, 'f', _shown_time('f'))}, {x})"


def format_date_range(start: Column | str, end: Column | str) -> Column:
    """Display text of an event's dates.

    Neither: ``Date TBD``. One: that one, with its time if it has one. Both: two
    date-times joined by an en dash, a missing start time being 00:00 and a
    missing end time 23:59. Text that is no date is shown as it is.
    """
    return let(
        F.struct(blank_to_null(start).alias("s"), blank_to_null(end).alias("e")),
        "CASE WHEN it.s IS NULL AND it.e IS NULL THEN 'Date TBD' "
        f"WHEN it.e IS NULL THEN {_shown_date('it.s')} WHEN it.s IS NULL THEN {_shown_date('it.e')} "
        f"ELSE concat({_shown_with('it.s', '00:00')}, ' – ', {_shown_with('it.e', '23:59')}) END",
    )


def document_label(title: Column, url: Column, label: Column) -> Column:
    """``[title](url)`` and, when there is a date label, `` — label``."""
    link = F.concat(F.lit("["), title, F.lit("]("), url, F.lit(")"))
    shown = blank_to_null(label)
    return F.when(shown.isNotNull(), F.concat(link, F.lit(" — "), shown)).otherwise(link)


def join_areas(c: Column | str) -> Column:
    return F.array_join(_col(c), ", ")


def is_upcoming(event_date: Column, end_date: Column, status: Column, as_of: Column) -> Column:
    """Whether an event still lies ahead of the day ``as_of`` (ISO text).

    Dates compare as text, so ``2026-01-05T10:00`` is not before ``2026-01-05``.
    """
    end, start = blank_to_null(end_date), blank_to_null(event_date)
    return (
        F.when(status == "completed", F.lit(False))
        .when(end.isNotNull(), end >= as_of)
        .when(start.isNotNull(), start >= as_of)
        .otherwise(F.lit(True))
    )


def as_of_text(as_of: str | None = None) -> Column:
    """The day of the run as ISO text; today in UTC if not given."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.lit(as_of) if as_of else F.date_format(utc, "yyyy-MM-dd")
