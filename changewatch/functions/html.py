"""Native HTML extraction for flat shapes: regular expressions inside Catalyst.

Good for elements that do not nest in themselves (a, td, tr, li, p, h1). For
blocks that may nest (div, section) use ``changewatch.functions.elements``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from changewatch.functions.text import _col, collapse_ws, decode_entities


def elements(html: Column | str, tag: str, cls: str | None = None) -> Column:
    """Whole elements ``<tag ...>...</tag>`` in order, as an array of text."""
    attrs = r"(?:\s[^>]*)?"
    if cls:
        # Java possessive/look-around free, so that RE2 engines agree
        attrs = rf"""\s(?:[^>]*\s)?class=["'](?:[^"'>]*\s)?{re.escape(cls)}(?:\s[^"'>]*)?["'][^>]*"""
    return F.regexp_extract_all(_col(html), F.lit(rf"(?is)<{tag}{attrs}>.*?</{tag}>"), F.lit(0))


def inner_html(element: Column | str) -> Column:
    """Content of one element returned by :func:`elements`."""
    return F.regexp_replace(F.regexp_replace(_col(element), r"^<[^>]*>", ""), r"</[^<>]*>$", "")


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(_col(html), r"(?s)<!--.*?-->|<[^>]*>", "")


def text_of(html: Column | str) -> Column:
    """Text content of a fragment, entities decoded."""
    return decode_entities(strip_tags(html))


def clean_text(html: Column | str) -> Column:
    return collapse_ws(text_of(html))


def attribute(element: Column | str, name: str) -> Column:
    """Attribute of an element's start tag; NULL when absent."""
    start = F.regexp_extract(_col(element), r"^(<[^>]*>)", 1)
    quoted = rf"""(?i)\s{re.escape(name)}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    present = F.regexp_like(start, F.lit(quoted))
    value = F.concat(F.regexp_extract(start, quoted, 1), F.regexp_extract(start, quoted, 2))
    return F.when(present, decode_entities(value))


def first_element(html: Column | str, tag: str) -> Column:
    """First ``<tag>`` element, NULL if there is none."""
    found = F.regexp_extract(_col(html), rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", 0)
    return F.nullif(found, F.lit(""))


def slice_elements(html: Column | str, tag: str, cls: str) -> Column:
    """Cut the page at each start tag of class ``cls``: one slice per element.

    A slice runs to the next such start tag, so elements nested inside the item
    need no balancing. Fits repeated siblings such as listing tiles.
    """
    start = rf"""(?is)(?=<{tag}\s(?:[^>]*\s)?class=["'](?:[^"'>]*\s)?{re.escape(cls)}(?:\s[^"'>]*)?["'])"""
    parts = F.split(_col(html), start, -1)
    return F.when(
        F.size(parts) > 1, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    ).otherwise(F.array().cast("array<string>"))
