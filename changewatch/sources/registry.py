"""The tracked sources: one declarative specification each, and their dimension table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from changewatch.functions.elements import Rule


@dataclass(frozen=True)
class SourceSpec:
    """How one source lists its records and lays out their detail pages.

    Detail rules are named ``block`` (text, html), ``link`` (title, href, date),
    ``heading`` and ``main`` (text); further rules may feed the content hash.
    """

    name: str
    owner: str
    base_url: str
    layout: str  # table, cards, tiles or feed
    infer_status: bool
    listing: tuple[Rule, ...] = ()
    detail: tuple[Rule, ...] = ()
    area: str | None = None
    path_prefix: str | None = None
    link_pattern: str | None = None
    plain_titles: bool = False  # trim titles only, keep inner white space
    repeat_links: bool = False  # keep repeated and empty-href document links
    heading_first: bool = False  # fallback text starts with the page heading
    hash_rules: tuple[str, ...] = ("block",)
    hash_links: bool = False


_TEXT = ((), "text")
_HTML = ((), "html")
_ANCHOR = {"title": _TEXT, "href": ((), "attr:href")}


def _body(within: str, otherwise: str = "body") -> Rule:
    return Rule("main", ":root", {"text": _TEXT}, within=within, otherwise=otherwise, first=True)


def _blocks(item: str, **scope: str) -> Rule:
    return Rule("block", item, {"text": _TEXT, "html": _HTML}, **scope)


_HEADING = Rule("heading", "h1", {"text": _TEXT}, first=True)

# --- fixed values: sources, selectors and URLs ------------------------------------
HALTON_REGION = SourceSpec(
    name="halton_region",
    owner="Halton Region",
    base_url="https://www.halton.ca",
    layout="table",
    infer_status=False,
    plain_titles=True,
    repeat_links=True,
    listing=(
        Rule(
            "row",
            ".hal-generic-smart-search-results-table tbody tr",
            {
                "cells": (("td",), "count"),
                "anchor": (("td@0", "a"), "text"),
                "cell": (("td@0",), "text"),
                "href": (("td@0", "a"), "attr:href"),
                "area": (("td@1",), "text"),
                "state": (("td@2",), "text"),
            },
        ),
    ),
    detail=(
        _blocks(".ck-text", within="div.hal-ea-studies-detail-bottom"),
        _body("main#hal-main-content"),
        Rule(
            "link",
            ".hal-ea-studies-listing-row",
            {
                "title": (("a",), "text"),
                "href": (("a",), "attr:href"),
                "date": ((".hal-ea-studies-listing-item-report-date",), "text"),
            },
        ),
        Rule("section", ".hal-ea-studies-detail", {"html": _HTML}, first=True),
        Rule("resources", ".resource-listing-eastudies", {"html": _HTML}, first=True),
    ),
    hash_rules=("section", "resources"),
)

OAKVILLE = SourceSpec(
    name="oakville",
    owner="Town of Oakville",
    base_url="https://www.oakville.ca",
    layout="cards",
    infer_status=True,
    area="Oakville",
    listing=(
        Rule(
            "row",
            ".widget-page-cards a.card",
            {"href": ((), "attr:href"), "title": ((".card-title",), "text")},
        ),
    ),
    detail=(
        _blocks(".widget-text"),
        _body("main"),
        Rule("link", ".widget-link-listing li a", _ANCHOR),
        Rule("widget", ".widget-link-listing", {"html": _HTML}),
    ),
    hash_rules=("block", "widget"),
)

BURLINGTON = SourceSpec(
    name="burlington",
    owner="City of Burlington",
    base_url="https://www.getinvolvedburlington.ca",
    layout="tiles",
    infer_status=True,
    area="Burlington",
    heading_first=True,
    hash_links=True,
    listing=(
        Rule(
            "row",
            ".project-tile",
            {
                "href": (("a.project-tile__link",), "attr:href"),
                "title": ((".project-tile__meta__name",), "text"),
                "state": ((), "attr:data-state"),
            },
        ),
    ),
    detail=(
        _blocks(".shared-content-block"),
        _HEADING,
        _body("main"),
        Rule("link", "a.document-library-widget-link", _ANCHOR),
    ),
)

BURLINGTON_NEWS = SourceSpec(
    name="burlington_news",
    owner="City of Burlington",
    base_url="https://www.burlington.ca",
    layout="feed",
    infer_status=True,
    area="Burlington",
    heading_first=True,
    hash_links=True,
    path_prefix="/en/news/current-city-projects-and-construction/",
    link_pattern=r"(?i)/news/resources/.+\.(?:pdf|docx?|xlsx?)(?:[?#].*)?$",
    detail=(
        _blocks(".ge-content", within="#mainContent", otherwise="body"),
        _HEADING,
        _body("#mainContent"),
        Rule("link", "a", _ANCHOR, within="#mainContent", otherwise="body"),
    ),
)

ACTIVE = (HALTON_REGION, OAKVILLE, BURLINGTON, BURLINGTON_NEWS)

# owner, listing page, kind of source
OWNERS = (
    (
        "Halton Region",
        "https://www.halton.ca/for-residents/infrastructure-and-growth/"
        "municipal-class-environmental-assessment-studies",
        "halton_region",
    ),
    ("City of Burlington", "https://www.burlington.ca/Modules/News/en/Environmental", "burlington"),
    (
        "Town of Oakville",
        "https://www.oakville.ca/transportation-roads/transportation-roads-studies-and-plans/"
        "environmental-assessment-studies/",
        "oakville",
    ),
    (
        "Town of Milton",
        "https://www.milton.ca/en/business-and-development/town-projects.aspx",
        "milton",
    ),
    (
        "Town of Halton Hills",
        "https://www.haltonhills.ca/en/residents/environmental-assessment-ea-studies.aspx",
        "halton_hills",
    ),
)
# --- end of fixed values ------------------------------------------------------------


def owners(spark: SparkSession) -> DataFrame:
    """The owner dimension: five rows known to the code."""
    return spark.createDataFrame(
        [(i, *row, True) for i, row in enumerate(OWNERS, 1)],
        "owner_id int, name string, listing_url string, adapter_type string, active boolean",
    )
