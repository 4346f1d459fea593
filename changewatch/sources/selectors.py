"""Selector tier: pick elements out of pages whose blocks may nest.

One Arrow function call per page answers ALL rules of a source. It only finds
elements and hands back their text, inner HTML and attributes; everything after
that (clean-up, URLs, de-duplication, hashing) is native Column work.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import escape, unescape
from itertools import islice
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<rule:string,idx:int,values:map<string,string>>>"
_ARROW_MATCHES = pa.list_(
    pa.struct(
        [("rule", pa.string()), ("idx", pa.int32()), ("values", pa.map_(pa.string(), pa.string()))]
    )
)


@dataclass(frozen=True)
class Rule:
    """Which elements to pick, and what to read from each.

    ``item``: descendant selector of tags, ``.class`` and ``#id``; ``within``: look
    only inside its first match, or inside ``otherwise`` if there is none.
    ``fields``: name -> (path, what). A path is a tuple of ``selector@n`` steps from
    the item, ``what`` one of ``text``, ``html``, ``count`` or ``attr:<name>``.
    """

    name: str
    item: str
    fields: dict[str, tuple[tuple[str, ...], str]]
    within: str | None = None
    otherwise: str | None = None
    first: bool = False


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset(("script", "style"))
_TEXT_ONLY = frozenset(("title", "textarea"))
_TABLE = ("table", "thead", "tbody", "tfoot")
# start tag -> open elements it ends, unless one of the fences lies between
_ENDS = {
    "li": (("li",), ("ul", "ol")),
    "tr": (("tr",), _TABLE),
    "td": (("td", "th"), ("tr", *_TABLE)),
    "th": (("td", "th"), ("tr", *_TABLE)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
    "a": (("a",), ()),
}
_BLOCKS = (
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr"
    " main nav ol p pre section table ul"
)
_ENDS.update({tag: (("p",), ("td", "th", "li", "table", "button")) for tag in _BLOCKS.split()})


# possessive: a tag that never ends must not cost more than one pass
_TOKEN = re.compile(
    r"<!--(.*?)(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?>[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)?+)*+)>|<[!?][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


class _Node:
    """An element: its place in the flat list of events, and its parent."""

    __slots__ = ("tag", "raw", "parent", "order", "last", "start", "end", "_attrs")

    def __init__(self, tag, raw, parent, order, start):
        self.tag, self.raw, self.parent = tag, raw, parent
        self.order, self.start = order, start
        self.last = self.end = self._attrs = None

    @property
    def attrs(self):
        if self._attrs is None:
            self._attrs = {}
            for name, value in _ATTRIBUTE.findall(self.raw):
                if value[:1] in ("'", '"'):
                    value = value[1:-1]
                self._attrs.setdefault(name.lower(), unescape(value) if "&" in value else value)
        return self._attrs

    def classes(self):
        return (self.attrs.get("class") or "").split() if "class" in self.raw.lower() else ()


def _escape(text, attribute=False):
    out = escape(text, quote=False).replace("\u00a0", "&nbsp;")
    return out.replace('"', "&quot;") if attribute else out


class _Page:
    """A page as one list of events; elements are ranges of it, indexed by name.

    Events: text (str), start tag (_Node), or (mark, text) for an end tag,
    a comment or raw script text.
    """

    def __init__(self, html):
        self.events, self.count, self.open = [], 0, Counter()
        self.by_tag, self.by_class, self.by_id = {}, {}, {}
        self.root = self.at = _Node("", "", None, -1, 0)
        self._read(html)
        self._close_to(self.root)
        self.root.last, self.root.end = self.count, len(self.events)

    def _read(self, html):
        pos = 0
        # no tag starts beyond the last ">": tags that never end are not searched
        last = html.rfind(">") + 1
        while True:
            token = _TOKEN.search(html, pos, last)
            if token is None:
                break
            if token.start() > pos:
                self._text(html[pos : token.start()])
            pos = token.end()
            comment, slash, tag, raw = token.groups()
            if tag is None:
                if comment is not None:
                    self.events.append(("!", comment))
                continue
            tag = tag.lower()
            if slash:
                self._end((tag,), ())
                continue
            self._start(tag, raw)
            if tag in _RAW or tag in _TEXT_ONLY:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, pos)
                stop = close.start() if close else len(html)
                if stop > pos:
                    if tag in _RAW:
                        self.events.append(("r", html[pos:stop]))
                    else:
                        self._text(html[pos:stop])
                pos = stop
        if pos < len(html):
            self._text(html[pos:])

    def _text(self, text):
        self.events.append(unescape(text) if "&" in text else text)

    def _start(self, tag, raw):
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        if tag == "tr" and self.at.tag == "table":
            self._open("tbody", "")
        self._open(tag, raw)
        if tag in _VOID:
            self._close_to(self.at.parent)

    def _open(self, tag, raw):
        node = _Node(tag, raw, self.at, self.count, len(self.events) + 1)
        self.count += 1
        self.open[tag] += 1
        self.events.append(node)
        self.by_tag.setdefault(tag, []).append(node)
        for name in node.classes():
            self.by_class.setdefault(name, []).append(node)
        if "id" in raw and "id" in node.attrs:
            self.by_id.setdefault(node.attrs["id"], []).append(node)
        self.at = node

    def _close_to(self, parent):
        while self.at is not parent:
            self.at.last, self.at.end = self.count, len(self.events)
            self.open[self.at.tag] -= 1
            if self.at.tag not in _VOID:
                self.events.append(("/", self.at.tag))
            self.at = self.at.parent

    def _end(self, tags, fences):
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node.parent is not None and node.tag not in fences:
            if node.tag in tags:
                self._close_to(node.parent)
                return
            node = node.parent

    def text(self, node):
        return "".join(
            e if isinstance(e, str) else e[1]
            for e in self.events[node.start : node.end]
            if isinstance(e, str) or (isinstance(e, tuple) and e[0] == "r")
        )

    def html(self, node):
        parts = []
        for e in self.events[node.start : node.end]:
            if isinstance(e, str):
                parts.append(_escape(e))
            elif isinstance(e, _Node):
                attrs = "".join(f' {k}="{_escape(v, True)}"' for k, v in e.attrs.items())
                parts.append(f"<{e.tag}{attrs}>")
            else:
                mark, text = e
                parts.append(text if mark == "r" else f"<!--{text}-->" if mark == "!" else f"</{text}>")
        return "".join(parts)

    def find(self, root, selector):
        """Descendants of ``root`` matching the last step below the earlier ones."""
        *above, (tag, classes, ids) = _compile(selector)
        if classes:
            nodes = self.by_class.get(classes[0], ())
        elif ids:
            nodes = self.by_id.get(ids[0], ())
        else:
            nodes = self.by_tag.get(tag, ())
        at = bisect_right(nodes, root.order, key=_order)
        while at < len(nodes) and nodes[at].order < root.last:
            node = nodes[at]
            at += 1
            if not _fits(node, tag, classes, ids):
                continue
            left, up = len(above) - 1, node.parent
            while left >= 0 and up is not None:
                if _fits(up, *above[left]):
                    left -= 1
                up = up.parent
            if left < 0:
                yield node

    def nth(self, root, selector):
        name, _, n = selector.partition("@")
        return next(islice(self.find(root, name), int(n or 0), None), None)

    def read(self, node, path, what):
        if what == "count":
            return str(sum(1 for _ in self.find(node, path[0])))
        for selector in path:
            node = self.nth(node, selector)
            if node is None:
                return None
        if what == "text":
            return self.text(node)
        if what == "html":
            return self.html(node)
        return node.attrs.get(what.removeprefix("attr:"))


_order = attrgetter("order")


@lru_cache(maxsize=None)
def _compile(selector):
    """Steps of a descendant selector: (tag, classes, ids) each."""
    return tuple(
        (
            re.match(r"[a-z0-9]*", part).group(),
            tuple(re.findall(r"\.([\w-]+)", part)),
            tuple(re.findall(r"#([\w-]+)", part)),
        )
        for part in selector.split()
    )


def _fits(node, tag, classes, ids):
    if tag and node.tag != tag:
        return False
    if classes:
        own = node.classes()
        if not all(c in own for c in classes):
            return False
    return all(node.attrs.get("id") == i for i in ids)


def pick(html: str | None, rules: tuple[Rule, ...]) -> list[dict] | None:
    """All matches of all rules in one page."""
    if html is None:
        return None
    page = _Page(html)
    body = page.nth(page.root, "body") or page.root
    out = []
    for rule in rules:
        root = page.root
        if rule.within:
            root = page.nth(page.root, rule.within)
            if root is None and rule.otherwise:
                root = body if rule.otherwise == "body" else page.nth(page.root, rule.otherwise)
            if root is None:
                continue
        found = [root] if rule.item == ":root" else page.find(root, rule.item)
        for idx, node in enumerate(found):
            values = {k: page.read(node, path, what) for k, (path, what) in rule.fields.items()}
            out.append({"rule": rule.name, "idx": idx, "values": values})
            if rule.first:
                break
    return out


def select_all(html: Column | str, rules: tuple[Rule, ...]) -> Column:
    """Column of type ``MATCHES``: every match of every rule, in page order."""
    return select_by(F.lit(""), html, {"": rules})


def select_by(key: Column | str, html: Column | str, rules: dict[str, tuple[Rule, ...]]) -> Column:
    """As :func:`select_all`, with the rules named by ``key``; NULL if it names none.

    Pages of all sources are so parsed in one pass. A page on which matching fails
    gives NULL too: its record is then quarantined.
    """

    def one(name: str, page: str | None) -> list[dict] | None:
        try:
            return pick(page, rules[name]) if name in rules else None
        except Exception:  # noqa: BLE001 - one unreadable page must not end the run
            return None

    @F.arrow_udf(MATCHES)
    def matches(keys: pa.Array, pages: pa.Array) -> pa.Array:
        found = (one(key.as_py(), page.as_py()) for key, page in zip(keys, pages))
        return pa.array(
            (
                None if m is None else [{**x, "values": list(x["values"].items())} for x in m]
                for m in found
            ),
            type=_ARROW_MATCHES,
        )

    return matches(key, html)


def of_rule(matches: Column | str, name: str) -> Column:
    """The matches of one rule, in page order."""
    col = F.col(matches) if isinstance(matches, str) else matches
    return F.filter(col, lambda m: m["rule"] == name)


def first_value(matches: Column | str, rule: str, field: str) -> Column:
    """Field of a rule's first match; NULL if nothing matched."""
    return F.get(of_rule(matches, rule), F.lit(0))["values"][field]
