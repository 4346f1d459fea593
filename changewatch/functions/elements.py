"""Elements of HTML pages whose blocks may nest, as native Columns.

A page is cut at its tags once: ``tags`` and the ``texts`` between them. One aggregate over the tags keeps the stack of open
elements and yields, for each element, the tag that ends it and how many elements lie inside. Elements are numbered in
page order, so the descendants of one are a slice of the list, its text a slice of ``texts``, and its inner HTML a
slice of both. Selectors are filters over such slices. Nothing leaves the JVM.

End tags may be missing: list items, table rows and cells, options, anchors and paragraphs end where the next one or a new
block starts, and everything ends with the page. A stray end tag is ignored. A row directly in a table is taken into
a ``tbody``. Script, style, title and text areas are read whole, comments are skipped. Tags that never end are text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewatch.functions import text as T

MATCHES = "array<struct<rule:string,idx:int,values:map<string,string>>>"


@dataclass(frozen=True)
class Rule:
    """Which elements to pick, and what to read from each.

    ``item``: descendant selector of tags, ``.class`` and ``#id``, or ``:root``; ``within``: look
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


# --- fixed values: elements without end tags, and which open elements a start tag ends, unless a fence lies between ---
VOID = "area base br col embed hr img input link meta source track wbr".split()
WHOLE = "script style title textarea".split()
TABLE = ["table", "thead", "tbody", "tfoot"]
ENDS = [
    (["li"], ["li"], ["ul", "ol"]),
    (["tr"], ["tr"], TABLE),
    (["td", "th"], ["td", "th"], ["tr", *TABLE]),
    (["tbody", "thead", "tfoot"], ["tbody", "thead", "tfoot"], ["table"]),
    (["option"], ["option"], ["select"]),
    (["a"], ["a"], []),
    (
        "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(),
        ["p"], ["td", "th", "li", "table", "button"],
    ),
]
# --- end of fixed values ---

# Quantifiers are possessive or bounded, so that broken markup costs no more than one pass.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_TAG = (
    r"(?is)<!--.*?(?:--!?>|\z)|<(" + "|".join(WHOLE) + r")(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\z)"
    r"""|</?+[a-z](?:[^<>"']++|"[^"]{0,4000}+"|'[^']{0,4000}+'){0,200}+>|</?+[a-z][^<>]*+>|<[!?][^<>]*+>"""
)
_ROW_IN_TABLE = r"(?i)(<(?:table|/thead|/caption|/colgroup)(?=[\s/>])[^<>]*+>\s*+)(?=<tr[\s>])"
_SPAN = "array<struct<o:int,j:int,last:int>>"
_DEEPEST = 512  # nesting beyond it is taken as siblings, as browsers do
_CHUNK = 16  # an array grows by copying: tags are walked in chunks


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``value`` bound to ``name``, which is not copied."""
    return f"aggregate(cast(array() AS array<int>), {value}, (it, x) -> it, {name} -> {body})"


def _in(value: str, names: list[str]) -> str:
    return f"{value} IN ({', '.join(map(_quoted, names))})" if names else "false"


def _attribute(tag: str, name: str) -> str:
    """SQL text of an attribute's value in a start tag; NULL when it has none."""
    before = rf"(?is)^<[a-z][^\s/>]*+(?:[\s/]++[^\s/>=\"']++(?:\s*+=\s*+{_VALUE})?+){{0,100}}?[\s/]++{re.escape(name)}\s*+=\s*+({_VALUE})"
    found = f"regexp_extract({tag}, {_quoted(before)}, 1)"
    bare = "CASE WHEN v = '' THEN NULL WHEN left(v, 1) IN ('\"', '\\'') THEN substr(v, 2, length(v) - 2) ELSE v END"
    return _let(found, "v", bare)


def _walk() -> str:
    """SQL text of the aggregate: for each element o the tag j that ends it, and the number of the next one outside."""
    depth = "size(a.stack)"
    last = lambda names: f"coalesce(array_max(transform(a.stack, (e, x) -> if({_in('e.name', names)}, x + 1, 0))), 0)"
    implied = " ".join(
        f"WHEN t.ends = {at} AND exists(a.stack, e -> {_in('e.name', ends)}) THEN "
        + _let(last(ends), "x", f"if(x > {last(fences) if fences else '0'}, x, {depth} + 1)")
        for at, (_, ends, fences) in enumerate(ENDS, 1)
    )
    stray = _let(
        "array_position(reverse(transform(a.stack, e -> e.name)), t.name)", "x", f"if(x = 0, {depth} + 1, {depth} + 1 - cast(x AS int))"
    )
    # the first of the open elements that this tag ends
    cut = (
        f"CASE WHEN {depth} = 0 THEN 1 WHEN t.kind = 1 THEN {stray}"
        f" WHEN t.kind = 0 AND {depth} >= {_DEEPEST} THEN {depth} {implied} ELSE {depth} + 1 END"
    )
    opened = "array(named_struct('name', t.name, 'o', a.n))"
    whole = "array(named_struct('o', a.n, 'j', t.j, 'last', a.n + 1))"
    ended = f"transform(slice(a.stack, cut, {depth}), e -> named_struct('o', e.o, 'j', t.k, 'last', a.n))"
    left = "slice(a.stack, 1, cut - 1)"
    some = _let(
        cut, "cut",
        f"named_struct('stack', CASE WHEN t.kind = 0 THEN concat({left}, {opened}) ELSE {left} END,"
        f" 'n', CASE WHEN t.kind = 1 THEN a.n ELSE a.n + 1 END,"
        f" 'out', CASE WHEN t.kind = 2 THEN concat(a.out, {ended}, {whole}) ELSE concat(a.out, {ended}) END)",
    )
    ends = " ".join(f"WHEN {at} THEN exists(a.stack, e -> {_in('e.name', names)})" for at, (_, names, _) in enumerate(ENDS, 1))
    alone = f"{depth} < {_DEEPEST} AND (t.ends = 0 OR NOT CASE t.ends {ends} END)"
    # most tags end the innermost open element, hold no other one, or just open one
    step = (
        "CASE WHEN t.kind = 1 AND element_at(a.stack, -1).name = t.name THEN"
        f" named_struct('stack', slice(a.stack, 1, {depth} - 1), 'n', a.n,"
        " 'out', array_append(a.out, named_struct('o', element_at(a.stack, -1).o, 'j', t.k, 'last', a.n)))"
        f" WHEN t.kind = 2 AND {alone} THEN named_struct('stack', a.stack, 'n', a.n + 1, 'out', concat(a.out, {whole}))"
        f" WHEN t.kind = 0 AND {alone} THEN named_struct('stack', concat(a.stack, {opened}), 'n', a.n + 1, 'out', a.out)"
        f" ELSE {some} END"
    )
    none = f"cast(array() AS {_SPAN})"
    joined = "named_struct('stack', r.stack, 'n', r.n, 'outs', concat(s.outs, array(r.out)))"
    outer = f"aggregate(chunk, named_struct('stack', s.stack, 'n', s.n, 'out', {none}), (a, t) -> {step}, r -> {joined})"
    chunks = f"transform(sequence(0, greatest(size(_tokens) - 1, 0) div {_CHUNK}), c -> slice(_tokens, c * {_CHUNK} + 1, {_CHUNK}))"
    start = f"named_struct('stack', cast(array() AS array<struct<name:string,o:int>>), 'n', 0, 'outs', cast(array() AS array<{_SPAN}>))"
    at_end = "transform(s.stack, e -> named_struct('o', e.o, 'j', size(_tags), 'last', s.n))"
    return f"sort_array(aggregate({chunks}, {start}, (s, chunk) -> {outer}, s -> concat(flatten(s.outs), {at_end})))"


_ENDING = " ".join(f"WHEN {_in('name', starts)} THEN {at}" for at, (starts, _, _) in enumerate(ENDS, 1))

_INDEX = {
    "_page": f"regexp_replace(_html, {_quoted(_ROW_IN_TABLE)}, '$1<tbody>')",
    "_tags": f"regexp_extract_all(_page, {_quoted(_TAG)}, 0)",
    "_texts": f"split(_page, {_quoted(_TAG)}, -1)",
    # name of each tag; NULL for comments and the like
    "_names": r"transform(_tags, t -> nullif(lower(regexp_extract(t, '^</?([a-zA-Z][^\\s/>]*)', 1)), ''))",
    # kind 0 opens an element, 1 ends one, 2 is a whole one: without end tag or with nothing but text in it
    "_tokens": (
        "filter(transform(_tags, (t, k) -> "
        + _let(
            "get(_names, k)", "name",
            "CASE WHEN name IS NULL THEN NULL WHEN startswith(t, '</') THEN"
            " CASE WHEN k > 0 AND get(_names, k - 1) = name AND NOT startswith(get(_tags, k - 1), '</')"
            f" AND NOT {_in('name', VOID + WHOLE)} THEN NULL ELSE named_struct('name', name, 'k', k, 'j', k, 'kind', 1, 'ends', 0) END"
            f" WHEN {_in('name', VOID + WHOLE)} THEN named_struct('name', name, 'k', k, 'j', k, 'kind', 2, 'ends', CASE {_ENDING} ELSE 0 END)"
            " ELSE " + _let(
                "get(_names, k + 1) = name AND startswith(get(_tags, k + 1), '</')", "whole",
                f"named_struct('name', name, 'k', k, 'j', if(whole, k + 1, k), 'kind', if(whole, 2, 0), 'ends', CASE {_ENDING} ELSE 0 END)")
            + " END",
        )
        + "), t -> t IS NOT NULL)"
    ),
    "_spans": _walk(),
    # what a script or title holds counts as text before it
    "_words": (
        "zip_with(_texts, _tags, (x, t) -> CASE WHEN " + f"t RLIKE {_quoted('(?i)^<(?:' + '|'.join(WHOLE) + ')[ />]')}"
        + f" OR t RLIKE {_quoted('(?i)^<(?:' + '|'.join(WHOLE) + ')$')} THEN concat(x, regexp_replace(t, '^<[^>]*>|</[^<>]*>$', '')) ELSE x END)"
    ),
    "_nodes": (
        "zip_with(filter(_tokens, t -> t.kind <> 1), _spans, (t, s) -> "
        + _let(
            "element_at(_tags, t.k + 1)", "tag",
            "named_struct('i', t.k, 'j', s.j, 'o', s.o, 'last', s.last, 'name', t.name, 'tag', tag,"
            " 'classes', CASE WHEN contains(lower(tag), 'class') THEN concat(' ', regexp_replace("
            + _attribute("tag", "class") + r", '\\s+', ' '), ' ') END,"
            " 'id', CASE WHEN contains(lower(tag), 'id') THEN " + _attribute("tag", "id") + " END)",
        )
        + ")"
    ),
    "_root": (
        "named_struct('i', -1, 'j', size(_tags), 'o', -1, 'last', size(_nodes), 'name', '', 'tag', '',"
        " 'classes', cast(null AS string), 'id', cast(null AS string))"
    ),
}


def _fits(node: str, step: str) -> str:
    """SQL test of one selector step."""
    tests = [f"{node}.name = {_quoted(tag)}" for tag in re.findall(r"^[a-z][a-z0-9]*", step)]
    tests += [f"contains({node}.classes, {_quoted(f' {c} ')})" for c in re.findall(r"\.([\w-]+)", step)]
    tests += [f"{node}.id = {_quoted(i)}" for i in re.findall(r"#([\w-]+)", step)]
    return " AND ".join(tests)


def _find(scope: str, selector: str, tag: int = 0) -> str:
    """SQL text of the descendants of ``scope`` that match, in page order; ancestors may lie outside."""
    *above, step = selector.split()
    inside = f"slice(_nodes, {scope}.o + 2, {scope}.last - {scope}.o - 1)"
    if not above:
        return f"filter({inside}, x -> {_fits('x', step)})"
    outer = f"up{len(above)}"
    below = f"exists({outer}, u -> u.o < x.o AND x.o < u.last)"
    return _let(_find("_root", " ".join(above)), outer, f"filter({inside}, x -> {_fits('x', step)} AND {below})")


def _read(node: str, path: tuple[str, ...], what: str, depth: int = 0) -> str:
    if what == "count":
        return f"cast(size({_find(node, path[0])}) AS string)"
    if path:
        name, _, n = path[0].partition("@")
        return _let(f"get({_find(node, name)}, {int(n or 0)})", f"p{depth}", _read(f"p{depth}", path[1:], what, depth + 1))
    if what == "text":
        return f"array_join(slice(_words, {node}.i + 2, {node}.j - {node}.i), '')"
    if what == "html":
        between = f"greatest({node}.j - {node}.i - 1, 0)"
        joined = f"zip_with(slice(_texts, {node}.i + 2, {between}), slice(_tags, {node}.i + 2, {between}), (x, t) -> concat(x, t))"
        return f"CASE WHEN {node}.j > {node}.i THEN concat(array_join({joined}, ''), get(_texts, {node}.j)) WHEN {node}.j = {node}.i THEN '' END"
    return _attribute(f"{node}.tag", what.removeprefix("attr:"))


def _rule(rule: Rule) -> str:
    """SQL text of all matches of one rule."""
    scope = "_root"
    if rule.within:
        first = lambda selector: f"get({_find('_root', selector)}, 0)"
        spare = [first(rule.otherwise)] if rule.otherwise else []
        spare += ["_root"] if rule.otherwise == "body" else []
        scope = f"coalesce({', '.join([first(rule.within), *spare])})"
    items = "filter(array(scope), x -> x IS NOT NULL)" if rule.item == ":root" else _find("scope", rule.item)
    if rule.first:
        items = f"slice({items}, 1, 1)"
    values = ", ".join(f"{_quoted(name)}, {_read('m', *field)}" for name, field in rule.fields.items())
    found = f"transform({items}, (m, at) -> named_struct('rule', {_quoted(rule.name)}, 'idx', at, 'values', map({values})))"
    return f"coalesce({_let(scope, 'scope', found)}, cast(array() AS {MATCHES}))"


def _decoded(rules: list[Rule]) -> str:
    """SQL text that decodes all values but inner HTML."""
    html = {name for r in rules for name, (_, what) in r.fields.items() if what == "html"}
    other = {name for r in rules for name, (_, what) in r.fields.items() if what != "html"}
    if html & other:
        raise ValueError(f"fields read both as html and as text: {sorted(html & other)}")
    text = f"CASE WHEN {_in('k', sorted(html))} OR NOT contains(it, '&') THEN it ELSE {T.DECODED} END"
    return f"transform(_found, m -> named_struct('rule', m.rule, 'idx', m.idx, 'values', transform_values(m.values, (k, it) -> {text})))"


def with_matches(df: DataFrame, html: Column | str, rules: dict[str, tuple[Rule, ...]], key: Column | str | None = None) -> DataFrame:
    """``df`` with ``m``: all matches of the rules named by ``key``, in page order; NULL where ``html`` is, or no rules are named.

    Without ``key`` the rules named "" are taken. Pages of all sources are so indexed in one pass.
    """
    columns = df.columns
    df = df.withColumns({
        "_key": F.lit("") if key is None else F.col(key) if isinstance(key, str) else key,
        "_html": F.col(html) if isinstance(html, str) else html,
    })
    all_of = {k: "concat(" + ", ".join(map(_rule, r)) + ")" if r else f"cast(array() AS {MATCHES})" for k, r in rules.items()}
    cases = " ".join(f"WHEN {_quoted(k)} THEN {sql}" for k, sql in all_of.items())
    sql = _decoded([x for r in rules.values() for x in r])
    for name, value in reversed([*_INDEX.items(), ("_found", f"CASE _key {cases} END")]):
        sql = _let(value, name, sql)
    sql = f"CASE WHEN _html IS NOT NULL AND {_in('_key', list(rules))} THEN {sql} END"
    # exploded, so that no later projection merges with it and computes it again at each use
    return df.select(*columns, F.explode(F.array(F.expr(sql))).alias("m"))


def of_rule(matches: Column | str, name: str) -> Column:
    """The matches of one rule, in page order."""
    col = F.col(matches) if isinstance(matches, str) else matches
    return F.filter(col, lambda m: m["rule"] == name)


def first_value(matches: Column | str, rule: str, field: str) -> Column:
    """Field of a rule's first match; NULL if nothing matched."""
    return F.get(of_rule(matches, rule), F.lit(0))["values"][field]
