"""URL resolution as native Columns, for http and https bases.

Resolution follows the WHATWG rules that matter for scraped links: absolute,
protocol-relative, root-relative, query, fragment, bare-relative and dot-segment
forms; scheme and host in lower case; default ports dropped; an empty path becomes
``/``; characters a URL may not hold are percent-encoded.
"""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from changewatch.functions.text import _col, let, let_sql

# --- fixed values: characters to percent-encode, per part of a URL ---------------
_CONTROL = r"\x00-\x1F\x7F-\x{10FFFF}"
_IN_PATH = r" \x22<>`{}^" + _CONTROL
_IN_QUERY = r" \x22\x27<>" + _CONTROL
_IN_FRAGMENT = r" \x22<>`" + _CONTROL

# a URL that is its own normal form (dot segments are tested apart)
_PLAIN = (
    r"^https?://[a-z0-9][a-z0-9.\-]*/[A-Za-z0-9_~!$&()*+,;=:@%./\-]*"
    r"(?:[?#][A-Za-z0-9_~!$&()*+,;=:@%./?\-]*)?$"
)
# scheme, user, host, port, path, query, fragment
_PIECES = (
    r"^([A-Za-z]+):[/\\]*((?:[^/?#\\@]*@)?)([^/?#\\@:]*|\[[^/?#\\@]*\])((?::[0-9]*)?)"
    r"((?:[/\\][^?#]*)?)((?:\?[^#]*)?)((?:#(?s:.*))?)$"
)
_HOST = r"^(?:\[[0-9A-Fa-f:.]+\]|[^\[\]\s<>^|%]+)$"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*:)"


def _escape(part: str, bad: str) -> str:
    """Percent-encode the characters of class ``bad``; a clean part is untouched."""
    return (
        f"CASE WHEN {part} RLIKE r'[{bad}]' THEN array_join(transform("
        f"regexp_extract_all({part}, r'(?s).', 0), ch -> CASE WHEN ch RLIKE r'^[{bad}]$' "
        f"THEN replace(url_encode(ch), '+', '%20') ELSE ch END), '') ELSE {part} END"
    )


def _dot_segments(path: str) -> str:
    """Resolve ``.`` and ``..`` segments; a final one names a folder."""
    plain = (
        rf"regexp_replace(regexp_replace({path}, r'(?i)%2e', '.'), r'/(\.{{1,2}})$', '/$1/')"
    )
    kept = (
        f"aggregate(split({plain}, '/', -1), cast(array() AS array<string>), (acc, s) -> CASE "
        "WHEN s = '..' THEN CASE WHEN size(acc) > 1 THEN slice(acc, 1, size(acc) - 1) ELSE acc END "
        "WHEN s = '.' THEN acc ELSE concat(acc, array(s)) END)"
    )
    joined = let_sql(f"array_join({kept}, '/')", "j", "CASE WHEN j = '' THEN '/' ELSE j END")
    return rf"CASE WHEN {path} RLIKE r'(?i)/(\.|%2e)' THEN {joined} ELSE {path} END"


def _http(url: str) -> str:
    """SQL for the normal form of ``http(s)://...``; NULL when it is no URL."""
    path = let_sql(
        rf"CASE WHEN p[4] = '' THEN '/' ELSE replace(p[4], r'\', '/') END",
        "w",
        let_sql(_escape("w", _IN_PATH), "e", _dot_segments("e")),
    )
    joined = (
        f"CASE WHEN lower(p[2]) RLIKE r'{_HOST}' "
        "AND (p[3] IN ('', ':') OR try_cast(substr(p[3], 2) AS int) <= 65535) THEN concat("
        "lower(p[0]), '://', p[1], lower(p[2]), CASE WHEN p[3] IN ('', ':') "
        "OR p[3] = CASE WHEN lower(p[0]) = 'https' THEN ':443' ELSE ':80' END THEN '' ELSE p[3] END, "
        f"{path}, {_escape('p[5]', _IN_QUERY)}, {_escape('p[6]', _IN_FRAGMENT)}) END"
    )
    marks = r"\u0001".join(f"${i}" for i in range(1, 8))
    pieces = rf"split(regexp_replace({url}, r'{_PIECES}', '{marks}'), '\u0001', -1)"
    return (
        f"CASE WHEN {url} RLIKE r'{_PLAIN}' AND NOT contains({url}, '/.') THEN {url} "
        f"WHEN {url} RLIKE r'{_PIECES}' THEN {let_sql(pieces, 'p', joined)} END"
    )


def try_absolute_url(href: Column | str, base: str) -> Column:
    """``href`` resolved on ``base``; NULL when it cannot be resolved."""
    parts = urlsplit(base)
    origin = f"{parts.scheme}://{parts.netloc}"
    path = parts.path or "/"
    folder = path[: path.rfind("/") + 1]
    query = f"?{parts.query}" if parts.query else ""

    def text(value: str) -> str:
        return "r'" + value.replace("'", "%27") + "'"

    target = (
        "CASE WHEN link RLIKE r'(?i)^https?:' THEN link "
        rf"WHEN link RLIKE r'^[/\\]{{2}}' THEN concat({text(parts.scheme + ':')}, link) "
        rf"WHEN link RLIKE r'^[/\\]' THEN concat({text(origin)}, link) "
        f"WHEN link = '' THEN {text(origin + path + query)} "
        f"WHEN startswith(link, '?') THEN concat({text(origin + path)}, link) "
        f"WHEN startswith(link, '#') THEN concat({text(origin + path + query)}, link) "
        f"ELSE concat({text(origin + folder)}, link) END"
    )
    resolved = (
        f"CASE WHEN link RLIKE r'{_SCHEME}' AND NOT link RLIKE r'(?i)^https?:' THEN "
        f"concat(lower(regexp_extract(link, r'{_SCHEME}', 1)), regexp_replace(link, r'{_SCHEME}', '')) "
        f"ELSE {let_sql(target, 'u', _http('u'))} END"
    )
    raw = r"regexp_replace(it, r'^[\x00- ]+|[\x00- ]+$|[\t\n\r]', '')"
    # "https:path" without slashes is relative when the base has the same scheme
    link = rf"regexp_replace({raw}, r'(?i)^{parts.scheme}:(?![/\\])', '')"
    return let(_col(href), let_sql(link, "link", resolved))


def absolute_url(href: Column | str, base: str) -> Column:
    """``href`` resolved on ``base``; unchanged when it cannot be resolved."""
    return F.coalesce(try_absolute_url(href, base), _col(href))


def absolutise_hrefs(html: Column | str, base: str) -> Column:
    """Rewrite root- and protocol-relative ``href="..."`` in an HTML fragment.

    Protocol-relative links first, as a plain ``/`` pattern would match them too.
    ``href="/"`` alone stays: the pattern wants a character after the slash.
    """
    https = F.regexp_replace(_col(html), r'href="(//[^"]+)"', 'href="https:$1"')
    return F.regexp_replace(https, r'href="(/[^"]+)"', f'href="{base}$1"')


def url_path(url: Column | str) -> Column:
    """Path of an absolute http(s) URL; NULL for anything else."""
    path = "CASE WHEN n IS NOT NULL THEN regexp_extract(n, r'^[a-z]+://[^/]*(/[^?#]*)', 1) END"
    normal = f"CASE WHEN it RLIKE r'(?i)^https?://' THEN {_http('it')} END"
    return let(_col(url), let_sql(normal, "n", path))


def has_suffixed_url(url: Column | str) -> Column:
    """Whether the path (not query or fragment) ends in ``-(digits)``."""
    return F.coalesce(F.regexp_like(url_path(url), F.lit(r"-\([0-9]+\)$")), F.lit(False))


def path_starts_with(url: Column | str, prefix: str) -> Column:
    """Path-prefix test; false when the URL has no path to test."""
    return F.coalesce(F.startswith(url_path(url), F.lit(prefix)), F.lit(False))
