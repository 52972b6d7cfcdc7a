"""URL parts by regular expression.

``parse_url`` raises on, and ``try_parse_url`` drops, many URLs a browser
accepts (``_`` in a host, ``|`` in a query), so the parts are matched here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from storefront.functions.binding import let
from storefront.params import CONTACT_PATHS

# 1 scheme, 2 user info with its @, 3 host, 4 port, 5 the rest
_URL = (
    r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
    r"(?:(?<=^(?i:https|http|ftp|wss|ws):)[/\\]*|//)"
    r"([^/\\?#@]*@)?"
    r"(\[[0-9a-fA-F:.]+\]|[^\x00-\x20/\\?#:@<>\[\]^|%]+)"
    r"(?::([0-9]*))?"
    r"((?:[/\\?#][\s\S]*)?)$"
)
_DEFAULT_PORTS = ("http:80", "https:443", "ftp:21", "ws:80", "wss:443")
_DOT = r"(?:\.|%2[eE])"
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
_OUTER = "".join(map(chr, range(1, 33)))


def _tidy(url: Column) -> Column:
    """What a URL parser drops first: outer controls and spaces, tabs and line ends."""
    return F.translate(F.btrim(url, F.lit(_OUTER)), "\t\n\r", "")


def _parts(url: Column) -> Column:
    """The five groups of ``_URL``, or an array of one if the text is no URL."""
    return F.split(F.regexp_replace(_tidy(url), _URL, "$1\n$2\n$3\n$4\n$5"), "\n")


def _is_url(parts: Column) -> Column:
    return F.size(parts) == 5


def _origin(parts: Column) -> Column:
    scheme, port = F.lower(parts[0]), parts[3]
    is_default = (port == "") | F.concat(scheme, F.lit(":"), port).isin(*_DEFAULT_PORTS)
    shown = F.when(is_default, "").otherwise(F.concat(F.lit(":"), port))
    return F.concat(scheme, F.lit("://"), parts[1], F.lower(parts[2]), shown)


def _resolved(path: Column) -> Column:
    """A path from ``/`` on with its dot segments taken out, as a browser does."""
    segments = F.split(F.substr(path, F.lit(2)), "/")
    up = lambda s: s.rlike(rf"^{_DOT}{_DOT}$")
    here = lambda s: s.rlike(rf"^{_DOT}$")

    def step(kept: Column, segment: Column) -> Column:
        back = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(up(segment), back).when(here(segment), kept).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    last = F.element_at(segments, -1)
    return let(
        kept,
        lambda k: F.concat(
            F.lit("/"), F.array_join(k, "/"), F.when((up(last) | here(last)) & (F.size(k) > 0), "/").otherwise("")
        ),
    )


def _href(parts: Column) -> Column:
    slash = F.when(parts[4].rlike(r"^[/\\]"), "").otherwise("/")
    rest = F.replace(F.concat(slash, parts[4]), F.lit(" "), F.lit("%20"))
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    dotted = F.concat(_resolved(path), F.substr(rest, F.length(path) + 1))
    return F.concat(_origin(parts), F.when(path.rlike(rf"/{_DOT}{{1,2}}(/|$)"), dotted).otherwise(rest))


def _key(parts: Column) -> Column:
    return F.regexp_replace(_href(parts), r"#[\s\S]*$", "")


def url_host(url: Column) -> Column:
    """Lower-case host less one leading ``www.``; blank if there is no host."""
    return F.regexp_replace(F.lower(F.regexp_extract(_tidy(url), _URL, 3)), r"^www\.", "")


def url_origin(url: Column) -> Column:
    """``scheme://host[:port]`` in normal form; null if the text is no URL."""
    return let(_parts(url), lambda p: F.when(_is_url(p), _origin(p)))


def url_href(url: Column) -> Column:
    """An absolute URL in normal form; a text that is none stays as it is."""
    return let(_parts(url), lambda p: F.when(_is_url(p), _href(p)).otherwise(url))


def url_key(url: Column) -> Column:
    """What one page capture is known by: normal form, no fragment; null if not a URL."""
    return let(_parts(url), lambda p: F.when(_is_url(p), _key(p)))


def has_scheme(href: Column) -> Column:
    return href.rlike(_SCHEME)


def url_join(base: Column, href: Column) -> Column:
    """An href made absolute against the URL of its page.

    Dot segments are taken out and blanks escaped, so it meets the URL under which
    the page was captured. Without a usable base the href stays as it is.
    """
    against = let(
        _parts(base),
        lambda p: F.when(
            _is_url(p),
            F.struct(F.lower(p[0]).alias("scheme"), _origin(p).alias("origin"), _key(p).alias("page")),
        ),
    )

    def resolve(b: Column) -> Column:
        path = F.regexp_extract(b["page"], r"^[^?]*", 0)
        return (
            F.when(has_scheme(href), href)
            .when(href.startswith("//"), F.concat(b["scheme"], F.lit(":"), href))
            .when(href.startswith("/"), F.concat(b["origin"], href))
            .when(href.startswith("?"), F.concat(path, href))
            .when(href.startswith("#") | (href == ""), F.concat(b["page"], href))
            .otherwise(F.concat(F.regexp_extract(path, r"^.*/", 0), href))
        )

    return url_href(F.coalesce(let(against, resolve), href))


def contact_urls(url: Column, paths: Sequence[str] = CONTACT_PATHS) -> Column:
    """``ARRAY<STRUCT<pri, path, url>>`` of a site's contact pages; null if the URL is none.

    The paths are absolute, so the path and query of the site's own URL fall away.
    """

    def pages(origin: Column) -> Column:
        rows = (
            F.struct(
                F.lit(pri).alias("pri"),
                F.lit(path).alias("path"),
                F.concat(origin, F.lit(path)).alias("url"),
            )
            for pri, path in enumerate(paths, start=1)
        )
        return F.when(origin.isNotNull(), F.array(*rows))

    return let(url_origin(url), pages)


def is_listed(url: Column, domains: Sequence[str]) -> Column:
    """The host is one of the domains or lies under one.

    A host lies under a domain of *d* labels when its own last *d* labels are
    that domain, so the test is one hash look-up per label count: no join and
    no row explosion, whatever the length of the list.
    """
    by_labels: dict[int, list[str]] = {}
    for domain in domains:
        by_labels.setdefault(domain.count(".") + 1, []).append(domain.lower())
    host = url_host(F.coalesce(url, F.lit("")))
    listed = F.lit(False)
    for labels, same_length in sorted(by_labels.items()):
        listed = listed | F.substring_index(host, ".", -labels).isin(*same_length)
    return listed


def host_suffixes(host: Column) -> Column:
    """A host and every domain it lies under, for an equi-join to a domain table."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda start: F.array_join(F.slice(labels, start, F.size(labels)), "."),
    )
