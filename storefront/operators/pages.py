"""Row-local extraction over a table of captured pages: no shuffle, no join.

Input columns are ``page_id``, ``url`` and ``html`` unless stated. These run
unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storefront.functions.binding import let
from storefront.functions.emails import first_email, html_emails
from storefront.functions.markup import anchor_hrefs, visible_text
from storefront.functions.urls import is_listed, url_host
from storefront.params import FALSE_EMAIL_PARTS, FALSE_EMAIL_SUFFIXES, NETWORKS

Networks = Sequence[tuple[str, Sequence[str]]]


def page_text(pages: DataFrame, sep: str = "") -> DataFrame:
    """``(page_id, text)``: the visible text."""
    return pages.select("page_id", visible_text(F.col("html"), sep).alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, href)``: the anchors in document order."""
    return pages.select("page_id", F.posexplode(anchor_hrefs(F.col("html"))).alias("pos", "href"))


def page_emails(
    pages: DataFrame,
    suffixes: Sequence[str] = FALSE_EMAIL_SUFFIXES,
    parts: Sequence[str] = FALSE_EMAIL_PARTS,
    sep: str = "",
) -> DataFrame:
    """``(page_id, pos, email)``: the addresses in found order."""
    found = html_emails(F.col("html"), suffixes, parts, sep)
    return pages.select("page_id", F.posexplode(found).alias("pos", "email"))


def page_first_email(
    pages: DataFrame,
    suffixes: Sequence[str] = FALSE_EMAIL_SUFFIXES,
    parts: Sequence[str] = FALSE_EMAIL_PARTS,
) -> DataFrame:
    """``(page_id, email)`` of every page; null where it has none."""
    found = html_emails(F.col("html"), suffixes, parts)
    return pages.select("page_id", first_email(found).alias("email"))


def _link_test(href: Column, domains: Sequence[str], match: str) -> Column:
    if match == "host":
        return is_listed(href, domains)
    if match != "substring":
        raise ValueError("match must be 'substring' or 'host'")
    test = F.lit(False)
    for domain in domains:
        test = test | F.lower(href).contains(domain.lower())
    return test


def social_links(
    hrefs: Column, networks: Networks = NETWORKS, match: str = "substring"
) -> Column:
    """``STRUCT`` with the first link of each network, null where there is none.

    A link belongs to the first network it matches, in the order given, and is
    stored as written. ``substring`` looks anywhere in the link, so
    ``netflix.com`` counts as ``x.com``; ``host`` compares host names.
    """

    def network_of(href: Column) -> Column:
        case = F.when(_link_test(href, networks[0][1], match), networks[0][0])
        for network, domains in networks[1:]:
            case = case.when(_link_test(href, domains, match), network)
        return F.struct(case.alias("network"), href.alias("href"))

    def first_of(links: Column, network: str) -> Column:
        return F.get(F.filter(links, lambda link: link["network"] == network), 0)["href"]

    return let(
        F.transform(hrefs, network_of),
        lambda links: F.struct(*(first_of(links, n).alias(n) for n, _ in networks)),
    )


def page_socials(
    pages: DataFrame, networks: Networks = NETWORKS, match: str = "substring"
) -> DataFrame:
    """``(page_id, one column per network)`` of every page; null where it has none."""
    links = social_links(anchor_hrefs(F.col("html")), networks, match)
    return pages.select("page_id", links.alias("_links")).select("page_id", "_links.*")


def extract_contacts(
    pages: DataFrame,
    networks: Networks = NETWORKS,
    match: str = "substring",
    suffixes: Sequence[str] = FALSE_EMAIL_SUFFIXES,
    parts: Sequence[str] = FALSE_EMAIL_PARTS,
    keep: Sequence[str] = ("page_id", "url"),
) -> DataFrame:
    """``(*keep, email, one column per network)``: a narrow row per page, the HTML left behind."""
    html, hrefs = F.col("html"), F.col("_hrefs")
    read = pages.select(*keep, "html", anchor_hrefs(html).alias("_hrefs"))
    return read.select(
        *keep,
        first_email(html_emails(html, suffixes, parts, hrefs=hrefs)).alias("email"),
        social_links(hrefs, networks, match).alias("_links"),
    ).select(*keep, "email", "_links.*")


def page_hosts(pages: DataFrame) -> DataFrame:
    """``(page_id, host)`` of every page."""
    return pages.select("page_id", url_host(F.col("url")).alias("host"))
