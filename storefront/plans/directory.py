"""The whole job: captured listings and pages in, directory rows out.

One city after the other or many at a time is the same Spark job; how much runs
at once is the cluster's business.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.functions.markup import title_text
from storefront.functions.text import utrim
from storefront.functions.urls import url_host, url_href
from storefront.materialize import materialize
from storefront.operators.pages import Networks, extract_contacts
from storefront.operators.rows import dedup, limit_page_quota, limit_rows
from storefront.operators.rules import LISTING_RULES, Rule, listing_fields
from storefront.operators.sites import (
    blank_listed,
    look_up_contacts,
    site_contacts,
    without_contacts,
)
from storefront.params import (
    BUSINESS_FIELDS,
    CONTACT_PATHS,
    DEFAULT_LIMIT,
    FALSE_EMAIL_PARTS,
    FALSE_EMAIL_SUFFIXES,
    LISTED_DOMAINS,
    NETWORKS,
    check_limit,
)
from storefront.sources.cities import city_queries, distinct_cities


def build_directory(
    listings: DataFrame,
    pages: DataFrame,
    limit: int = DEFAULT_LIMIT,
    with_contacts: bool = True,
    limit_mode: str = "page",
    rules: Sequence[Rule] = LISTING_RULES,
    domains: Sequence[str] = LISTED_DOMAINS,
    paths: Sequence[str] = CONTACT_PATHS,
    networks: Networks = NETWORKS,
    match: str = "substring",
    suffixes: Sequence[str] = FALSE_EMAIL_SUFFIXES,
    parts: Sequence[str] = FALSE_EMAIL_PARTS,
) -> DataFrame:
    """``(query_ord, page_no, idx, nine business fields)``, at most ``limit`` per query.

    ``listings`` holds ``query_ord, page_no, idx, url, card_html, panel_html``, and
    ``page_name, page_names`` if it knows its result pages (``listings_of``),
    ``pages`` holds ``page_id, url, html``. ``limit_mode`` is ``page`` (a card
    that fails is not replaced on its page) or ``rows`` (the first ``limit``
    cards with a name). Duplicates are dropped after the limit, before the
    contacts are looked up: the rows are the same and fewer travel.
    """
    keys = ["query_ord", "page_no", "idx"]
    order = ["page_no", "idx"]
    limit = check_limit(limit)
    found = listing_fields(listings, keys, rules)
    named = F.col("name") != ""
    if limit_mode == "page":
        taken = limit_page_quota(found, ["query_ord"], "page_no", "idx", limit, named)
    elif limit_mode == "rows":
        taken = limit_rows(found.where(named), ["query_ord"], order, limit)
    else:
        raise ValueError("limit_mode must be 'page' or 'rows'")
    kept = blank_listed(dedup(taken, ["query_ord"], order), "website", domains)
    if with_contacts:
        full = site_contacts(
            kept, pages, keys, "website", paths, networks, match, suffixes, parts
        )
    else:
        full = without_contacts(kept, networks)
    others = [c for c in full.columns if c not in keys and c not in BUSINESS_FIELDS]
    return full.select(
        *keys,
        *(
            F.coalesce(F.col(c), F.lit("")).alias(c) if c in full.columns else F.lit("").alias(c)
            for c in BUSINESS_FIELDS
        ),
        *others,
    )


def build_directory_batch(
    cities: DataFrame, template: str, listings: DataFrame, pages: DataFrame, **options
) -> DataFrame:
    """The directory of many cities: adds ``city_ord``, ``city`` and ``query``.

    ``cities`` is ``(ord, city)``; ``query_ord`` of the listings is the ``ord`` of
    their city. A repeated city is read once, under its first place.
    """
    queries = city_queries(distinct_cities(cities), template)
    rows = build_directory(listings, pages, **options)
    return queries.join(rows, F.col("city_ord") == F.col("query_ord")).drop("query_ord")


def directory_of_pages(
    pages: DataFrame,
    domains: Sequence[str] = LISTED_DOMAINS,
    paths: Sequence[str] = (),
    networks: Networks = NETWORKS,
    match: str = "substring",
    suffixes: Sequence[str] = FALSE_EMAIL_SUFFIXES,
    parts: Sequence[str] = FALSE_EMAIL_PARTS,
) -> DataFrame:
    """A directory made from the pages alone: ``(host, page_id, nine business fields)``.

    A page is a business of its host, named by its title, with its own URL as
    website; it needs no listing capture. Names and contacts come out of one
    pass over the pages, whose narrow result serves as rows and as look-up.
    """
    read = pages.where(F.col("html").isNotNull()).withColumn(
        "_name", utrim(title_text(F.col("html")))
    )
    found = materialize(
        extract_contacts(
            read, networks, match, suffixes, parts, keep=("page_id", "url", "_name")
        )
    )
    named = found.select(
        url_host(F.col("url")).alias("host"),
        "page_id",
        F.col("_name").alias("name"),
        url_href(F.col("url")).alias("website"),
        F.lit("").alias("phone"),
        F.lit("").alias("address"),
    )
    kept = blank_listed(dedup(named, ["host"], ["page_id"]), "website", domains)
    full = look_up_contacts(
        kept, found, ["page_id"], "website", paths, [n for n, _ in networks]
    )
    return full.select("host", "page_id", *BUSINESS_FIELDS)
