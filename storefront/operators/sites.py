"""Businesses and the captured pages of their sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storefront.functions.binding import let
from storefront.functions.urls import (
    contact_urls,
    host_suffixes,
    is_listed,
    url_host,
    url_key,
    url_origin,
)
from storefront.operators.joins import spread_join
from storefront.operators.pages import Networks, extract_contacts
from storefront.params import (
    CONTACT_PATHS,
    FALSE_EMAIL_PARTS,
    FALSE_EMAIL_SUFFIXES,
    LISTED_DOMAINS,
    NETWORKS,
    SOCIAL_FIELDS,
)


def blank_listed(
    rows: DataFrame, website: str = "website", domains: Sequence[str] = LISTED_DOMAINS
) -> DataFrame:
    """Blank the website of rows whose site is no business site; the rows stay."""
    site = F.col(website)
    return rows.withColumn(website, F.when(is_listed(site, domains), "").otherwise(site))


def flag_listed(rows: DataFrame, url: str, domains: DataFrame) -> DataFrame:
    """``rows`` with ``listed``, for a domain list kept as a table ``(domain)``.

    Works on distinct hosts, so a host's row count does not matter to the
    suffix join; whether a side is broadcast is left to its measured size.
    """
    hosted = rows.withColumn("_host", url_host(F.coalesce(F.col(url), F.lit(""))))
    suffixes = (
        hosted.select("_host")
        .where(F.col("_host") != "")
        .distinct()
        .select("_host", F.explode(host_suffixes(F.col("_host"))).alias("domain"))
    )
    hits = (
        suffixes.join(domains.select(F.lower("domain").alias("domain")), "domain", "left_semi")
        .select("_host")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    hashable = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    return (
        spread_join(hosted, hits, ["_host"], spread=hashable)
        .withColumn("listed", F.coalesce("_hit", F.lit(False)))
        .select(*rows.columns, "listed")
    )


def contact_url_rows(
    sites: DataFrame, website: str = "website", paths: Sequence[str] = CONTACT_PATHS
) -> DataFrame:
    """``sites`` times its contact pages: adds ``pri, path, contact_url``."""
    return sites.select(
        "*", F.inline(contact_urls(F.col(website), paths)).alias("pri", "path", "contact_url")
    )


def site_pages(
    sites: DataFrame,
    pages: DataFrame,
    website: str = "website",
    paths: Sequence[str] = CONTACT_PATHS,
) -> DataFrame:
    """``(website, pri, page_id)``: the captured pages of each distinct site.

    ``pri`` 0 is the home page, 1.. the contact pages in order. Only keys travel.
    """
    distinct = sites.where(F.col(website) != "").select(website).distinct()
    home = distinct.select(
        website, F.lit(0).alias("pri"), url_key(F.col(website)).alias("_key")
    )
    contact = contact_url_rows(distinct, website, paths).select(
        website, "pri", url_key(F.col("contact_url")).alias("_key")
    )
    captured = pages.select("page_id", url_key(F.col("url")).alias("_key"))
    return home.unionByName(contact).join(captured, "_key").select(website, "pri", "page_id")


def site_contacts(
    rows: DataFrame,
    pages: DataFrame,
    key: Sequence[str],
    website: str = "website",
    paths: Sequence[str] = CONTACT_PATHS,
    networks: Networks = NETWORKS,
    match: str = "substring",
    suffixes: Sequence[str] = FALSE_EMAIL_SUFFIXES,
    parts: Sequence[str] = FALSE_EMAIL_PARTS,
) -> DataFrame:
    """``rows`` with ``email`` and one column per network, blank where not found.

    Per field the first filled value wins: home page, then the contact pages in
    the order of ``paths``; several captures of one page count in ``page_id``
    order. A site whose home page was not captured yields nothing. ``key``
    identifies a row.
    """
    read = pages.where(F.col("html").isNotNull())
    found = extract_contacts(read, networks, match, suffixes, parts)
    return look_up_contacts(rows, found, key, website, paths, [n for n, _ in networks])


def look_up_contacts(
    rows: DataFrame,
    found: DataFrame,
    key: Sequence[str],
    website: str = "website",
    paths: Sequence[str] = CONTACT_PATHS,
    networks: Sequence[str] = SOCIAL_FIELDS,
) -> DataFrame:
    """``site_contacts`` from what ``extract_contacts`` found on the pages.

    The HTML is reduced to its few contact columns before anything moves. A page
    then stands for its own URL, and a contact page for its origin too; the two
    kinds of key never meet, as a URL has a slash after its origin. One
    aggregation, combined on the map side, leaves one row per key, so a site
    with a great share of all pages arrives as one row per task, and both joins
    meet a side that is unique on its key. Its second group column makes Spark
    shuffle that narrow result by the join key alone; only between two plain
    shuffles can adaptive execution split a website that many rows share. Rows
    without a website take their join key from ``key``, which spreads them.
    """
    fields = ["email", *networks]
    values = found.select(url_key(F.col("url")).alias("_key"), "page_id", *fields).where(
        F.col("_key").isNotNull()
    )
    own = F.struct(
        F.lit(0).alias("pri"), F.lit(False).alias("is_origin"), F.col("_key").alias("key")
    )
    stands_for = F.array_compact(F.array(own, _contact_page(F.col("_key"), paths)))
    per_key = (
        values.select("page_id", *fields, F.inline(stands_for).alias("_pri", "_is_origin", "_at"))
        .groupBy("_at", "_is_origin")
        .agg(
            *(
                F.min_by(f, F.when(F.col(f) != "", F.struct("_pri", "page_id"))).alias(f)
                for f in fields
            )
        )
    )

    def found_at(column: str, prefix: str) -> DataFrame:
        return per_key.select(
            F.col("_at").alias(column), *(F.col(f).alias(f"_{prefix}_{f}") for f in fields)
        )

    site = F.col(website)
    no_site = F.concat(F.lit("no site "), F.xxhash64(*key).cast("string"))
    joined = (
        rows.drop(*fields)
        .withColumn("_key", F.coalesce(url_key(site), no_site))
        .join(found_at("_home_key", "home"), F.col("_key") == F.col("_home_key"), "left")
    )
    if paths:
        joined = joined.withColumn("_origin", F.coalesce(url_origin(site), no_site)).join(
            found_at("_origin", "contact"), "_origin", "left"
        )
    was_read = F.col("_home_key").isNotNull()

    def chosen(field: str) -> Column:
        sources = [F.col(f"_home_{field}"), *([F.col(f"_contact_{field}")] if paths else [])]
        return F.coalesce(F.when(was_read, F.coalesce(*sources)), F.lit("")).alias(field)

    return joined.select(
        *(c for c in rows.columns if c not in fields), *(chosen(f) for f in fields)
    )


def _contact_page(key: Column, paths: Sequence[str]) -> Column:
    """``STRUCT<pri, is_origin, key>`` of a contact page, keyed by its origin; else null."""
    origin = F.regexp_extract(key, r"^[^:]+://[^/\\?]*", 0)
    path = F.substr(key, F.length(origin) + 1)
    pri = F.lit(None).cast("int")
    for i, wanted in reversed(list(enumerate(paths, start=1))):
        pri = F.when(path == wanted, i).otherwise(pri)
    entry = lambda p: F.struct(
        p.alias("pri"), F.lit(True).alias("is_origin"), origin.alias("key")
    )
    return let(pri, lambda p: F.when(p.isNotNull(), entry(p)))


def without_contacts(rows: DataFrame, networks: Networks = NETWORKS) -> DataFrame:
    """The same columns with every contact blank, when the contact stage is off."""
    fields = ["email", *(network for network, _ in networks)]
    return rows.drop(*fields).select("*", *(F.lit("").alias(f) for f in fields))
