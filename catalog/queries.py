"""The registered queries: every operator over the driver's tables.

The tables hold no listing captures, no social links and only addresses under
one blocked domain, so the lists of the operators are set here to values that
hit the data. The default lists are covered by the fixtures under ``tests``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storefront.functions.binding import settled
from storefront.functions.emails import is_false_email, text_emails
from storefront.functions.markup import title_text
from storefront.functions.text import (
    address_clean,
    is_address,
    is_city_line,
    is_phone,
    phone_clean,
    phone_run,
    phone_tail,
    sheet_name,
    strip_marks,
    utrim,
)
from storefront.functions.urls import is_listed, url_host, url_origin
from storefront.materialize import shared_folder
from storefront.operators import pages as page_ops
from storefront.operators import rows as row_ops
from storefront.operators import sites as site_ops
from storefront.operators.cards import listing_cards, listings_of
from storefront.operators.nodes import Sel, html_nodes, node_rows
from storefront.operators.rules import (
    Rule,
    candidate_array,
    field_candidates,
    listing_fields,
    pick_first,
    pick_first_rows,
    rules_interest,
    tel_value,
)
from storefront.plans import directory
from storefront.sinks import export
from storefront.sources.cities import city_lists, city_queries

# Lists that hit the driver's data.
DOMAINS = ("example.net", "casino-win.example.com", "ble.example.com", "ththan.example.com")
NETWORKS = (
    ("facebook", ("/the", "/der")),
    ("instagram", ("/la", "/le")),
    ("twitter", ("/de", "/is")),
    ("linkedin", ("/un", "ción")),
)
EMAIL_SUFFIXES = ("@mail5.example.com", ".example.org")
EMAIL_PARTS = ("mail2.", "19@")
SITE_PATHS = ("/fr", "/de", "/es")
CARD_SELS = (
    Sel("a", attrs=(("href", "^=", "/la"),)),
    Sel("a", attrs=(("href", "*=", "er"),)),
    Sel("a", attrs=(("href", "*=", "e"),)),
)
PAGE_RULES = (
    Rule("name", 1, "page", (Sel("h1"),)),
    Rule("name", 2, "page", (Sel("title"),)),
    Rule("note", 1, "page", (Sel("div", classes=("ad",)),), take="first"),
    Rule("link", 1, "page", (Sel("a", attrs=(("href", "^=", "/th"),), within=Sel("nav")),)),
    Rule("link", 2, "page", (Sel("a", attrs=(("href", "*=", "e"),)),), take="first"),
)
TEMPLATE = "gym in [city] ([City])"
LIMIT = 12
DEEP_LIMIT = 5000
DEEP_QUOTA = 1200
MANY_QUOTA = 5000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lang(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:]*://[^/]*/([a-z]+)", 1)


def _contactable(pages: DataFrame) -> DataFrame:
    """The pages, each with an address in its text and another in a link of its own host."""
    host = url_host(F.col("url"))
    html = F.concat(
        "html",
        F.lit(" <p>sales"),
        "page_id",
        F.lit("@"),
        host,
        F.lit('</p> <a href="mailto:Info@'),
        host,
        F.lit('?subject=x">mail</a>'),
    )
    return pages.withColumn("html", html)


def _lines(documents: DataFrame, pattern: str) -> DataFrame:
    return documents.select("doc_id", F.posexplode(F.split("text", pattern)).alias("pos", "line"))


# --- text -------------------------------------------------------------------


def city_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read as a city list."""
    return city_lists(_table(spark, sf_dir, "documents"), ["doc_id"], "text")


def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names as cities."""
    cities = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("city")
    )
    return city_queries(cities, TEMPLATE)


def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names dressed up with everything a sheet name must lose."""
    raw = F.concat(
        F.lit(" ["), "p_brand", F.lit("]: "), "p_name", F.lit("/  OF*"), "p_type", F.lit("? "), "p_name"
    )
    return _table(spark, sf_dir, "part").select("p_partkey", sheet_name(raw).alias("sheet"))


def phone_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines of documents with a run of phone characters."""
    found = _lines(_table(spark, sf_dir, "documents"), "\n").select(
        "doc_id", "pos", phone_run(F.col("line")).alias("run")
    )
    run = F.col("run")
    return found.where(run != "").select(
        "doc_id",
        "pos",
        is_phone(run).alias("is_phone"),
        phone_tail(F.concat(F.lit("Open ·  "), run)).alias("tail"),
        "run",
    )


def phone_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 on whole lines."""
    return _lines(_table(spark, sf_dir, "documents"), "\n").select(
        "doc_id", "pos", phone_clean(F.col("line")).alias("phone")
    )


def tel_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: customer keys written as percent-encoded ``tel:`` links."""
    href = F.concat(F.lit("tel:+"), F.col("c_nationkey"), F.lit("%20(0)"), F.col("c_custkey"), F.lit("%"))
    good = F.concat(href, F.lit("20"))
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", tel_value(good).alias("phone"), tel_value(href).alias("broken")
    )


def addresses_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 on whole lines, each once labelled, and wrapped in direction marks."""
    line = F.concat(F.lit("ADDRESS: ⁦ "), F.col("line"), F.lit(" ⁩ "))
    return _lines(_table(spark, sf_dir, "documents"), "\n").select(
        "doc_id", "pos", address_clean(line).alias("address")
    )


def address_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, F6 on every sentence of the whole text; both shapes have a comma."""
    text = utrim(F.col("line"))
    return (
        _lines(_table(spark, sf_dir, "documents"), r"[.\n]")
        .where(F.col("line").contains(","))
        .select(
            "doc_id",
            "pos",
            is_address(text).alias("is_address"),
            is_city_line(strip_marks(text)).alias("is_city_line"),
        )
        .where(F.col("is_address") | F.col("is_city_line"))
    )


# --- pages ------------------------------------------------------------------


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8."""
    return page_ops.page_hosts(_table(spark, sf_dir, "pages"))


def contact_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7."""
    sites = _table(spark, sf_dir, "pages").select("page_id", "url")
    return site_ops.contact_url_rows(sites, "url").drop("url")


def deny_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages whose host lies under a listed domain lose their website."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("website"))
    flagged = pages.withColumn("listed", is_listed(F.col("website"), DOMAINS))
    return site_ops.blank_listed(flagged, "website", DOMAINS)


def deny_domain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain list as a table, here the hosts of the Spanish pages."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    domains = pages.where(_lang(F.col("url")) == "es").select(url_host(F.col("url")).alias("domain"))
    return site_ops.flag_listed(pages, "url", domains.distinct()).drop("url")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, as digest and length."""
    return page_ops.page_text(_table(spark, sf_dir, "pages")).select(
        "page_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars")
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3."""
    return page_ops.page_links(_table(spark, sf_dir, "pages"))


def page_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, P9, U1 with a block list that leaves most of the data's addresses in."""
    pages = _contactable(_table(spark, sf_dir, "pages"))
    return page_ops.page_emails(pages, EMAIL_SUFFIXES, EMAIL_PARTS)


def page_first_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2."""
    pages = _contactable(_table(spark, sf_dir, "pages"))
    return page_ops.page_first_email(pages, EMAIL_SUFFIXES, EMAIL_PARTS)


def email_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, F2 on plain text: every address of the documents and whether it is blocked."""
    found = _table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.array_distinct(text_emails(F.col("text")))).alias("pos", "email")
    )
    blocked = is_false_email(F.col("email"), EMAIL_SUFFIXES, EMAIL_PARTS)
    return found.withColumn("is_false", blocked)


def page_socials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4."""
    return page_ops.page_socials(_table(spark, sf_dir, "pages"), NETWORKS)


# --- listings and rules -----------------------------------------------------


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host a result, its pages in order, three kinds of anchor as cards."""
    pages = _table(spark, sf_dir, "pages").withColumn("host", url_host(F.col("url")))
    return listing_cards(pages, ["host"], "page_id", CARD_SELS, names=())


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table under the rules: elements of each kind per page, and their attributes."""
    nodes = node_rows(_table(spark, sf_dir, "pages"), ["page_id"])
    return nodes.groupBy("page_id", "tag").agg(
        F.count("*").alias("n"), F.sum(F.size(F.map_keys("attrs"))).alias("n_attrs")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of the page rules."""
    pages = _table(spark, sf_dir, "pages")
    return field_candidates(pages, PAGE_RULES, ["page_id"]).drop("pos")


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = html_nodes(F.col("html"), rules_interest(PAGE_RULES))
    pages = settled(_table(spark, sf_dir, "pages").select("page_id", parsed.alias("_page")))
    found = pages.select("page_id", candidate_array("_page", PAGE_RULES, F.lit(0)).alias("_found"))
    fields = ("name", "note", "link")
    return found.select("page_id", *(pick_first(F.col("_found"), f).alias(f) for f in fields))


def field_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, L4 on each page's own row."""
    return _picked(spark, sf_dir)


def field_pick_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 as an aggregation over candidate rows."""
    pages = _table(spark, sf_dir, "pages")
    return pick_first_rows(field_candidates(pages, PAGE_RULES, ["page_id"]), ["page_id"])


def listing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages that have a name."""
    return _picked(spark, sf_dir).select("page_id", "name").where(F.col("name") != "")


# --- sites ------------------------------------------------------------------


def _by_language(pages: DataFrame) -> DataFrame:
    """The captures with all pages of a language standing for one page of their host."""
    url = F.concat(url_origin(F.col("url")), F.lit("/"), _lang(F.col("url")))
    return pages.withColumn("url", url)


def _sites(pages: DataFrame) -> DataFrame:
    """Every origin as a business with its English page as website."""
    origins = pages.select(url_origin(F.col("url")).alias("origin")).distinct()
    return origins.select("origin", F.concat("origin", F.lit("/en")).alias("website"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3."""
    pages = _table(spark, sf_dir, "pages")
    return site_ops.site_pages(_sites(pages), _by_language(pages), "website", SITE_PATHS)


def site_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home page first, then the other languages in order."""
    pages = _contactable(_table(spark, sf_dir, "pages"))
    sites = site_ops.blank_listed(_sites(pages), "website", DOMAINS)
    return site_ops.site_contacts(
        sites, _by_language(pages), ["origin"], "website", SITE_PATHS, NETWORKS, parts=()
    )


def contacts_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8."""
    sites = _sites(_table(spark, sf_dir, "pages"))
    return site_ops.without_contacts(sites, NETWORKS)


# --- rows -------------------------------------------------------------------


def dedup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles within each language, first page wins."""
    titles = _table(spark, sf_dir, "pages").select(
        _lang(F.col("url")).alias("city"), "page_id", title_text(F.col("html")).alias("name")
    )
    return row_ops.dedup(titles, ["city"], ["page_id"])


def dedup_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 where almost every name repeats."""
    parts = _table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("city"),
        "p_partkey",
        F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
    )
    return row_ops.dedup(parts, ["city"], ["p_partkey"])


def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    parts = _table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("city"), F.col("p_name").alias("name")
    )
    return row_ops.dedup_counts(parts, ["city"])


def limit_per_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1."""
    customers = _table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    return row_ops.limit_rows(customers, ["c_nationkey"], ["c_custkey"], LIMIT)


def page_quota_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: a result page is 250 keys wide, a card counts with a balance above 5,000."""
    customers = _table(spark, sf_dir, "customer").select(
        "c_nationkey",
        F.floor(F.col("c_custkey") / 250).alias("page_no"),
        "c_custkey",
        "c_acctbal",
    )
    return row_ops.limit_page_quota(
        customers, ["c_nationkey"], "page_no", "c_custkey", LIMIT, F.col("c_acctbal") > 5000
    )


def limit_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 at a limit beyond Spark's own cut per task, over few and large groups."""
    lines = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return row_ops.limit_rows(lines, ["l_returnflag"], ["l_orderkey", "l_linenumber"], DEEP_LIMIT)


def page_quota_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 at a limit over a thousand: pages of 250 orders per status, an order counts above 150,000."""
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderstatus", F.floor(F.col("o_orderkey") / 250).alias("page_no"), "o_orderkey", "o_totalprice"
    )
    return row_ops.limit_page_quota(
        orders, ["o_orderstatus"], "page_no", "o_orderkey", DEEP_QUOTA, F.col("o_totalprice") > 150_000
    )


def page_quota_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 at a limit that takes hundreds of pages to meet: an order counts above 10,000."""
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderstatus", F.floor(F.col("o_orderkey") / 250).alias("page_no"), "o_orderkey", "o_totalprice"
    )
    return row_ops.limit_page_quota(
        orders, ["o_orderstatus"], "page_no", "o_orderkey", MANY_QUOTA, F.col("o_totalprice") > 10_000
    )


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations, and after them the regions, which no customer lives in."""
    nations = _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("ord"), F.col("n_name").alias("city")
    )
    regions = _table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1000).alias("ord"), F.col("r_name").alias("city")
    )
    return nations.unionByName(regions)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as businesses of their nation."""
    city = F.concat(F.lit("NATION_"), F.col("c_nationkey"))
    return _table(spark, sf_dir, "customer").withColumn("city", city)


def city_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities without rows stay."""
    rows = _customers(spark, sf_dir).select("city", "c_custkey", "c_name")
    return export.in_city_order(_cities(spark, sf_dir), rows, ["c_custkey"])


def sheet_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3."""
    return export.sheet_manifest(_cities(spark, sf_dir), _customers(spark, sf_dir))


def batch_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: a folder per city and the manifest, written and read back; a city without rows is in the manifest alone."""
    cities = _cities(spark, sf_dir)
    order = F.col("ord").alias("city_ord")
    rows = _businesses(spark, sf_dir).join(cities.select(order, F.concat(F.lit("NATION_"), "ord").alias("city")), "city")
    named = cities.select("ord", F.when(F.col("ord") < 1000, F.concat(F.lit("NATION_"), "ord")).otherwise(F.col("city")).alias("city"))
    path = f"{shared_folder(spark)}/batch-{uuid.uuid4()}"
    export.write_batch(rows, named, path, ["city_ord", "c_custkey"])
    tables = spark.read.schema("c_custkey long, Name string, Website string, Email string, Address string, city_ord int, sheet string")
    written = tables.parquet(f"{path}/tables")
    manifest = spark.read.parquet(f"{path}/manifest").select(F.col("city_ord").cast("int"), "city", "sheet", "n")
    return manifest.join(written, ["city_ord", "sheet"], "left")


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _customers(spark, sf_dir).withColumn("name", F.col("c_mktsegment"))
    return export.run_status(_cities(spark, sf_dir), row_ops.dedup_counts(named, ["city"]))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return _status(spark, sf_dir)


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return export.batch_totals(_status(spark, sf_dir))


def _businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select(
        "city",
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"),
        F.concat(F.lit("https://c"), F.col("c_custkey"), F.lit(".test/")).alias("website"),
        F.lit("").alias("phone"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("me@c"), F.col("c_custkey"), F.lit(".test"))).alias("email"),
        F.concat_ws(", ", "c_name", "c_mktsegment", "city", "c_name").alias("address"),
        *(F.lit("").alias(network) for network, _ in NETWORKS),
    )


def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 per city."""
    return export.column_widths(_businesses(spark, sf_dir), ["city"])


def export_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2."""
    return export.export_links(_businesses(spark, sf_dir), ["c_custkey"])


# --- whole jobs -------------------------------------------------------------


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, P1, U3 on the flagship: the pages as a directory, ready to be written."""
    pages = _contactable(_table(spark, sf_dir, "pages"))
    rows = directory.directory_of_pages(pages, DOMAINS, (), NETWORKS, parts=())
    return export.export_rows(rows, ["host", "page_id"])


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing captures in the default markup made from the pages, a query per language."""
    pages = _table(spark, sf_dir, "pages")
    language = F.array_position(F.array(*map(F.lit, ("en", "fr", "de", "es"))), _lang(F.col("url")))
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    note = F.regexp_extract("html", r'<div class="ad">([^<]*)</div>', 1)
    return pages.select(
        (language - 1).cast("int").alias("query_ord"),
        F.floor(F.col("page_id") / 20).cast("int").alias("page_no"),
        F.pmod("page_id", F.lit(20)).cast("int").alias("idx"),
        "url",
        F.concat(
            F.lit('<div class="VkpGBb"><div class="dbg0pd" role="heading"><span class="OSrXXb">'),
            title,
            F.lit("</span></div></div>"),
        ).alias("card_html"),
        F.concat(
            F.lit('<div class="OYzgjc"><a class="n1obkb" href="'),
            "url",
            F.lit('"><span class="aSAiSd">Website</span></a><div><span>Open 24 hours</span> · 0'),
            F.col("page_id") + 100_000_000,
            F.lit('</div><div class="C9waJd y7xX3d"><div><span>Address: '),
            note,
            F.lit("</span></div></div></div>"),
        ).alias("panel_html"),
    )


def _unless_above(chosen: Column, rule: int, *pieces: Column | str) -> Column:
    """Markup of a rule, left out where a later rule is to win."""
    markup = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in pieces))
    return F.when(chosen <= rule, markup).otherwise("")


def _kind(number: Column, *kinds: Column) -> Column:
    return F.get(F.array(*kinds), F.pmod(number, F.lit(len(kinds))))


def listing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5-E8 by every rule: for each field the page and the place choose which rule finds it first.

    Each page stands for a result page of three cards, each with a panel. Elements for
    later rules are there too, those for earlier rules are not; values tell their rule.
    """
    pages = _table(spark, sf_dir, "pages").select(
        F.lit(0).alias("query_ord"), F.col("page_id").cast("int").alias("page_no"), "url"
    )
    page, idx = F.col("page_no"), F.col("idx")
    cards = pages.withColumn("idx", F.explode(F.array(*map(F.lit, range(3)))))
    key = (page * 3 + idx).cast("string")
    name, website = F.pmod(page + idx, F.lit(4)), F.pmod(page + idx, F.lit(3)) + 1
    phone, address = F.pmod(page + idx * 2, F.lit(5)) + 1, F.pmod(F.floor(page / 4) + idx, F.lit(4)) + 1

    def tag(start: str, text: str, end: str) -> Column:
        return F.concat(F.lit(f"{start}{text} "), key, F.lit(end))

    panel = F.concat(
        F.lit('<div class="panel">'),
        _unless_above(
            name, 1,
            _kind(
                page,
                tag('<div class="SPZz6b"><span> </span><span>', "n5", "</span></div>"),
                tag('<h2 data-attrid="title">', "n5", "</h2>"),
                tag('<div class="qrShPb"><i><span>', "n5", "</span></i></div>"),
            ),
        ),
        _unless_above(name, 2, tag('<h3 class="dbg0pd"><i class="OSrXXb">', "n6", "</i></h3>")),
        _unless_above(website, 1, '<a class="n1obkb" href="https://w1.test/', key, '"><b class="aSAiSd">Website</b></a>'),
        _unless_above(website, 2, '<a data-attrid="visit website" href="https://w2.test/', key, '">x</a>'),
        _unless_above(website, 3, '<a aria-label="Website of it" href="https://w3.test/', key, '">x</a>'),
        _unless_above(phone, 1, '<b data-phone-number="1000000', key, '"></b>'),
        _unless_above(phone, 2, '<a href="tel:+2000000', key, '">x</a>'),
        _unless_above(phone, 3, '<b aria-label="Call 3000000', key, ' now"></b>'),
        _unless_above(phone, 4, '<div class="C9waJd"> 4000000', key, " </div>"),
        _unless_above(phone, 5, '<div class="rllt__details"><div>Open · 5000000', key, "</div></div>"),
        _unless_above(address, 1, '<div class="C9waJd y7xX3d">Address: 1 Main St, ', key, "</div>"),
        _unless_above(address, 2, '<p jsname="eSHGZ">9:00, Monday morning</p><p jsname="eSHGZ">2 Long Road, ', key, "</p>"),
        _unless_above(address, 3, '<div class="nICndb">\u20663 Pune, India ', key, "\u2069</div>"),
        _unless_above(address, 4, '<p data-attrid="kc:/address"><i class="LrzXr">4 Hill, ', key, "</i></p>"),
        F.lit("</div>"),
    )
    panels = cards.select("query_ord", "page_no", "idx", panel.alias("panel_html"))

    def card(place: int) -> Column:
        number = (page * 3 + place).cast("string")
        named = F.concat(
            _kind(page, F.lit('<b class="OSrXXb">'), F.lit('<b class="dbg0pd">'), F.lit('<b role="heading">')),
            F.lit("n1 "), number, F.lit("</b>"),
        )
        chosen = F.pmod(page + place, F.lit(4)) == 0
        return F.concat(F.lit('<div class="VkpGBb">'), F.when(chosen, named).otherwise("card"), F.lit("</div>"))

    top = [F.concat(F.lit('<i class="OSrXXb">n7 '), (page * 3 + place).cast("string"), F.lit("</i>")) for place in range(3)]
    html = F.concat(*top, *(card(place) for place in range(3)))
    listings = listings_of(pages.withColumn("html", html), panels)
    return listing_fields(listings, ["query_ord", "page_no", "idx"])


def directory_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry 1: E5-E8, L2, A1, F1, F9, J1, J2 in one job."""
    pages = _contactable(_table(spark, sf_dir, "pages"))
    return directory.build_directory(
        _listings(spark, sf_dir), pages, 30, domains=DOMAINS, networks=NETWORKS, parts=()
    )


def directory_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries 2 and 3: languages as the list of cities, plain limit, no contacts."""
    pages = _table(spark, sf_dir, "pages")
    languages = pages.select(_lang(F.col("url")).alias("city")).distinct()
    order = F.array_position(F.array(*map(F.lit, ("en", "fr", "de", "es"))), F.col("city"))
    cities = languages.select((order - 1).cast("int").alias("ord"), "city")
    return directory.build_directory_batch(
        cities,
        TEMPLATE,
        _listings(spark, sf_dir),
        pages,
        limit=25,
        limit_mode="rows",
        with_contacts=False,
        domains=DOMAINS,
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "city_list": city_list,
    "query_expand": query_expand,
    "sheet_names": sheet_names,
    "phone_find": phone_find,
    "phone_clean": phone_cleaned,
    "tel_links": tel_links,
    "address_clean": addresses_cleaned,
    "address_shape": address_shape,
    "url_hosts": url_hosts,
    "contact_urls": contact_urls,
    "deny_domains": deny_domains,
    "deny_domain_table": deny_domain_table,
    "page_text": page_text,
    "page_links": page_links,
    "page_emails": page_emails,
    "page_first_email": page_first_email,
    "email_filter": email_filter,
    "page_socials": page_socials,
    "listing_cards": cards,
    "listing_names": listing_names,
    "page_nodes": page_nodes,
    "field_candidates": candidates,
    "field_pick": field_pick,
    "field_pick_rows": field_pick_rows,
    "site_pages": site_pages,
    "site_contacts": site_contacts,
    "contacts_off": contacts_off,
    "dedup_names": dedup_names,
    "dedup_parts": dedup_parts,
    "dedup_counts": dedup_counts,
    "limit_per_city": limit_per_city,
    "page_quota_limit": page_quota_limit,
    "limit_deep": limit_deep,
    "page_quota_deep": page_quota_deep,
    "page_quota_many": page_quota_many,
    "city_order": city_order,
    "sheet_manifest": sheet_manifest,
    "batch_tables": batch_tables,
    "run_status": run_status,
    "batch_totals": batch_totals,
    "column_widths": column_widths,
    "export_links": export_links,
    "export_rows": export_rows,
    "listing_rules": listing_rules,
    "directory_job": directory_job,
    "directory_batch": directory_batch,
}
