"""Listing cards of captured result pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storefront.functions.binding import let, settled
from storefront.functions.markup import start_tags, tag_attribute
from storefront.materialize import materialize
from storefront.operators.nodes import Sel, html_nodes, interest_of, node_text, select_nodes

# What a listing card looks like, the most reliable first.
CARD_SELS = (
    Sel(classes=("VkpGBb",)),
    Sel(classes=("rllt__link",)),
    Sel(classes=("cXedhc",)),
    Sel(attrs=(("data-rc", "has", ""),)),
)
# The elements of a result page that the last name rule counts.
PAGE_NAME_SELS = (Sel(classes=("OSrXXb",)),)


def has_card(html: Column, sels: Sequence[Sel] = CARD_SELS) -> Column:
    """Whether a page holds any card, told from its start tags without parsing the page.

    For descriptions that name no ancestor, which start tags alone do not tell.
    """

    def is_card(tag: Column) -> Column:
        hit = F.lit(False)
        for sel in sels:
            if sel.within is not None:
                raise ValueError("start tags do not tell what an element stands under")
            test = F.lit(True)
            if sel.tag:
                test = test & tag.rlike(rf"^(?i:{sel.tag})(?=[\t\n\f\r />])")
            words = F.split(F.coalesce(tag_attribute(tag, "class"), F.lit("")), r"[\t\n\f\r ]+")
            for cls in sel.classes:
                test = test & F.array_contains(words, cls)
            for cls in sel.without:
                test = test & ~F.array_contains(words, cls)
            for name, op, want in sel.attrs:
                value = tag_attribute(tag, name)
                tests = {
                    "has": value.isNotNull(),
                    "=": value == want,
                    "^=": value.startswith(want),
                    "*=": value.contains(want),
                }
                test = test & F.coalesce(tests[op], F.lit(False))
            hit = hit | test
        return hit

    return F.coalesce(F.exists(start_tags(html), is_card), F.lit(False))


def _before_the_end(pages: DataFrame, by: Sequence[str], page: str, has_cards: Column) -> DataFrame:
    """The pages before the first one without a card.

    The end of each result is combined on the map side and is one small row per
    result that has such a page. Within Spark's broadcast size the pages are not
    shuffled for it. Beyond that, the small table is repartitioned by another column
    first: the join then has a plain shuffle on both sides, between which adaptive
    execution splits a result that holds a great share of all pages.
    """
    ends = pages.where(~has_cards).groupBy(*by).agg(F.min(page).alias("_end")).repartition("_end")
    return (
        pages.join(ends, list(by), "left")
        .where(F.col("_end").isNull() | (F.col(page) < F.col("_end")))
        .select(*pages.columns)
    )


def pages_in_result(
    pages: DataFrame,
    by: Sequence[str] = ("query_ord",),
    page: str = "page_no",
    sels: Sequence[Sel] = CARD_SELS,
) -> DataFrame:
    """The pages before the first one without a card, as captured; later captures are dropped."""
    if all(sel.within is None for sel in sels):
        return _before_the_end(pages, by, page, has_card(F.col("html"), sels))
    parsed = settled(pages.withColumn("_page", html_nodes(F.col("html"), interest_of(sels))))
    flagged = parsed.withColumn("_any", F.size(select_nodes("_page.nodes", sels)) > 0).drop("_page")
    return _before_the_end(flagged, by, page, F.col("_any")).select(*pages.columns)


def listing_cards(
    pages: DataFrame,
    by: Sequence[str] = ("query_ord",),
    page: str = "page_no",
    sels: Sequence[Sel] = CARD_SELS,
    keep: Sequence[str] = (),
    names: Sequence[Sel] = PAGE_NAME_SELS,
) -> DataFrame:
    """``(*by, page, idx, pri, *keep, card_html, page_name, page_names)``: the cards of each result in page order.

    Per page the first description with any hit counts (``pri``, from 1), and
    ``idx`` numbers its cards from 0. ``page_names`` is how many elements of ``names``
    the whole page holds, ``page_name`` the text of the ``idx``-th of them, null if
    there are fewer; without ``names`` both columns are left out.

    A page is read and parsed once, into a row of its cards and names, which is
    written: the end of a result is found from those rows, and no page is shuffled.
    """
    parsed = settled(
        pages.select(*by, page, *keep, "html", html_nodes(F.col("html"), interest_of([*sels, *names])).alias("_page"))
    )
    chosen = None
    for pri, sel in enumerate(sels, start=1):
        cards = F.transform(select_nodes("_page.nodes", (sel,)), _card(pri, F.col("html")))
        chosen = cards if chosen is None else F.coalesce(_unless_empty(chosen), cards)
    columns = [*by, page, *keep, chosen.alias("_cards")]
    if names:
        texts = F.transform(select_nodes("_page.nodes", names), lambda n: node_text(n, F.col("_page")))
        columns.append(texts.alias("_names"))
    rows = materialize(parsed.select(*columns))
    kept = _before_the_end(rows, by, page, F.size("_cards") > 0)
    carried = ["_names"] if names else []
    cards = kept.select(*by, page, *keep, *carried, F.posexplode("_cards").alias("idx", "_card"))
    return cards.select(
        *by,
        page,
        "idx",
        F.col("_card.pri").alias("pri"),
        *keep,
        F.col("_card.html").alias("card_html"),
        *(F.get(names, F.col("idx")).alias("page_name") for names in carried),
        *(F.size(names).alias("page_names") for names in carried),
    )


def listings_of(
    result_pages: DataFrame, panels: DataFrame, names: Sequence[Sel] = PAGE_NAME_SELS
) -> DataFrame:
    """The ``listings`` table from captures of result pages and of detail panels.

    ``result_pages`` holds ``query_ord, page_no, url, html`` and ``panels`` holds
    ``query_ord, page_no, idx, panel_html``. A card without a panel stays. The
    key of a card is unique, so no key is hot. ``page_name`` and ``page_names`` are
    what the last name rule counts over the whole result page; without ``names``
    they are left out, and the rule counts in the panel alone.
    """
    keys = ["query_ord", "page_no", "idx"]
    cards = listing_cards(result_pages, keep=["url"], names=names)
    return cards.join(panels.select(*keys, "panel_html"), keys, "left").select(
        *keys, "url", "card_html", "panel_html", *(["page_name", "page_names"] if names else [])
    )


def _card(pri: int, html: Column) -> Callable[[Column], Column]:
    return lambda n: F.struct(
        F.lit(pri).alias("pri"), F.substr(html, n["beg"] + 1, n["end"] - n["beg"]).alias("html")
    )


def _unless_empty(array: Column) -> Column:
    return let(array, lambda a: F.when(F.size(a) > 0, a))
