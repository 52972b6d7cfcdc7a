"""Listing fields from an ordered rule table.

A rule names the elements it looks at and how a value is read from one; the
first non-blank value by rule priority, then by document order, wins. Rules are
data: the defaults describe one site's markup at one date, callers pass others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storefront.functions.binding import settled
from storefront.functions.text import (
    address_clean,
    is_address,
    is_city_line,
    is_phone,
    phone_clean,
    phone_run,
    phone_tail,
    strip_marks,
    utrim,
)
from storefront.functions.urls import has_scheme, url_join
from storefront.operators.nodes import (
    Interest,
    Sel,
    cut_text,
    html_nodes,
    html_nodes_each,
    inside,
    interest_of,
    node_attr,
    node_text,
    select_nodes,
)

LABEL_CLASS = "aSAiSd"
PHONE_ATTR = "data-phone-number"


#: A text that ends in a phone is told by so many bytes from its end, unless all are phone characters.
PHONE_TAIL_BYTES = 96


def _size(node: Column) -> Column:
    return node["tail"] - node["head"]


def _short_text(node: Column, page: Column, most: int) -> Column:
    """Text of an element, null if it has more than ``most`` characters for sure (a character has 4 bytes at most)."""
    return F.when(_size(node) <= 4 * most, node_text(node, page))


def _text(node: Column, page: Column) -> Column:
    return node_text(node, page)


def _attr(name: str) -> Callable[[Column, Column], Column]:
    return lambda node, page: F.coalesce(node_attr(node, name), F.lit(""))


def _link(node: Column, page: Column) -> Column:
    """The href as captured; it is made absolute once, after the pick."""
    return F.coalesce(utrim(node_attr(node, "href")), F.lit(""))


def _website_button(node: Column, page: Column) -> Column:
    """The link of a button that is labelled ``website`` or ``site``."""
    inner = F.get(
        F.filter(
            page["nodes"],
            lambda n: F.array_contains(n["cls"], LABEL_CLASS) & inside(n, node),
        ),
        0,
    )
    label = F.lower(_short_text(F.coalesce(inner, node), page, 7))
    link = _link(node, page)
    is_web = link.rlike("^(?i:http)") | ~has_scheme(link)
    return F.when(label.isin("website", "site") & is_web, link).otherwise("")


def tel_value(href: Column) -> Column:
    """Number of a ``tel:`` link, percent-decoded; null if an escape is broken."""
    raw = F.regexp_replace(href, "^tel:", "")
    return utrim(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def _tel(node: Column, page: Column) -> Column:
    return F.coalesce(tel_value(node_attr(node, "href")), F.lit(""))


def _call_label(node: Column, page: Column) -> Column:
    return F.coalesce(node_attr(node, PHONE_ATTR), phone_run(node_attr(node, "aria-label")))


def _phone_text(node: Column, page: Column) -> Column:
    text = _short_text(node, page, 20)
    return F.when(is_phone(text), text).otherwise("")


def _phone_tail(node: Column, page: Column) -> Column:
    """``phone_tail`` of the text, which reads all of it only where its end leaves that open."""
    end = cut_text(page, F.greatest(node["head"], node["tail"] - PHONE_TAIL_BYTES), node["tail"])
    # the cut may have parted a character
    end = F.regexp_replace(end, "^\ufffd+", "")
    whole = (_size(node) <= PHONE_TAIL_BYTES) | (phone_clean(end) == utrim(end))
    return F.when(whole, phone_tail(node_text(node, page))).otherwise(phone_tail(end))


def _phone_in_text(node: Column, page: Column) -> Column:
    tail = _phone_tail(node, page)
    return F.when(tail != "", tail).otherwise(_phone_text(node, page))


def _address_text(node: Column, page: Column) -> Column:
    text = _short_text(node, page, 200)
    return F.when(is_address(text), text).otherwise("")


def _city_line(node: Column, page: Column) -> Column:
    text = strip_marks(node_text(node, page))
    return F.when(is_city_line(text), text).otherwise("")


@dataclass(frozen=True)
class Rule:
    """One way to find a field.

    ``take`` is ``each`` (every matching element is a candidate), ``first``
    (only the first one, even if its value is blank), ``first_kind`` (the first
    element of the first description that has any) or ``nth`` (the element at
    the position of the listing, counted over its result page and then its panel).
    """

    field: str
    pri: int
    scope: str
    sels: tuple[Sel, ...]
    take: str = "each"
    value: Callable[[Column, Column], Column] = _text  # of an element and its page


_CARD, _PANEL = "card", "panel"

# Class and attribute names of the captured markup.
LISTING_RULES = (
    Rule(
        "name", 1, _CARD,
        (Sel(classes=("OSrXXb",)), Sel(classes=("dbg0pd",)), Sel(attrs=(("role", "=", "heading"),))),
        take="first_kind",
    ),
    Rule(
        "name", 5, _PANEL,
        (
            Sel("span", within=Sel(classes=("SPZz6b",))),
            Sel("h2", attrs=(("data-attrid", "=", "title"),)),
            Sel("span", within=Sel(classes=("qrShPb",))),
        ),
    ),
    Rule("name", 6, _PANEL, (Sel(classes=("OSrXXb",), within=Sel(classes=("dbg0pd",))),)),
    Rule("name", 7, _PANEL, (Sel(classes=("OSrXXb",)),), take="nth"),
    Rule(
        "website", 1, _PANEL,
        (Sel("a", classes=("n1obkb",)), Sel("a", classes=("ab_button",))),
        value=_website_button,
    ),
    Rule(
        "website", 2, _PANEL, (Sel("a", attrs=(("data-attrid", "*=", "website"),)),),
        take="first", value=_link,
    ),
    Rule(
        "website", 3, _PANEL,
        (
            Sel("a", attrs=(("aria-label", "*=", "Website"),)),
            Sel("a", attrs=(("aria-label", "*=", "website"),)),
        ),
        take="first", value=_link,
    ),
    Rule(
        "phone", 1, _PANEL, (Sel(attrs=((PHONE_ATTR, "has", ""),)),),
        take="first", value=_attr(PHONE_ATTR),
    ),
    Rule(
        "phone", 2, _PANEL, (Sel("a", attrs=(("href", "^=", "tel:"),)),),
        take="first", value=_tel,
    ),
    Rule(
        "phone", 3, _PANEL, (Sel(attrs=(("aria-label", "*=", "Call"),)),),
        take="first", value=_call_label,
    ),
    Rule(
        "phone", 4, _PANEL, (Sel(classes=("C9waJd",), without=("y7xX3d",)),), value=_phone_text
    ),
    Rule(
        "phone", 5, _PANEL,
        (
            Sel("div", within=Sel(classes=("rllt__details",))),
            Sel("div", within=Sel(classes=("OYzgjc",))),
        ),
        value=_phone_in_text,
    ),
    Rule("address", 1, _PANEL, (Sel(classes=("C9waJd", "y7xX3d")),), take="first"),
    Rule("address", 2, _PANEL, (Sel(attrs=(("jsname", "=", "eSHGZ"),)),), value=_address_text),
    Rule(
        "address", 3, _PANEL, (Sel(classes=("nICndb",)), Sel(classes=("cyspcb",))),
        value=_city_line,
    ),
    Rule(
        "address", 4, _PANEL,
        (
            Sel(classes=("LrzXr",), within=Sel(attrs=(("data-attrid", "*=", "address"),))),
            Sel(classes=("LrzXr",), within=Sel(attrs=(("data-attrid", "*=", "location"),))),
        ),
        take="first",
    ),
)

# What happens to a field after it is picked: the value and the URL of its page.
CLEANERS: dict[str, Callable[[Column, Column], Column]] = {
    "website": lambda value, url: F.when(value != "", url_join(url, value)).otherwise(""),
    "phone": lambda value, url: phone_clean(value),
    "address": lambda value, url: address_clean(value),
}


def rules_interest(rules: Sequence[Rule]) -> Interest:
    """Elements and attributes the rules can use."""
    sels = [sel for rule in rules for sel in rule.sels]
    interest = interest_of(sels, shown=("href", PHONE_ATTR))
    if any(rule.value is _website_button for rule in rules):
        interest = interest | Interest(classes=frozenset([LABEL_CLASS]))
    return interest


def _hits(rule: Rule, nodes: str, position: Column) -> Column:
    matching = select_nodes(nodes, rule.sels)
    if rule.take == "each":
        return matching
    if rule.take == "first":
        return F.slice(matching, 1, 1)
    if rule.take == "nth":
        return F.filter(matching, lambda node, at: at == position)
    if rule.take == "first_kind":
        firsts = [F.slice(select_nodes(nodes, (sel,)), 1, 1) for sel in rule.sels]
        result = firsts[-1]
        for first in reversed(firsts[:-1]):
            result = F.when(F.size(first) > 0, first).otherwise(result)
        return result
    raise ValueError(f"unknown take {rule.take!r}")


def candidate_array(page: str, rules: Sequence[Rule], position: Column) -> Column:
    """``ARRAY<STRUCT<field, pri, pos, value>>`` of all rules on the page parsed into column ``page``."""
    column = F.col(page)

    def found(rule: Rule) -> Column:
        return F.transform(
            _hits(rule, f"{page}.nodes", position),
            lambda node: F.struct(
                F.lit(rule.field).alias("field"),
                F.lit(rule.pri).alias("pri"),
                node["node"].alias("pos"),
                rule.value(node, column).alias("value"),
            ),
        )

    return F.concat(*(found(rule) for rule in rules))


def first_value(page: str, rules: Sequence[Rule], position: Column) -> Column:
    """First non-blank value of rules of one priority, null if there is none.

    For one rule its elements are looked at in order, and none after the first that gives a value.
    """
    if len(rules) > 1:
        found = candidate_array(page, rules, position)
        return F.array_min(F.filter(found, lambda c: c["value"] != ""))["value"]
    (rule,), column = rules, F.col(page)

    def value(node: Column) -> Column:
        return F.transform(F.array(rule.value(node, column)), lambda v: F.when(v != "", v))[0]

    return F.aggregate(
        _hits(rule, f"{page}.nodes", position),
        F.lit(None).cast("string"),
        lambda known, node: F.when(known.isNotNull(), known).otherwise(value(node)),
    )


def pick_first(candidates: Column, field: str) -> Column:
    """First non-blank value of a field by priority, then position; never null."""
    usable = F.filter(candidates, lambda c: (c["field"] == field) & (c["value"] != ""))
    return F.coalesce(F.array_min(usable)["value"], F.lit(""))


def pick_first_rows(candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same pick over candidate rows ``(*by, field, pri, pos, value)``.

    A partial aggregation, so a group of any size reaches one task as one row
    per map task.
    """
    first = F.min_by("value", F.struct("pri", "pos"))
    usable = candidates.where(F.col("value") != "")
    return usable.groupBy(*by, "field").agg(first.alias("value"))


def field_candidates(
    pages: DataFrame, rules: Sequence[Rule], by: Sequence[str], html: str = "html"
) -> DataFrame:
    """Candidate rows ``(*by, field, pri, pos, value)`` of every page."""
    parsed = settled(pages.select(*by, html_nodes(F.col(html), rules_interest(rules)).alias("_page")))
    found = candidate_array("_page", rules, F.lit(0))
    return parsed.select(*by, F.inline(found))


def listing_fields(
    listings: DataFrame,
    keys: Sequence[str],
    rules: Sequence[Rule] = LISTING_RULES,
    url: str = "url",
    idx: str = "idx",
) -> DataFrame:
    """One row per listing: its keys and one column per field, blank if not found.

    Expects the captured ``card_html`` and ``panel_html`` of each listing, and, for
    the rules that count over the result page, its ``page_name`` and ``page_names``
    (``listings_of``); without these they count in the panel alone. Every listing
    is parsed and decided on its own row: no shuffle.
    """
    scopes = {scope: [r for r in rules if r.scope == scope] for scope in (_CARD, _PANEL)}
    if {"page_name", "page_names"} <= set(listings.columns):
        on_page, before = F.col("page_name"), F.coalesce(F.col("page_names"), F.lit(0))
    else:
        on_page, before = F.lit(None).cast("string"), F.lit(0)
    both = html_nodes_each({s: (F.col(f"{s}_html"), rules_interest(scoped)) for s, scoped in scopes.items()})
    parsed = listings.select(
        *keys,
        F.col(url).alias("_url"),
        (F.col(idx) - before).alias("_nth"),
        on_page.alias("_on_page"),
        both.alias("_both"),
    )
    parsed = settled(parsed)
    parsed = parsed.select("*", *(F.col(f"_both.{scope}").alias(f"_{scope}") for scope in scopes)).drop("_both")
    fields = list(dict.fromkeys(rule.field for rule in rules))

    def picked_field(field: str) -> Column:
        """The rules in order; those after the one that gives a value are not looked at."""
        values = []
        for pri in sorted({rule.pri for rule in rules if rule.field == field}):
            if any(r.take == "nth" for r in rules if (r.field, r.pri) == (field, pri)):
                values.append(F.when(F.col("_on_page") != "", F.col("_on_page")))
            for scope, scoped in scopes.items():
                same = [r for r in scoped if (r.field, r.pri) == (field, pri)]
                if same:
                    values.append(first_value(f"_{scope}", same, F.col("_nth")))
        return F.coalesce(*values, F.lit(""))

    picked = parsed.select(*keys, "_url", *(picked_field(f).alias(f) for f in fields))
    return picked.select(
        *keys,
        *(
            CLEANERS[f](F.col(f), F.col("_url")).alias(f) if f in CLEANERS else F.col(f)
            for f in fields
        ),
    )
