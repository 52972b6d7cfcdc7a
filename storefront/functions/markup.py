"""HTML by regular expression, inside the JVM: visible text and anchors.

One left-to-right pass recognises comments, raw-text elements and tags, so a
comment inside a script, or a tag inside an attribute, is read as what it is.
All repetition is possessive or over a single character class: a tag of any
size costs linear time and no stack. An unclosed comment, element or tag runs
to the end of the page, as in a browser.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from storefront.functions.entities import ALL_NAMES, decode_entities

SPACE = r"[\t\n\f\r ]"
END = r"(?![\s\S])"
CLOSE = rf"(?:>|{END})"
NAME_END = r"(?=[\t\n\f\r />])"
# Everything up to the end of a tag; a quote opens a value only after "=".
ATTRIBUTES = rf"""(?:[^>=]++|={SPACE}*+(?:"[^"]*+(?:"|{END})|'[^']*+(?:'|{END}))?+)*+"""
COMMENT = rf"!--(?:-?>|.*?(?:--!?>|{END}))"
BOGUS_COMMENT = rf"(?:[!?]|/(?![a-z]))[^>]*+{CLOSE}"
ANY_TAG = rf"/?[a-z]{ATTRIBUTES}{CLOSE}"
_VALUE = rf"""(?:"[^"]*+"?+|'[^']*+'?+|[^\t\n\f\r >]*+)"""
_ASSIGN = rf"(?:{SPACE}*+={SPACE}*+{_VALUE})?+"
_ATTRIBUTE = rf"[^\t\n\f\r />][^\t\n\f\r />=]*+{_ASSIGN}"


def raw_element(names: str, group: int = 1) -> str:
    """An element whose content is not markup, up to its own end tag (uses one group)."""
    return (
        rf"({names}){NAME_END}{ATTRIBUTES}{CLOSE}"
        rf".*?(?:</\{group}{NAME_END}[^>]*+{CLOSE}|{END})"
    )


# Elements whose content is text as it stands, tags included; group 3 is that content.
_PLAIN_ELEMENT = (
    rf"(title|textarea|iframe|xmp|noframes|noembed){NAME_END}{ATTRIBUTES}{CLOSE}"
    rf"(.*?)(?=</\2{NAME_END}|{END})"
)
_NOT_TEXT = (
    rf"(?is)<(?:{COMMENT}|{raw_element('script|style|noscript')}|{_PLAIN_ELEMENT}"
    rf"|{BOGUS_COMMENT}|{ANY_TAG})"
)


def _attribute(name: str) -> str:
    """From the end of a tag name to an attribute (in a group), which may have no value."""
    this = rf"{name}(?=[\t\n\f\r =/>])"
    return (
        rf"(?:[\t\n\f\r /]*+(?!{this}){_ATTRIBUTE})*+[\t\n\f\r /]*+({this}{_ASSIGN})"
    )


def _value_of(name: str) -> str:
    return rf"""(?is)^{name}{SPACE}*+(?:={SPACE}*+(?:"([^"]*+)"?|'([^']*+)'?|(.*)))?$"""


def _anchor_pattern(raw: str) -> str:
    """Group 2 is the ``href`` attribute of each anchor, blank for any other token."""
    anchor = rf"a{NAME_END}{_attribute('href')}{ATTRIBUTES}{CLOSE}"
    return rf"(?is)<(?:{COMMENT}|{raw_element(raw)}|{anchor}|{BOGUS_COMMENT}|{ANY_TAG})"


_RAW_TEXT = "script|style|title|textarea|iframe|xmp|noframes|noembed"
_ANCHORS = _anchor_pattern(_RAW_TEXT + "|noscript")
# Group 1 is a start tag without its "<", blank for any other token.
_START_TAGS = (
    rf"(?is)<(?:{COMMENT}|{BOGUS_COMMENT}|/[a-z]{ATTRIBUTES}{CLOSE}"
    rf"|(?=([a-z]{ATTRIBUTES}{CLOSE}))(?:{raw_element(_RAW_TEXT, group=2)}|[a-z]{ATTRIBUTES}{CLOSE}))"
)
_TITLE = rf"(?is)<title{NAME_END}{ATTRIBUTES}{CLOSE}(.*?)(?:</title{NAME_END}|{END})"


def start_tags(html: Column) -> Column:
    """``ARRAY<STRING>`` of the start tags, less their ``<``, in document order."""
    return F.array_remove(F.regexp_extract_all(html, F.lit(_START_TAGS), F.lit(1)), "")


def tag_attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one of ``start_tags``, blank if it has none, null if absent."""
    attribute = F.regexp_extract(tag, rf"(?is)^[a-z][^\t\n\f\r />]*+{_attribute(name)}", 1)
    value = F.regexp_replace(attribute, _value_of(name), "$1$2$3")
    return F.when(attribute != "", decode_entities(value, in_attribute=True))


def visible_text(
    html: Column, sep: str = "", names: Mapping[str, str] = ALL_NAMES
) -> Column:
    """Text of a page without scripts, styles, ``noscript`` parts, comments and tags.

    Text on both sides of a tag is joined with ``sep``; the default joins it
    with nothing, so ``<td>a@b.com</td><td>Tel</td>`` reads ``a@b.comTel``.
    """
    separator = sep.replace("\\", r"\\").replace("$", r"\$")
    return decode_entities(F.regexp_replace(html, _NOT_TEXT, separator + "$3"), names=names)


def title_text(html: Column) -> Column:
    """Text of the page's title as it would show: references decoded, outer space kept."""
    return decode_entities(F.regexp_extract(html, _TITLE, 1))


def anchor_hrefs(html: Column) -> Column:
    """``ARRAY<STRING>`` of the anchors' href values in document order; what ``noscript`` holds is text."""
    found = F.array_remove(F.regexp_extract_all(html, F.lit(_ANCHORS), F.lit(2)), "")
    return F.transform(
        found,
        lambda href: decode_entities(
            F.regexp_replace(href, _value_of("href"), "$1$2$3"), in_attribute=True
        ),
    )
