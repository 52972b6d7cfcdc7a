"""Character references, decoded with built-in functions only.

The text is cut at every ``&``; each piece is looked at once, so a decoded
``&`` is never decoded again. The names come from the standard library's tables.
Numeric references are all decoded, and so are all names of HTML 5: the table is
a literal in the plan, folded into maps by first letter when the query is planned.
A map is searched from its beginning, so the names that texts are full of come first.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from storefront.functions.binding import let

ALL_NAMES: Mapping[str, str] = html5
# Names that also count without the closing semicolon, longest first.
_BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
# Searched first, in this order.
_FREQUENT = ("amp", "nbsp", "lt", "gt", "quot", "copy", "middot", "eacute", "agrave", "uuml", "ouml", "auml", "szlig")
_NUMBER = "^#(?:0*([0-9]+)|[xX]0*([0-9a-fA-F]+));?"
_NAMED = "^([a-zA-Z][a-zA-Z0-9]*;)"
_REPLACEMENT = "\ufffd"
# What the numbers 128 to 159 stand for.
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))


def _by_letter(names: Mapping[str, str]) -> dict[str, dict[str, str]]:
    """The names in maps by their first letter, frequent ones first."""
    rank = {name: n for n, name in enumerate(_FREQUENT)}
    maps: dict[str, dict[str, str]] = {}
    for name in sorted(names, key=lambda n: (rank.get(n.rstrip(";"), len(rank)), n)):
        maps.setdefault(name[0], {})[name] = names[name]
    return maps


def _literal(names: Mapping[str, str]) -> str:
    return json.dumps(names).replace("'", "\\u0027")


def _decoder(in_attribute: bool, names: Mapping[str, str]) -> str:
    """SQL lambda that decodes the piece after each ``&``; the piece before the first stays.

    As SQL it is one call to the JVM. The same as Column operations is over a
    hundred, which is what building a query would then spend its time on.
    """
    closed = {n: text for n, text in names.items() if n.endswith(";")}
    unclosed = {n: text for n, text in names.items() if not n.endswith(";")}
    # In an attribute "&copy=1" and "&copyright" are no references.
    bare = f"^({_BARE_NAMES})" + ("(?![=a-zA-Z0-9])" if in_attribute else "")
    decimal = f"regexp_extract(piece, r'{_NUMBER}', 1)"
    hexadecimal = f"regexp_extract(piece, r'{_NUMBER}', 2)"
    number = f"""
        CASE WHEN {decimal} <> '' AND length({decimal}) <= 7 THEN CAST({decimal} AS BIGINT)
             WHEN {decimal} = '' AND length({hexadecimal}) <= 6
             THEN CAST(conv({hexadecimal}, 16, 10) AS BIGINT) END"""
    character = f"""
        CASE WHEN n IS NULL OR n = 0 OR n BETWEEN {0xD800} AND {0xDFFF} OR n > {0x10FFFF}
             THEN '{_REPLACEMENT}'
             WHEN n BETWEEN 128 AND 159 THEN substr('{_WINDOWS}', CAST(n AS INT) - 127, 1)
             ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END"""

    def by_name(pattern: str, known: Mapping[str, str]) -> str:
        # a map in a map would keep Spark from seeing that two plans are the same
        branches = " ".join(
            f"WHEN '{letter}' THEN try_element_at(from_json(r'{_literal(names)}', 'map<string,string>'), name)"
            for letter, names in _by_letter(known).items()
        )
        return f"""
        transform(array(regexp_extract(piece, r'{pattern}', 1)),
                  name -> CASE WHEN name <> '' THEN
                    concat(CASE left(name, 1) {branches} END, substr(piece, length(name) + 1)) END)[0]"""

    return f"""(piece, i) -> CASE
        WHEN i = 0 THEN piece
        WHEN regexp_like(piece, r'{_NUMBER}') THEN
          concat(transform(array({number}), n -> {character})[0],
                 regexp_replace(piece, r'{_NUMBER}', ''))
        ELSE coalesce({by_name(_NAMED, closed)}, {by_name(bare, unclosed)}, concat('&', piece)) END"""


def decode_entities(
    c: Column, in_attribute: bool = False, names: Mapping[str, str] = ALL_NAMES
) -> Column:
    """Replace named and numeric character references by their characters."""
    decoder = F.expr(_decoder(in_attribute, names))

    def decode(text: Column) -> Column:
        pieces = F.call_function("transform", F.split(text, "&"), decoder)
        return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)

    return let(c, decode)
