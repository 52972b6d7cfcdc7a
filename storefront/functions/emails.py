"""E-mail addresses of a page, row-local."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from storefront.functions.markup import anchor_hrefs, visible_text
from storefront.functions.text import utrim
from storefront.params import (
    EMAIL_DOMAIN,
    EMAIL_LOCAL,
    FALSE_EMAIL_PARTS,
    FALSE_EMAIL_SUFFIXES,
)

# A match starts where a run of local-part characters starts, or right after
# the match before; every later start in the run would reach the same "@", so
# trying only these keeps the search linear on a run of any length.
_EMAIL = rf"(?:\G|(?<![{EMAIL_LOCAL}]))[{EMAIL_LOCAL}]++@{EMAIL_DOMAIN}"


def text_emails(text: Column) -> Column:
    """``ARRAY<STRING>`` of every address in a text, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(_EMAIL), F.lit(0))


def mailto_value(href: Column) -> Column:
    """Address of a ``mailto:`` link: scheme and query removed, trimmed."""
    return utrim(F.substring_index(F.regexp_replace(href, "^mailto:", ""), "?", 1))


def mailto_emails(hrefs: Column) -> Column:
    """``ARRAY<STRING>`` of the non-blank ``mailto:`` values among hrefs."""
    links = F.filter(hrefs, lambda h: h.startswith("mailto:"))
    return F.array_remove(F.transform(links, mailto_value), "")


def is_false_email(
    email: Column,
    suffixes: Sequence[str] = FALSE_EMAIL_SUFFIXES,
    parts: Sequence[str] = FALSE_EMAIL_PARTS,
) -> Column:
    """Ends in a listed suffix or contains a listed part, whatever the case."""
    tests = [re.escape(s.lower()) + r"\z" for s in suffixes]
    tests += [re.escape(p.lower()) for p in parts]
    return F.lower(email).rlike("|".join(tests)) if tests else F.lit(False)


def drop_false(
    emails: Column,
    suffixes: Sequence[str] = FALSE_EMAIL_SUFFIXES,
    parts: Sequence[str] = FALSE_EMAIL_PARTS,
) -> Column:
    return F.filter(emails, lambda e: ~is_false_email(e, suffixes, parts))


def html_emails(
    html: Column,
    suffixes: Sequence[str] = FALSE_EMAIL_SUFFIXES,
    parts: Sequence[str] = FALSE_EMAIL_PARTS,
    sep: str = "",
    hrefs: Column | None = None,
) -> Column:
    """Addresses of a page: those in its text, then its ``mailto:`` links, each once.

    ``hrefs`` are the page's links, if they have been read already.

    A page with no ``@``, written out or as a character reference, has none in
    its text, and one without ``mailto`` or a reference has no such link; the
    costly part is not evaluated for those.
    """
    nothing = F.array().cast("array<string>")
    escaped = html.contains("&#") | html.contains("&commat")
    in_text = F.when(html.contains("@") | escaped, text_emails(visible_text(html, sep)))
    in_links = F.when(
        html.contains("mailto") | html.contains("&#"),
        mailto_emails(anchor_hrefs(html) if hrefs is None else hrefs),
    )
    found = F.array_distinct(
        F.concat(F.coalesce(in_text, nothing), F.coalesce(in_links, nothing))
    )
    return drop_false(found, suffixes, parts)


def first_email(emails: Column) -> Column:
    """First address of a list, null if it is empty."""
    return F.get(emails, 0)
