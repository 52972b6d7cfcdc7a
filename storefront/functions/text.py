"""Cleaning and recognising names, phones and addresses: Column in, Column out."""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

from storefront.params import BLANK_SHEET, SHEET_NAME_LENGTH, WHITESPACE, WHITESPACE_CLASS

_S = f"[{WHITESPACE_CLASS}]"
_PHONE_ASCII = "0123456789+()-" + "".join(c for c in WHITESPACE if c.isascii())
_WIDE_SPACE = "".join(c for c in WHITESPACE if not c.isascii())
# A digit, white space or one of "- + ( )". Most characters of a text are letters;
# a listed set is one table look-up, so they are ruled out by it before the ranges.
_PHONE = rf"[[^{ascii_letters}]&&[0-9{WHITESPACE_CLASS}\-+()]]"
_NOT_PHONE_ASCII = "".join(rf"\x{i:02X}" for i in range(128) if chr(i) not in _PHONE_ASCII)
_MARKS = "\u2066\u2069"


def utrim(c: Column) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.btrim(c, F.lit(WHITESPACE))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, the unit the length rules are stated in."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def name_key(name: Column) -> Column:
    """Names that differ in case or outer white space only share this key."""
    return utrim(F.lower(name))


def expand_template(template: Column | str, city: Column) -> Column:
    """Put the city in place of every ``[city]``, whatever its case.

    Splitting and joining takes the city literally, where a regex replacement
    would read ``$1`` or a backslash in it.
    """
    template = F.lit(template) if isinstance(template, str) else template
    return F.call_function("array_join", F.split(template, r"(?i)\[city\]"), city)


def sheet_name(city: Column) -> Column:
    """Name of a city's output table."""
    kept = utrim(F.replace(F.regexp_replace(city, r"[\[\]*?/\\]", ""), F.lit(":"), F.lit("-")))
    words = F.transform(
        F.split(kept, " "),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))),
    )
    cut = F.substring(F.array_join(words, " "), 1, SHEET_NAME_LENGTH)
    return F.when(cut == "", BLANK_SHEET).otherwise(cut)


def phone_clean(c: Column) -> Column:
    """Keep digits, ``+ ( ) -`` and white space."""
    other = rf"(?:[{_NOT_PHONE_ASCII}]++|(?![{_WIDE_SPACE}])[^\x00-\x7F])+"
    return utrim(F.regexp_replace(c, other, ""))


def is_phone(c: Column) -> Column:
    """The whole text is 7 to 20 phone characters."""
    return c.rlike(rf"^{_PHONE}{{7,20}}\z")


def phone_tail(c: Column) -> Column:
    """Phone after the last ``·`` of a text, blank if there is none."""
    return utrim(F.regexp_extract(c, rf"·{_S}*({_PHONE}{{7,20}})\z", 1))


def phone_run(c: Column) -> Column:
    """First run of 7 or more phone characters, blank if there is none."""
    return utrim(F.regexp_extract(c, rf"{_PHONE}{{7,}}", 0))


def address_clean(c: Column) -> Column:
    """Drop a leading ``Address:`` label, then the direction isolate marks."""
    unlabelled = utrim(F.regexp_replace(c, rf"^(?i:Address):{_S}*", ""))
    return utrim(strip_marks(unlabelled))


def strip_marks(c: Column) -> Column:
    """Drop the direction isolate marks."""
    return F.translate(c, _MARKS, "")


def _is_opening_state(c: Column) -> Column:
    return c.rlike(r"^(?i:Open|Closed)")


def is_address(c: Column) -> Column:
    """Reads like a street address: a comma, a sensible length, no phone, clock or opening state."""
    length = utf16_length(c)
    return (
        c.contains(",")
        & (length > 10)
        & (length < 200)
        & ~is_phone(c)
        & ~c.rlike(rf"^[0-9]{{1,2}}(?::[0-9]{{2}}|{_S}*(?i:am|pm))")
        & ~_is_opening_state(c)
    )


def is_city_line(c: Column) -> Column:
    """Reads like ``town, state``; expects the direction marks to be gone."""
    return c.contains(",") & (utf16_length(c) > 5) & ~_is_opening_state(c)
