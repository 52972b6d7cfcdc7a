"""Fixed values and argument checks.

Every list here is a default argument of some operator; none is read from
inside an operator, so a caller can always pass their own.
"""

from __future__ import annotations

import re

# --- Fixed values -----------------------------------------------------------

# The characters a browser's trim() and \s take as white space.
WHITESPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as the inside of a regex character class (Java and RE2 syntax).
WHITESPACE_CLASS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
    r"\x{205F}\x{3000}\x{FEFF}"
)

# Sites that are never a business's own website.
LISTED_DOMAINS = (
    "facebook.com",
    "fb.com",
    "instagram.com",
    "twitter.com",
    "x.com",
    "linkedin.com",
    "youtube.com",
    "youtu.be",
    "tiktok.com",
    "pinterest.com",
    "snapchat.com",
    "reddit.com",
    "tumblr.com",
    "whatsapp.com",
    "telegram.org",
    "t.me",
    "discord.com",
    "discord.gg",
    "threads.net",
    "yelp.com",
    "tripadvisor.com",
    "tripadvisor.in",
    "zomato.com",
    "swiggy.com",
    "justdial.com",
    "indiamart.com",
    "google.com",
    "maps.google.com",
    "play.google.com",
    "apps.apple.com",
    "apple.com",
    "wikipedia.org",
    "booking.com",
    "makemytrip.com",
    "goibibo.com",
)

# E-mail shaped strings that are not addresses of the business.
FALSE_EMAIL_SUFFIXES = (".png", ".jpg", ".gif", ".svg", ".webp", ".jpeg")
FALSE_EMAIL_PARTS = ("example.com", "sentry.io", "wixpress.com", "schema.org")

# E-mail address pattern.
EMAIL_LOCAL = r"a-zA-Z0-9._%+\-"
EMAIL_DOMAIN = r"[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"

# Social networks in the order they are tested: output column, domains.
NETWORKS = (
    ("facebook", ("facebook.com", "fb.com")),
    ("instagram", ("instagram.com",)),
    ("twitter", ("twitter.com", "x.com")),
    ("linkedin", ("linkedin.com",)),
)

# Pages of a site that usually carry contact data, in the order they are read.
CONTACT_PATHS = ("/contact", "/contact-us", "/about", "/about-us")

# Output table: header and column, in order.
EXPORT_COLUMNS = (
    ("Name", "name"),
    ("Website", "website"),
    ("Phone", "phone"),
    ("Email", "email"),
    ("Address", "address"),
    ("Facebook", "facebook"),
    ("Instagram", "instagram"),
    ("Twitter/X", "twitter"),
    ("LinkedIn", "linkedin"),
)

# Output names and sizes.
BLANK_NAME = "N/A"
BLANK_SHEET = "Sheet"
SHEET_NAME_LENGTH = 31
COLUMN_PADDING = 4
COLUMN_MAX_WIDTH = 60

DEFAULT_LIMIT = 10
PLACEHOLDER = "[city]"

# --- Derived names ----------------------------------------------------------

BUSINESS_FIELDS = tuple(column for _, column in EXPORT_COLUMNS)
SOCIAL_FIELDS = tuple(network for network, _ in NETWORKS)


# --- Argument checks --------------------------------------------------------


def check_query(query: str) -> str:
    """The query without surrounding white space; it must not be blank."""
    if not isinstance(query, str) or not query.strip(WHITESPACE):
        raise ValueError("query must be a non-blank string")
    return query.strip(WHITESPACE)


def check_template(template: str) -> str:
    """A query for a list of cities; it must hold ``[city]`` in lower case."""
    template = check_query(template)
    if PLACEHOLDER not in template:
        raise ValueError(f"query for a city list must contain {PLACEHOLDER}")
    return template


def check_limit(limit: int | str) -> int:
    """A whole number of at least 1 (leading digits of a string count)."""
    digits = re.match(r"\s*([+-]?\d+)", str(limit))
    if digits is None or int(digits[1]) < 1:
        raise ValueError("limit must be a positive integer")
    return int(digits[1])
