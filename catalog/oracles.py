"""The same results in SQL, for DuckDB over the same tables.

Written from the rules, not from the Spark code: regular expressions in RE2
syntax, window functions and recursion. The page patterns rely on how regular
the generated pages are (double-quoted attributes, no nested anchors).
"""

from __future__ import annotations

from catalog.queries import (
    CARD_SELS,
    DOMAINS,
    EMAIL_PARTS,
    EMAIL_SUFFIXES,
    DEEP_LIMIT,
    DEEP_QUOTA,
    LIMIT,
    MANY_QUOTA,
    NETWORKS,
    SITE_PATHS,
)
from storefront.params import CONTACT_PATHS, EXPORT_COLUMNS, WHITESPACE

_WS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
_WS_CLASS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
    r"\x{205F}\x{3000}\x{FEFF}"
)
_PHONE = rf"[0-9{_WS_CLASS}\-+()]"
_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


def _trim(c: str) -> str:
    return f"trim({c}, {_WS})"


def _host(url: str) -> str:
    full = rf"lower(regexp_extract({url}, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
    return rf"regexp_replace({full}, '^www\.', '')"


def _origin(url: str) -> str:
    return rf"lower(regexp_extract({url}, '^(https?://[^/?#]*)', 1))"


def _lang(url: str) -> str:
    return rf"regexp_extract({url}, '^[^:]*://[^/]*/([a-z]+)', 1)"


def _decode(c: str) -> str:
    for pattern, text in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;?", "&")):
        c = f"regexp_replace({c}, '{pattern}', '{text}', 'g')"
    return c


def _clean(html: str) -> str:
    for pattern in (
        r"(?is)<script\b.*?</script\s*>",
        r"(?is)<style\b.*?</style\s*>",
        r"(?is)<noscript\b.*?</noscript\s*>",
        r"(?s)<!--.*?-->",
    ):
        html = f"regexp_replace({html}, '{pattern}', '', 'g')"
    return html


def _text(html: str) -> str:
    return _decode(f"regexp_replace({_clean(html)}, '<[^>]*>', '', 'g')")


def _title(html: str) -> str:
    return _trim(_decode(rf"regexp_extract({html}, '<title>([^<]*)</title>', 1)"))


def _key(url: str) -> str:
    """Normal form of the pages' URLs: a path is always there, so only the fragment goes."""
    return f"regexp_replace({url}, '#.*$', '')"


def _listed(host: str) -> str:
    tests = [f"{host} = '{d}' OR ends_with({host}, '.{d}')" for d in DOMAINS]
    return "(" + " OR ".join(tests) + ")"


def _false_email(email: str) -> str:
    tests = [f"ends_with(lower({email}), '{s}')" for s in EMAIL_SUFFIXES]
    tests += [f"contains(lower({email}), '{p}')" for p in EMAIL_PARTS]
    return "(" + " OR ".join(tests) + ")"


def _network(href: str) -> str:
    cases = (
        "WHEN " + " OR ".join(f"contains(lower({href}), '{d}')" for d in domains) + f" THEN '{n}'"
        for n, domains in NETWORKS
    )
    return "CASE " + " ".join(cases) + " END"


_LINKS = f"""
links AS (
  SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS href
  FROM (SELECT page_id, list_transform(
          regexp_extract_all({_clean('html')}, '<a href="([^"]*)"', 1), lambda x: {_decode('x')}) AS l
        FROM pages))"""

_SOCIALS = f"""
{_LINKS},
tagged AS (SELECT page_id, pos, href, {_network('href')} AS network FROM links),
socials AS (
  SELECT page_id, {', '.join(f"arg_min(href, pos) FILTER (network = '{n}') AS {n}" for n, _ in NETWORKS)}
  FROM tagged GROUP BY page_id)"""

# The pages with an address of their host in the text and one in a link.
_MAILS = f"""
contactable AS (
  SELECT page_id, html || ' <p>sales' || page_id || '@' || host || '</p> <a href="mailto:Info@'
                  || host || '?subject=x">mail</a>' AS html
  FROM (SELECT page_id, html, {_host('url')} AS host FROM pages)),
mail_hits AS (
  SELECT page_id, list_concat(
    regexp_extract_all({_text('html')}, '{_EMAIL}'),
    regexp_extract_all({_clean('html')}, '<a href="mailto:([^"?]*)', 1)) AS h FROM contactable),
mails AS (
  SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS email
  FROM (SELECT page_id, list_filter(h, lambda x, i: list_position(h, x) = i) AS l FROM mail_hits))"""


def _lines(pattern: str, name: str = "lines") -> str:
    return f"""
{name} AS (
  SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS l FROM documents))"""


def _address_test(c: str) -> str:
    return rf"""(contains({c}, ',') AND length({c}) > 10 AND length({c}) < 200
      AND NOT regexp_matches({c}, '^{_PHONE}{{7,20}}$')
      AND NOT regexp_matches({c}, '^[0-9]{{1,2}}:[0-9]{{2}}')
      AND NOT regexp_matches({c}, '^[0-9]{{1,2}}[{_WS_CLASS}]*(?i:am|pm)')
      AND NOT regexp_matches({c}, '^(?i:open|closed)'))"""


_CUSTOMERS = """
customers AS (SELECT *, 'NATION_' || c_nationkey AS city FROM customer),
cities AS (
  SELECT n_nationkey AS city_ord, n_name AS name FROM nation
  UNION ALL SELECT r_regionkey + 1000, r_name FROM region)"""

_STATUS = f"""
{_CUSTOMERS},
status AS (
  SELECT city_ord, name AS city,
         count(c_custkey) AS n_raw,
         count(DISTINCT lower(trim(c_mktsegment))) AS n_kept,
         count(c_custkey) - count(DISTINCT lower(trim(c_mktsegment))) AS n_removed,
         count(c_custkey) = 0 AS is_empty
  FROM cities LEFT JOIN customers ON name = city GROUP BY ALL)"""

_BUSINESSES = f"""
{_CUSTOMERS},
businesses AS (
  SELECT city, c_custkey,
         CASE WHEN c_acctbal > 0 THEN c_name ELSE 'N/A' END AS name,
         'https://c' || c_custkey || '.test/' AS website,
         CASE WHEN c_acctbal > 5000 THEN 'me@c' || c_custkey || '.test' ELSE '' END AS email,
         c_name || ', ' || c_mktsegment || ', ' || city || ', ' || c_name AS address
  FROM customers)"""


def _widths() -> str:
    values = {"name": "name", "website": "website", "email": "email", "address": "address"}
    selects = (
        f"SELECT city, CAST({i} AS INTEGER) AS pos, '{header}' AS header, "
        f"CAST(least(greatest(coalesce(max(length({values.get(c, chr(39) * 2)})), 0), {len(header)}) + 4, 60)"
        " AS INTEGER) AS width FROM businesses GROUP BY city"
        for i, (header, c) in enumerate(EXPORT_COLUMNS)
    )
    return f"WITH {_BUSINESSES} " + " UNION ALL ".join(selects)


_CARD_TESTS = {"^=": "starts_with", "*=": "contains"}


def _card_filter(number: int) -> str:
    _, op, want = CARD_SELS[number].attrs[0]
    test = f"{_CARD_TESTS[op]}(regexp_extract(x, 'href=\"([^\"]*)\"', 1), '{want}')"
    return f"list_filter(l, lambda x: {test})"


_CANDIDATES = f"""
{_LINKS},
anchors AS (
  SELECT page_id, unnest(l) AS a FROM (
    SELECT page_id, regexp_extract_all({_clean('html')}, '<a href="[^"]*">[^<]*</a>') AS l FROM pages)),
numbered AS (
  SELECT page_id, pos, href, {_trim(_decode("regexp_extract(a, '>([^<]*)<', 1)"))} AS value
  FROM (SELECT page_id, unnest(l) AS a, unnest(range(len(l))) AS pos FROM (
          SELECT page_id, regexp_extract_all({_clean('html')}, '<a href="[^"]*">[^<]*</a>') AS l FROM pages))
  JOIN links USING (page_id, pos)),
found AS (
  SELECT page_id, 'name' AS field, 1 AS pri, 0 AS pos,
         {_trim(_decode(r"regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS value
  FROM pages WHERE contains(html, '<h1>')
  UNION ALL
  SELECT page_id, 'name', 2, 0, {_title('html')} FROM pages WHERE contains(html, '<title>')
  UNION ALL
  SELECT page_id, 'note', 1, 0, {_trim(_decode(r"regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)"))}
  FROM pages WHERE contains(html, '<div class="ad">')
  UNION ALL
  SELECT page_id, 'link', 1, pos, value FROM numbered WHERE starts_with(href, '/th')
  UNION ALL
  SELECT page_id, 'link', 2, pos, value FROM numbered WHERE contains(href, 'e')
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1)"""

_PICKED = f"""
{_CANDIDATES},
picked AS (
  SELECT page_id, field, value FROM found WHERE value <> ''
  QUALIFY row_number() OVER (PARTITION BY page_id, field ORDER BY pri, pos) = 1)"""


def _wide_pick() -> str:
    fields = ", ".join(
        f"coalesce(max(value) FILTER (field = '{f}'), '') AS {f}" for f in ("name", "note", "link")
    )
    return (
        f"{_PICKED}, wide AS (SELECT pages.page_id, {fields} "
        "FROM pages LEFT JOIN picked USING (page_id) GROUP BY pages.page_id)"
    )


_FIELDS = ["email", *(n for n, _ in NETWORKS)]

_SITES = f"""
sites AS (
  SELECT origin, origin || '/en' AS website
  FROM (SELECT DISTINCT {_origin('url')} AS origin FROM pages)),
captured AS (
  SELECT page_id, {_origin('url')} AS origin, '/' || {_lang('url')} AS path FROM pages),
reading(path, pri) AS (
  VALUES ('/en', 0), {', '.join(f"('{p}', {i})" for i, p in enumerate(SITE_PATHS, 1))})"""

_CONTACTS = f"""
{_SITES}, {_SOCIALS}, {_MAILS},
firsts AS (SELECT page_id, arg_min(email, pos) AS email FROM mails
           WHERE NOT regexp_matches(lower(email), '\\.(png|jpg|gif|svg|webp|jpeg)$') GROUP BY page_id),
filled AS (
  SELECT origin, {', '.join(f"arg_min({f}, pri * 10000000000 + page_id) FILTER ({f} <> '') AS {f}" for f in _FIELDS)},
         bool_or(pri = 0) AS was_read
  FROM captured JOIN reading USING (path)
  LEFT JOIN socials USING (page_id) LEFT JOIN firsts USING (page_id)
  GROUP BY origin)"""


def _site_contacts() -> str:
    listed = _listed(_host("origin"))
    shown = ", ".join(
        f"CASE WHEN was_read AND NOT {listed} THEN coalesce({f}, '') ELSE '' END AS {f}"
        for f in _FIELDS
    )
    return (
        f"WITH {_CONTACTS} SELECT origin, CASE WHEN {listed} THEN '' ELSE website END AS website, "
        f"{shown} FROM sites LEFT JOIN filled USING (origin)"
    )


_OWN_CONTACTS = f"""
{_SOCIALS}, {_MAILS},
firsts AS (SELECT page_id, arg_min(email, pos) AS email FROM mails
           WHERE NOT regexp_matches(lower(email), '\\.(png|jpg|gif|svg|webp|jpeg)$') GROUP BY page_id),
keyed AS (SELECT page_id, {_key('url')} AS key FROM pages),
by_key AS (
  SELECT key, {', '.join(f"arg_min({f}, page_id) FILTER ({f} <> '') AS {f}" for f in _FIELDS)}
  FROM keyed LEFT JOIN socials USING (page_id) LEFT JOIN firsts USING (page_id) GROUP BY key)"""


def _contact_columns(listed: str) -> str:
    return ", ".join(
        f"CASE WHEN {listed} THEN '' ELSE coalesce(by_key.{f}, '') END AS {f}" for f in _FIELDS
    )


def _export() -> str:
    listed = "listed"
    headers = {c: h for h, c in EXPORT_COLUMNS}
    contact = ", ".join(
        f"CASE WHEN {listed} THEN '' ELSE coalesce(by_key.{f}, '') END AS \"{headers[f]}\""
        for f in _FIELDS
    )
    return f"""
WITH {_OWN_CONTACTS},
named AS (
  SELECT {_host('url')} AS host, page_id, url, {_title('html')} AS name FROM pages),
kept AS (
  SELECT *, {_listed('host')} AS listed FROM named WHERE name <> ''
  QUALIFY row_number() OVER (PARTITION BY host, lower(name) ORDER BY page_id) = 1)
SELECT host, page_id, name AS "Name", CASE WHEN listed THEN '' ELSE url END AS "Website",
       '' AS "Phone", '' AS "Address", {contact}
FROM kept LEFT JOIN by_key ON by_key.key = {_key('kept.url')}"""


_LISTINGS = f"""
listings AS (
  SELECT CAST(list_position(['en', 'fr', 'de', 'es'], {_lang('url')}) - 1 AS INTEGER) AS query_ord,
         CAST(page_id // 20 AS INTEGER) AS page_no, CAST(page_id % 20 AS INTEGER) AS idx,
         url, page_id, {_title('html')} AS title,
         {_trim(_decode(r"regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)"))} AS note,
         {_listed(_host('url'))} AS listed
  FROM pages)"""

_BUSINESS = """query_ord, page_no, idx, title AS name,
       CASE WHEN listed THEN '' ELSE url END AS website,
       '0' || (page_id + 100000000) AS phone, note AS address"""


def _directory_job(limit: int) -> str:
    return f"""
WITH RECURSIVE {_OWN_CONTACTS}, {_LISTINGS},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_ord, page_no ORDER BY idx) - 1 AS place FROM listings),
result_pages AS (
  SELECT query_ord, page_no, row_number() OVER (PARTITION BY query_ord ORDER BY page_no) AS step,
         list(place) FILTER (title <> '') AS places
  FROM placed GROUP BY query_ord, page_no),
reading AS (
  SELECT query_ord, page_no, step, {limit} AS quota,
         {limit} - len(list_filter(coalesce(places, []), lambda x: x < {limit})) AS remaining
  FROM result_pages WHERE step = 1
  UNION ALL
  SELECT p.query_ord, p.page_no, p.step, r.remaining,
         r.remaining - len(list_filter(coalesce(p.places, []), lambda x: x < r.remaining))
  FROM reading r JOIN result_pages p ON p.query_ord = r.query_ord AND p.step = r.step + 1
  WHERE r.remaining > 0),
kept AS (
  SELECT placed.* FROM placed JOIN reading USING (query_ord, page_no)
  WHERE title <> '' AND place < quota
  QUALIFY row_number() OVER (PARTITION BY query_ord, lower(title) ORDER BY page_no, idx) = 1)
SELECT {_BUSINESS}, {_contact_columns('listed')}
FROM kept LEFT JOIN by_key ON by_key.key = {_key('kept.url')}"""


def _directory_batch(limit: int) -> str:
    blanks = ", ".join(f"'' AS {f}" for f in _FIELDS)
    return f"""
WITH {_LISTINGS},
taken AS (
  SELECT * FROM listings WHERE title <> ''
  QUALIFY row_number() OVER (PARTITION BY query_ord ORDER BY page_no, idx) <= {limit}),
kept AS (
  SELECT * FROM taken
  QUALIFY row_number() OVER (PARTITION BY query_ord, lower(title) ORDER BY page_no, idx) = 1)
SELECT query_ord AS city_ord, (['en', 'fr', 'de', 'es'])[query_ord + 1] AS city,
       'gym in ' || city || ' (' || city || ')' AS query, * EXCLUDE (query_ord)
FROM (SELECT {_BUSINESS}, {blanks} FROM kept)"""


def _page_quota(table: str, by: str, idx: str, amount: str, least: int, limit: int) -> str:
    """Pages of 250 keys, read one after the other; rows over ``least`` count."""
    return f"""
WITH RECURSIVE placed AS (
  SELECT {by}, {idx} // 250 AS page_no, {idx}, {amount},
         row_number() OVER (PARTITION BY {by}, {idx} // 250 ORDER BY {idx}) - 1 AS place
  FROM {table}),
result_pages AS (
  SELECT {by}, page_no,
         row_number() OVER (PARTITION BY {by} ORDER BY page_no) AS step,
         list(place) FILTER ({amount} > {least}) AS places
  FROM placed GROUP BY {by}, page_no),
reading AS (
  SELECT {by}, page_no, step, {limit} AS quota,
         {limit} - len(list_filter(coalesce(places, []), lambda x: x < {limit})) AS remaining
  FROM result_pages WHERE step = 1
  UNION ALL
  SELECT p.{by}, p.page_no, p.step, r.remaining,
         r.remaining - len(list_filter(coalesce(p.places, []), lambda x: x < r.remaining))
  FROM reading r JOIN result_pages p ON p.{by} = r.{by} AND p.step = r.step + 1
  WHERE r.remaining > 0)
SELECT {by}, page_no, {idx}, {amount}
FROM placed JOIN reading USING ({by}, page_no)
WHERE {amount} > {least} AND place < quota"""


ORACLES: dict[str, str] = {
    "city_list": f"""
SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS ord, unnest(l) AS city
FROM (SELECT doc_id, list_filter(
        list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: {_trim('x')}),
        lambda x: x <> '' AND NOT starts_with(x, '#')) AS l FROM documents)""",
    "query_expand": """
SELECT c_custkey AS ord, c_name AS city,
       regexp_replace('gym in [city] ([City])', '(?i)\\[city\\]', c_name, 'g') AS query
FROM customer""",
    "sheet_names": f"""
SELECT p_partkey, left(array_to_string(list_transform(string_split(plain, ' '),
         lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' '), 31) AS sheet
FROM (SELECT p_partkey, {_trim('''replace(translate(
        ' [' || p_brand || ']: ' || p_name || '/  OF*' || p_type || '? ' || p_name,
        '[]*?/' || chr(92), ''), ':', '-')''')} AS plain
      FROM part)""",
    "phone_find": f"""
WITH {_lines(chr(92) + 'n')},
runs AS (SELECT doc_id, pos, {_trim(f"regexp_extract(line, '{_PHONE}{{7,}}')")} AS run FROM lines)
SELECT doc_id, pos, regexp_matches(run, '^{_PHONE}{{7,20}}$') AS is_phone,
       {_trim(f"regexp_extract({_trim(chr(39) + 'Open ·  ' + chr(39) + ' || run')}, '·[{_WS_CLASS}]*({_PHONE}{{7,20}})$', 1)")} AS tail,
       run
FROM runs WHERE run <> ''""",
    "phone_clean": f"""
WITH {_lines(chr(92) + 'n')}
SELECT doc_id, pos, {_trim(f"regexp_replace(line, '[^0-9+(){_WS_CLASS}-]', '', 'g')")} AS phone
FROM lines""",
    "tel_links": """
SELECT c_custkey, '+' || c_nationkey || ' (0)' || c_custkey AS phone, CAST(NULL AS VARCHAR) AS broken
FROM customer""",
    "address_clean": f"""
WITH {_lines(chr(92) + 'n')}
SELECT doc_id, pos, {_trim(f"translate({_trim('line_marked')}, chr(8294) || chr(8297), '')")} AS address
FROM (SELECT doc_id, pos, chr(8294) || ' ' || line || ' ' || chr(8297) || ' ' AS line_marked FROM lines)""",
    "address_shape": f"""
WITH {_lines('[.' + chr(92) + 'n]')},
trimmed AS (SELECT doc_id, pos, {_trim('line')} AS t,
                   translate({_trim('line')}, chr(8294) || chr(8297), '') AS u FROM lines),
tested AS (
  SELECT doc_id, pos, {_address_test('t')} AS is_address,
         contains(u, ',') AND length(u) > 5
           AND NOT regexp_matches(u, '^(?i:open|closed)') AS is_city_line
  FROM trimmed)
SELECT * FROM tested WHERE is_address OR is_city_line""",
    "url_hosts": f"SELECT page_id, {_host('url')} AS host FROM pages",
    "contact_urls": f"""
SELECT page_id, pri, path, {_origin('url')} || path AS contact_url
FROM pages, (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(CONTACT_PATHS, 1))}) AS c(pri, path)""",
    "deny_domains": f"""
SELECT page_id, CASE WHEN listed THEN '' ELSE url END AS website, listed
FROM (SELECT page_id, url, {_listed(_host('url'))} AS listed FROM pages)""",
    "deny_domain_table": f"""
WITH hosts AS (SELECT page_id, url, {_host('url')} AS host FROM pages),
domains AS (SELECT DISTINCT host AS domain FROM hosts WHERE {_lang('url')} = 'es')
SELECT page_id, EXISTS (SELECT 1 FROM domains
         WHERE host = domain OR ends_with(host, '.' || domain)) AS listed
FROM hosts""",
    "page_text": f"""
SELECT page_id, md5(t) AS digest, length(t) AS n_chars
FROM (SELECT page_id, {_text('html')} AS t FROM pages)""",
    "page_links": f"WITH {_LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM links",
    "page_emails": f"""
WITH {_MAILS}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, email
FROM mails WHERE NOT {_false_email('email')}""",
    "page_first_email": f"""
WITH {_MAILS}
SELECT pages.page_id, arg_min(email, pos) FILTER (NOT {_false_email('email')}) AS email
FROM pages LEFT JOIN mails USING (page_id) GROUP BY pages.page_id""",
    "email_filter": f"""
SELECT doc_id, CAST(pos AS INTEGER) AS pos, email, {_false_email('email')} AS is_false
FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS email
      FROM (SELECT doc_id, list_filter(h, lambda x, i: list_position(h, x) = i) AS l
            FROM (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS h FROM documents)))""",
    "page_socials": f"""
WITH {_SOCIALS}
SELECT pages.page_id, {', '.join(n for n, _ in NETWORKS)}
FROM pages LEFT JOIN socials USING (page_id)""",
    "listing_cards": f"""
WITH cards AS (
  SELECT {_host('url')} AS host, page_id,
         regexp_extract_all({_clean('html')}, '<a href="[^"]*">[^<]*</a>') AS l FROM pages),
kinds AS (SELECT host, page_id, {', '.join(f'{_card_filter(i)} AS l{i}' for i in range(len(CARD_SELS)))} FROM cards),
picked AS (
  SELECT host, page_id,
         CASE {' '.join(f'WHEN len(l{i}) > 0 THEN {i + 1}' for i in range(len(CARD_SELS)))} END AS pri,
         CASE {' '.join(f'WHEN len(l{i}) > 0 THEN l{i}' for i in range(len(CARD_SELS)))} END AS l
  FROM kinds),
ends AS (SELECT host, min(page_id) AS last FROM picked WHERE pri IS NULL GROUP BY host),
chosen AS (SELECT * FROM picked LEFT JOIN ends USING (host) WHERE last IS NULL OR page_id < last)
SELECT host, page_id, CAST(unnest(range(len(l))) AS INTEGER) AS idx, pri, unnest(l) AS card_html
FROM chosen""",
    "listing_names": f"WITH {_wide_pick()} SELECT page_id, name FROM wide WHERE name <> ''",
    "page_nodes": """
WITH tags AS (
  SELECT page_id, unnest(regexp_extract_all(
    regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<[a-z][^>]*>')) AS t FROM pages)
SELECT page_id, regexp_extract(t, '<([a-z0-9]+)', 1) AS tag, count(*) AS n,
       CAST(sum(len(regexp_extract_all(t, '[a-z]+="[^"]*"'))) AS BIGINT) AS n_attrs
FROM tags GROUP BY ALL""",
    "field_candidates": f"WITH {_CANDIDATES} SELECT page_id, field, pri, value FROM found",
    "field_pick": f"WITH {_wide_pick()} SELECT page_id, name, note, link FROM wide",
    "field_pick_rows": f"WITH {_PICKED} SELECT page_id, field, value FROM picked",
    "site_pages": f"""
WITH {_SITES}
SELECT website, pri, page_id FROM sites JOIN captured USING (origin) JOIN reading USING (path)""",
    "site_contacts": _site_contacts(),
    "contacts_off": f"""
SELECT DISTINCT {_origin('url')} AS origin, {_origin('url')} || '/en' AS website,
       {', '.join(f"'' AS {f}" for f in _FIELDS)}
FROM pages""",
    "dedup_names": f"""
SELECT city, page_id, name
FROM (SELECT {_lang('url')} AS city, page_id, {_decode(r"regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS name
      FROM pages)
WHERE {_trim('name')} <> ''
QUALIFY row_number() OVER (PARTITION BY city, {_trim('lower(name)')} ORDER BY page_id) = 1""",
    "dedup_parts": """
SELECT p_brand AS city, p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name
FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) = 1""",
    "dedup_counts": """
SELECT p_brand AS city, count(*) AS n_raw, count(DISTINCT lower(p_name)) AS n_kept,
       count(*) - count(DISTINCT lower(p_name)) AS n_removed
FROM part GROUP BY p_brand""",
    "limit_per_city": f"""
SELECT c_nationkey, c_custkey, c_name FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= {LIMIT}""",
    "page_quota_limit": _page_quota("customer", "c_nationkey", "c_custkey", "c_acctbal", 5000, LIMIT),
    "limit_deep": f"""
SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) <= {DEEP_LIMIT}""",
    "page_quota_deep": _page_quota("orders", "o_orderstatus", "o_orderkey", "o_totalprice", 150000, DEEP_QUOTA),
    "page_quota_many": _page_quota("orders", "o_orderstatus", "o_orderkey", "o_totalprice", 10000, MANY_QUOTA),
    "batch_tables": """
WITH cities AS (
  SELECT n_nationkey AS city_ord, 'NATION_' || n_nationkey AS city FROM nation
  UNION ALL SELECT r_regionkey + 1000, r_name FROM region),
rows AS (
  SELECT c_nationkey AS city_ord, c_custkey, CASE WHEN c_acctbal > 0 THEN c_name ELSE 'N/A' END AS "Name",
         'https://c' || c_custkey || '.test/' AS "Website",
         CASE WHEN c_acctbal > 5000 THEN 'me@c' || c_custkey || '.test' ELSE '' END AS "Email",
         concat_ws(', ', c_name, c_mktsegment, 'NATION_' || c_nationkey, c_name) AS "Address"
  FROM customer)
SELECT CAST(cities.city_ord AS INTEGER) AS city_ord, city,
       array_to_string(list_transform(string_split(city, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS sheet,
       count(c_custkey) OVER (PARTITION BY cities.city_ord) AS n,
       c_custkey, "Name", "Website", "Email", "Address"
FROM cities LEFT JOIN rows ON rows.city_ord = cities.city_ord""",
    "city_order": f"""
WITH {_CUSTOMERS}
SELECT city_ord, name AS city, c_custkey, c_name
FROM cities LEFT JOIN customers ON name = city""",
    "sheet_manifest": f"""
WITH {_CUSTOMERS}
SELECT city_ord, name AS city, array_to_string(list_transform(string_split(name, ' '),
         lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS sheet,
       count(c_custkey) AS n, false AS clash
FROM cities LEFT JOIN customers ON name = city GROUP BY ALL""",
    "run_status": f"WITH {_STATUS} SELECT * FROM status",
    "batch_totals": f"""
WITH {_STATUS}
SELECT CAST(sum(n_kept) AS BIGINT) AS n_rows, CAST(sum(n_removed) AS BIGINT) AS n_removed,
       count(*) AS n_cities, count(*) FILTER (is_empty) AS n_empty
FROM status""",
    "column_widths": _widths(),
    "export_links": f"""
WITH {_BUSINESSES}
SELECT c_custkey, website AS website_link,
       CASE WHEN email <> '' THEN 'mailto:' || email END AS email_link
FROM businesses""",
    "export_rows": _export(),
    "listing_rules": """
WITH listings AS (
  SELECT CAST(page_id AS INTEGER) AS page_no, CAST(unnest(range(3)) AS INTEGER) AS idx FROM pages),
keyed AS (SELECT *, page_no * 3 + idx AS key FROM listings)
SELECT 0 AS query_ord, page_no, idx,
       'n' || (['1', '5', '6', '7'])[(page_no + idx) % 4 + 1] || ' ' || key AS name,
       'https://w' || ((page_no + idx) % 3 + 1) || '.test/' || key AS website,
       (['1000000', '+2000000', '3000000', '4000000', '5000000'])[(page_no + idx * 2) % 5 + 1] || key AS phone,
       (['1 Main St, ', '2 Long Road, ', '3 Pune, India ', '4 Hill, '])[(page_no // 4 + idx) % 4 + 1] || key AS address
FROM keyed""",
    "directory_job": _directory_job(30),
    "directory_batch": _directory_batch(25),
}
