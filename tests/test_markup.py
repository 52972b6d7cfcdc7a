import html as stdlib_html
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from storefront.functions import emails, entities, markup
from storefront.operators import pages as page_ops

HREF_PAGE = (
    "<a title=\"href=x\" href='/u?a=1&amp;b=2&copy=3'>k</a><a href>e</a><a href=\"\">e</a>"
    "<a name=x>n</a><A HREF=/unq/>q</a><!-- <a href=\"c\"> --><script>\"<a href='s'>\"</script>"
    "<img alt=\"<a href=y>\"><abbr href=z><a data-href=\"no\" class=\"x\"href=\"/adj\">"
    "<noscript><a href=/in-noscript>n</a></noscript><title><a href=/t></title>"
)


def test_visible_text(evaluate):
    pages = {
        "<p>x &amp y &amp;quot; z</p>": "x & y &quot; z",
        "<td>a@b.com</td><td>Tel</td>": "a@b.comTel",
        "<script>var t=\"</p>\";</script>a<style>p{}</style>b<noscript>c</noscript>d": "abd",
        "<!-- x > y -->a<!---->b<!-->c": "abc",
        "a < b and c > d <3": "a < b and c > d <3",
        "<!DOCTYPE html><p title='1 > 0' data-x=\"</p>\">t</p x=\"a>b\">!": "t!",
        "<p>don't</p><p>x</p>": "don'tx",
        "a<script>never closed": "a",
        "a<!-- never closed": "a",
        "a<p class=\"never closed": "a",
        "<scripty>a</scripty>": "a",
        "<title lang=x>a <b> &amp; c</title><p>d</p>": "a <b> & cd",
        "<textarea><!-- x --></textarea>y<title>open": "<!-- x -->yopen",
        "<SCRIPT x=\"</script>\">no</SCRIPT >yes": "yes",
        None: None,
        "": "",
    }
    assert evaluate(list(pages), markup.visible_text) == list(pages.values())


def test_visible_text_with_a_separator(evaluate):
    page = "<td>a@b.com</td><td>Tel</td>"
    assert evaluate([page], lambda c: markup.visible_text(c, " ")) == [" a@b.com  Tel "]
    assert evaluate(["a<br>b"], lambda c: markup.visible_text(c, "$1\\")) == ["a$1\\b"]
    assert evaluate(["<title>a@b.com</title>Tel"], lambda c: markup.visible_text(c, " ")) == [" a@b.com Tel"]


def test_entities(evaluate):
    texts = [
        "&lt;&gt;&quot;&copy;&middot;&nbsp;.", "&#64;&#x40;&#X1F600;", "&#128;&#0;&#xD800;&#99999999;",
        "&commat;&period;", "&notit; &notin;", "&bogus; & &", "&amp;lt;", "&copyx", "&#;&#x;",
    ]
    assert evaluate(texts, entities.decode_entities) == [stdlib_html.unescape(t) for t in texts]
    in_attribute = lambda c: entities.decode_entities(c, in_attribute=True)
    assert evaluate(["?a=1&copy=2", "&copyx", "&copy", "&copy;x"], in_attribute) == [
        "?a=1&copy=2", "&copyx", "©", "©x",
    ]


def test_all_entity_names_are_opt_in(evaluate):
    names = sorted(entities.ALL_NAMES)[::40]
    texts = [f"x &{n} y" for n in names]
    every = lambda c: entities.decode_entities(c, names=entities.ALL_NAMES)
    assert evaluate(texts, every) == [stdlib_html.unescape(t) for t in texts]
    assert evaluate(texts, entities.decode_entities) == [stdlib_html.unescape(t) for t in texts]


def test_anchor_hrefs(evaluate):
    found = ["/u?a=1&b=2&copy=3", "", "", "/unq/", "/adj"]
    assert evaluate([HREF_PAGE, None, "<p>"], markup.anchor_hrefs) == [found, None, []]


def test_tag_attribute(evaluate):
    tags = ['a class="x y" id=1>', "a CLASS=z>", "a class>", "a data-class=q>", "a title='class=\"n\"'>"]
    assert evaluate(tags, lambda c: markup.tag_attribute(c, "class")) == ["x y", "z", "", None, None]


def test_title(evaluate):
    pages = ["<head><title lang=en>A &amp; <b> B</title>", "<p>none</p>", "<TITLE>x</TITLE><title>y</title>"]
    assert evaluate(pages, markup.title_text) == ["A & <b> B", "", "x"]


EMAIL_CASES = {
    '<p>a@b.com</p> <a href="mailto:c@d.org?subject=x">m</a>': ["a@b.com", "c@d.org"],
    '<p>a@b.com</p><a href="mailto:c@d.org?subject=x">m</a>': ["a@b.comm", "c@d.org"],
    '<a href="mailto:c@d.org">m</a> <p>a@b.com</p>': ["a@b.com", "c@d.org"],
    "<td>a@b.com</td><td>Tel</td>": ["a@b.comTel"],
    '<script>x="s@t.com"</script><style>s@t.com</style><noscript>s@t.com<a href="mailto:n@s.com">x</a></noscript>': [],
    "<!-- h@i.com -->": [],
    "logo@2x.png, u@example.com, k@o1.ingest.sentry.io": [],
    "A@b.com a@b.com": ["A@b.com", "a@b.com"],
    "a&#64;b.com": ["a@b.com"],
    "a&commat;b.com": ["a@b.com"],
    '<a href="mailto:a@x.com,b@y.com">m</a>': ["a@x.com,b@y.com"],
    '<a href="mailto:  ?x">m</a><a href="MAILTO:a@b.com">m</a>': [],
    '<a href="&#109;ailto:not-checked">m</a>': ["not-checked"],
    '<a href="mailto:a@b.com"></a><a href="mailto:a@b.com">x</a> a@b.com': ["a@b.com"],
    "a@b.com1@d.org": ["a@b.com", "1@d.org"],
    "a@b.com@c.org": ["a@b.com"],
    "x@WIXPRESS.COM PIC@a.JPEG ok@a.jpeg.com": ["ok@a.jpeg.com"],
    "no address": [],
    "": [],
    None: [],
}


def test_emails(evaluate):
    assert evaluate(list(EMAIL_CASES), emails.html_emails) == list(EMAIL_CASES.values())
    first = lambda c: emails.first_email(emails.html_emails(c))
    assert evaluate(list(EMAIL_CASES), first) == [v[0] if v else None for v in EMAIL_CASES.values()]


def test_email_separator_and_lists(evaluate):
    page = "<td>a@b.com</td><td>Tel</td> u@example.com"
    assert evaluate([page], lambda c: emails.html_emails(c, sep=" ")) == [["a@b.com"]]
    assert evaluate([page], lambda c: emails.html_emails(c, (), (), " ")) == [["a@b.com", "u@example.com"]]
    assert evaluate([page], lambda c: emails.html_emails(c, ("TEL",), ("EXAMPLE",))) == [[]]


SOCIAL_CASES = {
    ("https://fb.com/a", "https://facebook.com/b"): ("https://fb.com/a", None, None, None),
    ("https://instagram.com/?u=facebook.com",): ("https://instagram.com/?u=facebook.com", None, None, None),
    ("https://netflix.com",): (None, None, "https://netflix.com", None),
    ("/about",): (None, None, None, None),
    ("https://X.com/A", "https://www.LinkedIn.com/in/B", "https://instagram.com/c"): (
        None, "https://instagram.com/c", "https://X.com/A", "https://www.LinkedIn.com/in/B",
    ),
    (): (None, None, None, None),
}


@pytest.mark.parametrize("match", ["substring", "host"])
def test_socials(spark, match):
    html = ["".join(f'<a href="{h}">x</a>' for h in hrefs) for hrefs in SOCIAL_CASES]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id int, html string")
    found = {r.page_id: tuple(r)[1:] for r in page_ops.page_socials(pages, match=match).collect()}
    expected = dict(enumerate(SOCIAL_CASES.values()))
    if match == "host":
        expected[1] = (None, "https://instagram.com/?u=facebook.com", None, None)
        expected[2] = (None, None, None, None)
    assert found == expected


HOSTILE = {
    "one huge tag": ("<" + "b " * 200_000 + ">t", "t"),
    "huge tag, unclosed": ("<" + "b " * 200_000, ""),
    "scripts, unclosed": ("<script " * 20_000, ""),
    "comments, unclosed": ("<!--" * 20_000, ""),
    "quotes, unclosed": ("<a b=\"" * 20_000, ""),
    "one long word": ("a" * 400_000, "a" * 400_000),
    "many at signs": (("a" * 50 + "@") * 8_000, ("a" * 50 + "@") * 8_000),
    "late href": ("<a " + "b " * 200_000 + 'href="/z">x', "x"),
    "ampersands": ("&" * 50_000, "&" * 50_000),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages(evaluate, name):
    page, expected = HOSTILE[name]
    assert evaluate([page], markup.visible_text) == [expected]
    assert evaluate([page], lambda c: F.size(markup.anchor_hrefs(c))) == [1 if name == "late href" else 0]
    assert evaluate([page], lambda c: F.size(emails.html_emails(c))) == [0]


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hrefs, self.skipping = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.skipping += tag in ("script", "style", "noscript")
        if tag == "a" and "href" in dict(attrs):
            self.hrefs.append(dict(attrs)["href"] or "")

    def handle_endtag(self, tag):
        self.skipping -= tag in ("script", "style", "noscript") and self.skipping > 0

    def handle_data(self, data):
        if not self.skipping:
            self.parts.append(data)


def test_patterns_agree_with_a_parser_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").repartition(8)
    rows = pages.select(
        "html", markup.visible_text(F.col("html")).alias("t"), markup.anchor_hrefs(F.col("html")).alias("l")
    ).collect()
    assert len(rows) == 2500
    for row in rows:
        parser = _Text()
        parser.feed(row.html)
        parser.close()
        assert row.t == "".join(parser.parts)
        assert row.l == parser.hrefs
