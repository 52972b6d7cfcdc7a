from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storefront.functions import urls
from storefront.operators.sites import blank_listed, contact_url_rows, flag_listed
from storefront.params import LISTED_DOMAINS

CASES = {
    "https://www.facebook.com/x": ("facebook.com", True),
    "https://m.facebook.com/x": ("m.facebook.com", True),
    "https://notfacebook.com": ("notfacebook.com", False),
    "https://facebook.com.evil.test": ("facebook.com.evil.test", False),
    "https://netflix.com": ("netflix.com", False),
    "http://my_shop.example.com/a?b=1|2": ("my_shop.example.com", False),
    "": ("", False),
    "foo": ("", False),
    "HTTPS://WWW.X.COM": ("x.com", True),
    "http://user:pw@google.com:8080/q": ("google.com", True),
    "http://google.com@evil.test/": ("evil.test", False),
    "http:\\\\facebook.com\\a": ("facebook.com", True),
    "https://x.com:abc/": ("", False),
    " https://t.me/a ": ("t.me", True),
    "mailto:a@facebook.com": ("", False),
    "https://www.www.x.com/": ("www.x.com", True),
}


def test_host_and_domain_test(evaluate):
    hosts = evaluate(list(CASES), urls.url_host)
    assert dict(zip(CASES, hosts)) == {u: h for u, (h, _) in CASES.items()}
    listed = evaluate([*CASES, None], lambda c: urls.is_listed(c, LISTED_DOMAINS))
    assert dict(zip(CASES, listed)) == {u: flag for u, (_, flag) in CASES.items()}
    assert listed[-1] is False


def test_domain_table_gives_the_same_flags(spark):
    rows = spark.createDataFrame([(u,) for u in CASES], "url string").repartition(3)
    domains = spark.createDataFrame([(d,) for d in LISTED_DOMAINS], "domain string")
    flags = {r.url: r.listed for r in flag_listed(rows, "url", domains).collect()}
    assert flags == {u: flag for u, (_, flag) in CASES.items()}


def test_listed_website_is_blanked_and_the_row_stays(spark):
    rows = spark.createDataFrame([(1, "https://fb.com/a"), (2, "https://a.test/"), (3, "")], "i int, website string")
    out = sorted(tuple(r) for r in blank_listed(rows).collect())
    assert out == [(1, ""), (2, "https://a.test/"), (3, "")]


labels = st.sampled_from(["a", "b", "www", "com", "x", "facebook"])
hosts = st.lists(labels, min_size=1, max_size=4).map(".".join)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(hosts, min_size=1, max_size=20), st.lists(hosts, min_size=1, max_size=5))
def test_suffix_look_up_equals_endswith(evaluate, names, domains):
    listed = evaluate([f"https://{h}/p" for h in names], lambda c: urls.is_listed(c, domains))
    bare = [h[4:] if h.startswith("www.") else h for h in names]
    assert listed == [any(h == d or h.endswith("." + d) for d in domains) for h in bare]


def test_normal_form(evaluate):
    texts = [
        "HTTP://User:pw@HOST.com:80/P?q#f", "https://h.com", "https://h.com:8443?x", "not a url", "https://h.com:443/a",
    ]
    assert evaluate(texts, urls.url_href) == [
        "http://User:pw@host.com/P?q#f", "https://h.com/", "https://h.com:8443/?x", "not a url", "https://h.com/a",
    ]
    assert evaluate(texts, urls.url_key) == [
        "http://User:pw@host.com/P?q", "https://h.com/", "https://h.com:8443/?x", None, "https://h.com/a",
    ]
    assert evaluate(texts, urls.url_origin) == [
        "http://User:pw@host.com", "https://h.com", "https://h.com:8443", None, "https://h.com",
    ]


def test_join(evaluate):
    join = lambda c: urls.url_join(F.lit("http://B.com/d/p?x=1#f"), c)
    hrefs = ["/a", "b.html", "?y", "#z", "", "//c.test/q", "HTTPS://D.test", "mailto:a@b", None]
    assert evaluate(hrefs, join) == [
        "http://b.com/a",
        "http://b.com/d/b.html",
        "http://b.com/d/p?y",
        "http://b.com/d/p?x=1#z",
        "http://b.com/d/p?x=1",
        "http://c.test/q",
        "https://d.test/",
        "mailto:a@b",
        None,
    ]
    assert evaluate(["/a"], lambda c: urls.url_join(F.lit(None).cast("string"), c)) == ["/a"]


def test_dot_segments_and_blanks(evaluate):
    join = lambda c: urls.url_join(F.lit("http://b.test/d/e/p?x=/../1"), c)
    hrefs = ["../contact", "./c", "..", ".", "../../../up", "/a/./b/../c/", "a b?c d", "/x/..", "%2e%2E/q?y=../z", "...", "/.well", ""]
    assert evaluate(hrefs, join) == [
        "http://b.test/d/contact",
        "http://b.test/d/e/c",
        "http://b.test/d/",
        "http://b.test/d/e/",
        "http://b.test/up",
        "http://b.test/a/c/",
        "http://b.test/d/e/a%20b?c%20d",
        "http://b.test/",
        "http://b.test/d/q?y=../z",
        "http://b.test/d/e/...",
        "http://b.test/.well",
        "http://b.test/d/e/p?x=/../1",
    ]


def test_contact_urls(spark):
    sites = spark.createDataFrame([("https://s.test/deep/p?q=1",), ("foo",), (None,)], "website string")
    rows = sorted((r.pri, r.contact_url) for r in contact_url_rows(sites).collect())
    assert rows == [
        (1, "https://s.test/contact"),
        (2, "https://s.test/contact-us"),
        (3, "https://s.test/about"),
        (4, "https://s.test/about-us"),
    ]
