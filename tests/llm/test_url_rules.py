import random
import re

from storefront.llm.urls import GlobRule, HostRule, ShiftAnd, judge_urls


def test_automaton_against_regular_expressions():
    rng = random.Random(3)
    globs = ["".join(rng.choice("ab*") for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    globs += ["a" * 200 + "*b", "*" + "ab" * 100, "", "*", "**a**"]  # over several words
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))) for _ in range(200)]
    texts += ["a" * 200 + "xxb", "c" + "ab" * 100, "a" * 5000]
    fits = ShiftAnd(globs).match([t.encode() for t in texts])
    for text, row in zip(texts, fits):
        assert row.tolist() == [re.fullmatch(re.escape(g).replace(r"\*", ".*"), text, re.S) is not None for g in globs]
    assert ShiftAnd(globs).match([]).shape == (0, len(globs))


def test_rules(spark):
    urls = {
        "https://WWW.Example.ORG/es/a?x#y": ("www.example.org", "/es/a", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://a.com/de/x.zip": ("a.com", "/de/x.zip", "com/de/", "block"),
        "http://a.com/x.zip": ("a.com", "/x.zip", None, "block"),
        "http://evil.net/.org/": ("evil.net", "/.org/", None, "allow"),
        "http://x.net?a.org/": ("x.net", "", None, "allow"),
        "http://é.com/fr/ü": ("é.com", "/fr/ü", "com/fr/", "allow"),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://c.org/d": ("b:", "//c.org/d", None, "allow"),
        "http://x.org/" + "y" * 30_000: ("x.org", "/" + "y" * 30_000, "org/", "allow"),
    }
    rows = [(n, u, "h", 1) for n, u in enumerate(urls)] + [(0, next(iter(urls)), "h", 1), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict int")
    got = judge_urls(pages).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    for n, want in enumerate(urls.values()):
        assert by_id[n] == want
    assert judge_urls(pages.limit(0)).count() == 0


def test_many_rules(spark):
    hosts = [HostRule("block", f"site{n}.test", f"/p{n}/") for n in range(300)]
    pages = spark.createDataFrame([(n, f"http://w.site{n}.test/p{n}/q") for n in range(310)], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in judge_urls(pages, hosts, [GlobRule("block", "*#/p305*")]).collect()}
    assert all(got[n] == f"site{n}.test/p{n}/" for n in range(300)) and got[305] is None
