"""Patterns written for linear time against the plain rule, on random texts."""

import html as stdlib_html
import random
import re

from pyspark.sql import functions as F

from storefront.functions import emails, entities, markup, text
from storefront.operators.nodes import Interest, parse_nodes
from storefront.params import WHITESPACE

PLAIN_EMAIL = re.compile(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")


def _texts(seed, pieces, n=3000, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randint(0, longest))) for _ in range(n)]


def test_addresses_in_text(evaluate):
    texts = _texts(1, ["a", "B", "7", ".", "@", "@", "-", "_", "%", " ", "com", "x.org", "é", "\n", "@b.co"])
    found = evaluate(texts, emails.text_emails)
    assert found == [PLAIN_EMAIL.findall(t) for t in texts]
    assert sum(len(f) for f in found) > 500


def test_first_positions_are_kept(evaluate):
    texts = _texts(2, ["a@b.co ", "A@b.co ", "c@d.org ", "x ", "c@d.org, "])
    found = evaluate(texts, lambda c: F.array_distinct(emails.text_emails(c)))
    assert found == [list(dict.fromkeys(PLAIN_EMAIL.findall(t))) for t in texts]


def test_character_references(evaluate):
    pieces = ["&", "#", "x", "X", "4", "1", "0", "amp", "lt", "not", "in", "copy", ";", ";", "=", " ", "é", "AMP", "d8", "80"]
    texts = _texts(3, pieces)
    every = lambda c: entities.decode_entities(c, names=entities.ALL_NAMES)
    # The standard library drops references to some control and non-characters.
    dropped = re.compile(r"&#(?:[xX]0*(?:[0-9a-fA-F]{1,2}|[fF]{2}[0-9a-fA-F]{2}|[fF][dD][dDeE][0-9a-fA-F]|[0-9a-fA-F]{5,})|0*[0-9]{1,2}|0*1[0-5][0-9]|[0-9]{5,})(?![0-9a-fA-F])")
    kept = [t for t in texts if not dropped.search(t)]
    assert len(kept) > 2000
    assert evaluate(kept, every) == [stdlib_html.unescape(t) for t in kept]


def test_phone_patterns(evaluate):
    phone = f"[0-9{re.escape(WHITESPACE)}\\-+()]"
    texts = _texts(4, ["0", "12345", "1234567", " ", " ", "-", "+", "(", ")", "a", "·", "é", "\n", "٠", "/"], longest=8)
    runs = [m[0].strip(WHITESPACE) if (m := re.search(phone + "{7,}", t)) else "" for t in texts]
    assert evaluate(texts, text.phone_run) == runs
    assert evaluate(texts, text.is_phone) == [bool(re.fullmatch(phone + "{7,20}", t)) for t in texts]
    tails = [re.search(f"·[{re.escape(WHITESPACE)}]*({phone}{{7,20}})\\Z", t) for t in texts]
    assert evaluate(texts, text.phone_tail) == [m[1].strip(WHITESPACE) if m else "" for m in tails]
    cleaned = [re.sub(f"[^0-9{re.escape(WHITESPACE)}\\-+()]", "", t).strip(WHITESPACE) for t in texts]
    assert evaluate(texts, text.phone_clean) == cleaned


MARKUP = [
    "<a href=/u>", "<a class='x' HREF=\"/v>w\">", "</a>", "<p>", "</p>", "<!-- ", "-->", "<script>", "</script>",
    "<title>", "</title>", "t", " ", "&amp;", "<", ">", "'", '"', "=", "<br/>", "<div class=x>", "</div>", "<!doctype x>", "</ x>",
]


def test_anchors_and_start_tags_agree_with_the_node_stage(evaluate):
    pages = _texts(5, MARKUP, n=2000, longest=18)
    nodes = [parse_nodes(p, Interest())[1] for p in pages]
    hrefs = [[v for n in found if n["tag"] == "a" for k, v in n["attrs"] if k == "href"] for found in nodes]
    assert evaluate(pages, markup.anchor_hrefs) == hrefs
    assert evaluate(pages, lambda c: F.size(markup.start_tags(c))) == [len(found) for found in nodes]


def test_ranges_nest():
    for page in _texts(6, MARKUP, n=500, longest=30):
        text, nodes = parse_nodes(page, Interest())
        assert [n["node"] for n in nodes] == list(range(len(nodes)))
        for n in nodes:
            assert n["node"] <= n["last"] < len(nodes) and n["beg"] <= n["end"] <= len(page)
            assert text[n["head"] : n["tail"]].decode() == text[n["from"] : n["to"]].decode().strip(WHITESPACE)
            for m in nodes[n["node"] + 1 : n["last"] + 1]:
                assert m["last"] <= n["last"] and m["end"] <= n["end"] and n["from"] <= m["from"] <= m["to"] <= n["to"]
