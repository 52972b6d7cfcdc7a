import pytest
from pyspark.sql import functions as F

from storefront.functions.binding import settled
from storefront.operators import nodes as node_ops
from storefront.operators.cards import has_card, listing_cards, listings_of, pages_in_result
from storefront.operators.nodes import Interest, Sel, html_nodes, interest_of, node_text, parse_nodes, select_nodes
from storefront.operators.rules import LISTING_RULES, listing_fields, pick_first_rows, rules_interest, tel_value

CARD = (
    '<div class="VkpGBb"><div class="dbg0pd" role="heading"><span class="OSrXXb">Cafe A</span></div></div>'
)
PANEL = """<div class="OYzgjc"><a class="n1obkb" href="https://cafe-a.test/"><span class="aSAiSd">Website</span></a>
<a class="Od1FEc n1obkb" data-phone-number="09100000000" aria-label="Call">x</a>
<div class="C9waJd ">091000 00000</div>
<div class="C9waJd y7xX3d"><div><span>1 Main St, Town</span></div></div></div>"""
SCHEMA = "query_ord int, page_no int, idx int, url string, card_html string, panel_html string"
URL = "https://maps.test/search?q=x"


@pytest.fixture(scope="module")
def fields(spark):
    """name, website, phone, address of (card, panel) or (card, panel, idx) cases."""

    def run(*cases):
        rows = [(0, 0, i, URL, c[0], c[1]) for i, c in enumerate(cases)]
        listings = spark.createDataFrame(rows, SCHEMA).repartition(3)
        out = listing_fields(listings, ["query_ord", "page_no", "idx"])
        assert out.columns == ["query_ord", "page_no", "idx", "name", "website", "phone", "address"]
        return [tuple(r)[3:] for r in out.orderBy("idx").collect()]

    return run


def _column(results, i):
    return [r[i] for r in results]


def test_full_listing(fields):
    assert fields((CARD, PANEL), (None, None)) == [
        ("Cafe A", "https://cafe-a.test/", "09100000000", "1 Main St, Town"),
        ("", "", "", ""),
    ]


def test_name_rules(fields):
    span = '<div class="SPZz6b"><span> </span><span> Panel name </span></div>'
    cases = [
        ('<b class="dbg0pd"> By class </b>', span),
        ('<b role="heading">By role</b>', span),
        # The first kind that exists counts, even where a later kind comes first in the page.
        ('<b role="heading">Role</b><b class="OSrXXb">Span</b>', span),
        # It exists but is blank: the other card rules are not tried, the panel is.
        ('<b class="OSrXXb"> </b><b class="dbg0pd">Not this</b>', span),
        (None, '<h2 data-attrid="title">Titled</h2><div class="qrShPb"><span>Later</span></div>'),
        (None, '<div class="qrShPb"><i><span>Deep</span></i></div><span>outside</span>'),
        (None, '<div class="dbg0pd"><i class="OSrXXb">Active</i></div>'),
        # By position: this listing is number 7 of its page.
        (None, "".join(f'<i class="OSrXXb">n{i}</i>' for i in range(9))),
        (None, '<i class="OSrXXb">only one</i>'),
    ]
    assert _column(fields(*cases), 0) == [
        "By class", "By role", "Span", "Panel name", "Titled", "Deep", "Active", "n7", "",
    ]


def test_website_rules(fields):
    site = '<a data-attrid="visit website" href="/local">x</a>'
    label = '<a aria-label="Website of A" href="https://label.test">x</a>'
    cases = [
        (None, '<a class="n1obkb" href="https://a.test"> SITE </a>' + site),
        (None, '<a class="ab_button" href="/go?u=1"><b class="aSAiSd">website</b>more</a>' + site),
        (None, '<a class="n1obkb" href="https://a.test">Directions</a>' + site + label),
        (None, '<a class="n1obkb" href="mailto:a@b.c">Website</a>' + label),
        (None, '<div aria-label="website" href="https://no.test"></div><a aria-label="my website" href="//w.test/p">x</a>'),
        (None, '<a data-attrid="website" href="">x</a>' + label),
    ]
    assert _column(fields(*cases), 1) == [
        "https://a.test/",
        "https://maps.test/go?u=1",
        "https://maps.test/local",
        "https://label.test/",
        "https://w.test/p",
        "https://label.test/",
    ]


def test_phone_rules(fields):
    cases = [
        (None, '<a href="tel:+91%2091000">x</a>'),
        (None, '<a href="tel:%zz12345678">x</a><b aria-label="Call 091000 00000 now"></b>'),
        (None, '<b aria-label="Call 091000 00000 now"></b><div class="C9waJd">1234567</div>'),
        (None, '<b data-phone-number=""></b><b aria-label="Call" data-phone-number="12 34"></b><div class="C9waJd">1234567</div>'),
        (None, '<div class="C9waJd y7xX3d">7654321</div><div class="C9waJd">open</div><div class="C9waJd">091000 00000</div>'),
        (None, '<div class="rllt__details"><div>Open 24 hours · 091000 00000</div></div>'),
        (None, '<div class="OYzgjc"><div>no</div><p><div>+1 (2) 345-6</div></p></div>'),
        (None, "<div>091000 00000</div>"),
        (None, '<b data-phone-number="09 100"></b>'),
    ]
    assert _column(fields(*cases), 2) == [
        "+91 91000", "091000 00000", "091000 00000", "12 34", "091000 00000",
        "091000 00000", "+1 (2) 345-6", "", "09 100",
    ]


def test_address_rules(fields):
    place = '<div class="nICndb">⁦Pune, India⁩</div>'
    cases = [
        (None, '<div class="C9waJd y7xX3d">Address: 1 Main St</div>' + place),
        (None, '<p jsname="eSHGZ">9:00, Monday morning</p><p jsname="eSHGZ">5 Long Road, Town</p>' + place),
        (None, '<div class="cyspcb">Open, now</div>' + place),
        (None, '<p data-attrid="kc:/address"><b><i class="LrzXr"> 7 Hill, X </i></b></p>'),
        (None, '<p data-attrid="kc:/location"><i class="LrzXr">⁦Address: 7 Hill⁩</i></p>'),
        (None, '<i class="LrzXr">7 Hill, X</i>'),
    ]
    assert _column(fields(*cases), 3) == [
        "1 Main St", "5 Long Road, Town", "Pune, India", "7 Hill, X", "Address: 7 Hill", "",
    ]


def test_tel_value(evaluate):
    assert evaluate(["tel:+91%2091000", "tel:1+2", "tel:%", " x "], tel_value) == ["+91 91000", "1+2", None, "x"]


def test_pick_over_rows_is_by_priority_then_position(spark):
    rows = [
        (1, "name", 2, 0, "low"), (1, "name", 1, 9, "late"), (1, "name", 1, 3, "early"),
        (1, "name", 1, 1, ""), (1, "phone", 1, 1, ""), (2, "name", 3, 0, "only"),
    ]
    cands = spark.createDataFrame(rows, "doc int, field string, pri int, pos int, value string")
    for n in (1, 5):
        out = sorted(tuple(r) for r in pick_first_rows(cands.repartition(n), ["doc"]).collect())
        assert out == [(1, "name", "early"), (2, "name", "only")]


def test_node_ranges_and_texts():
    page = '<ul><li>a<li>b <b>c</b></ul><p>d<p>e<br>f<!-- <x> --><script>"<i>"</script><title>&amp;</title>'
    text, nodes = parse_nodes(page, Interest())
    assert [(n["tag"], n["node"], n["last"], text[n["from"] : n["to"]].decode()) for n in nodes] == [
        ("ul", 0, 3, "ab c"), ("li", 1, 1, "a"), ("li", 2, 3, "b c"), ("b", 3, 3, "c"),
        ("p", 4, 4, "d"), ("p", 5, 8, 'ef"<i>"&'), ("br", 6, 6, ""), ("script", 7, 7, '"<i>"'), ("title", 8, 8, "&"),
    ]
    assert [page[n["beg"] : n["end"]] for n in nodes][:4] == [
        "<ul><li>a<li>b <b>c</b></ul>", "<li>a", "<li>b <b>c</b>", "<b>c</b>",
    ]


def test_interest_keeps_numbers_and_drops_the_rest():
    page = '<div><p class="x y" id="1" data-z="q&amp;r">t</p><a href="/u?a=1&copy=2">l</a></div>'
    _, nodes = parse_nodes(page, Interest(classes=frozenset(["y"]), attrs=frozenset(["href"]), shown=frozenset(["data-z"])))
    assert [(n["node"], n["tag"], n["cls"], n["attrs"]) for n in nodes] == [
        (1, "p", ["x", "y"], [("data-z", "q&r")]),
        (2, "a", [], [("href", "/u?a=1&copy=2")]),
    ]


def test_hostile_pages_parse_in_linear_time():
    for page in ("<" + "b " * 200_000 + ">t", "<script " * 20_000, "<!--" * 20_000, "<div>" * 20_000, "</p>" * 50_000, "<b>" * 150_000 + "</i>" * 150_000):
        assert len(parse_nodes(page, Interest(tags=frozenset(["none"])))[1]) == 0


def test_deep_nesting_gives_output_in_proportion(spark):
    """Half a megabyte of nested elements, all of interest to the rules: parsed and decided in linear time."""
    import time

    def size(count):
        text, nodes = parse_nodes('<p class="OYzgjc">' + "<div>x" * count, rules_interest(LISTING_RULES))
        return len(text) + sum(len(str(n)) for n in nodes)

    assert size(20_000) < 2.2 * size(10_000) and size(10_000) < 4_000_000
    page = '<p class="OYzgjc"><p class="rllt__details">' + "<div>x" * 83_000
    start = time.perf_counter()
    assert len(parse_nodes(page, rules_interest(LISTING_RULES))[1]) == 83_002
    assert time.perf_counter() - start < 2
    rows = spark.createDataFrame([(0, 0, 0, URL, None, page + " · 0123456789")], SCHEMA)
    assert listing_fields(rows, ["idx"]).first()["phone"] == "0123456789"
    start = time.perf_counter()
    assert listing_fields(rows, ["idx"]).first()["name"] == ""
    assert time.perf_counter() - start < 20


def test_offsets_leave_out_outer_space():
    page = "<p>\n \u00a0<b> \u3000é x\ufeff </b></p><i> \n</i><u></u><s>y</s>"
    text, nodes = parse_nodes(page, Interest())
    assert [text[n["head"] : n["tail"]].decode() for n in nodes] == ["é x", "é x", "", "", "y"]
    assert [text[n["from"] : n["to"]].decode() for n in nodes][1] == " \u3000é x\ufeff "


def test_ancestors_at_any_depth(spark):
    deep = Sel("b", within=Sel(classes=("in",), within=Sel("div", attrs=(("id", "=", "top"),), without=("off",))))
    html = (
        '<div id="top"><p><i class="in"><u><b>yes</b></u></i><b>no</b></p></div><i class="in"><b>no</b></i>'
        '<div id="top" class="off"><i class="in"><b>no</b></i></div><b class="in">no</b>'
    )
    rows = spark.createDataFrame([(1, html)], "id int, html string")
    page = settled(rows.select(html_nodes(F.col("html"), interest_of([deep])).alias("_page")))
    found = page.select(F.transform(select_nodes("_page.nodes", [deep]), lambda n: node_text(n, F.col("_page"))).alias("t"))
    assert found.first().t == ["yes"]


def test_the_node_stage_holds_few_pages_at_a_time(spark, monkeypatch):
    """However many pages Spark hands over at once; every page keeps its own elements, null and empty ones too."""
    parse, held = node_ops.parse_nodes, [0]

    class Found(list):
        def __init__(self, nodes):
            super().__init__(nodes)
            held[0] += 1

        def __del__(self):
            held[0] -= 1

    def counted(page, interest):
        found = Found(parse(page, interest)[1])
        return b"%d" % held[0], found

    def rows(many, size):
        html = F.concat(F.concat(F.lit("<i>"), F.col("id")), F.repeat(F.lit("<b c='d'>x"), size))
        return spark.range(0, many, 1, 1).select("id", F.when(F.col("id") % 7 > 0, html).alias("html"))

    monkeypatch.setattr(node_ops, "parse_nodes", counted)
    page = node_ops.html_nodes(F.col("html"), Interest())
    found = rows(4000, 50).select("id", page.alias("_page")).select(
        "id", F.col("_page.text").cast("string").cast("int").alias("held"), F.size("_page.nodes").alias("n")
    ).collect()
    assert max(r.held for r in found) <= 300
    assert sorted((r.id, r.n) for r in found) == [(i, 51 if i % 7 else 0) for i in range(4000)]
    monkeypatch.undo()
    both = {"a": (F.col("html"), Interest()), "b": (F.concat(F.lit("<u>"), "html"), Interest(tags=frozenset(["u"])))}
    out = rows(600, 40).select("id", node_ops.html_nodes_each(both).alias("_both")).collect()
    assert [(r.id, bytes(r._both.a.text)[:3], len(r._both.a.nodes), [n.tag for n in r._both.b.nodes]) for r in out] == [
        (i, str(i).encode().ljust(3, b"x"), 41, ["u"]) if i % 7 else (i, b"", 0, []) for i in range(600)
    ]


def test_the_node_table_parses_each_page_once(spark):
    """Spark asks for elements before it lays them out; that must not run the Python stage a second time."""
    pages = spark.createDataFrame([(1, "<p>a <b>c</b></p>"), (1, "<p>a <b>c</b></p>"), (None, "<i>"), (3, ""), (4, None), (5, "t")], "id int, html string")
    rows = node_ops.node_rows(pages, ["id"])
    assert sorted(((r.id, r.node, r.tag, r.text) for r in rows.collect()), key=str) == [
        (1, 0, "p", "a c"), (1, 0, "p", "a c"), (1, 1, "b", "c"), (1, 1, "b", "c"), (None, 0, "i", ""),
    ]
    for table in (rows, rows.drop("text"), rows.groupBy("id", "tag").count()):
        assert table._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_phone_at_the_end_of_any_text(fields):
    far = "x" * 300
    cases = [
        (None, f'<p class="OYzgjc"><div>{text}</div></p>')
        for text in (
            f"{far} · 0123456789", f"{far} ·{' ' * 300}0123456789", f"{far} ·  12345", f"·{' ' * 300}12345",
            "漢" * 100 + "· 0123456", f"{far} 0123456789", f"· {'1' * 21}", f"{far}· 01 · 2345678",
        )
    ]
    assert _column(fields(*cases), 2) == [
        "0123456789", "0123456789", "12345", "12345", "0123456", "", "", "2345678",
    ]


RESULT = "query_ord int, page_no int, url string, html string"


def _pages(spark, rows):
    return spark.createDataFrame([(q, p, URL, h) for q, p, h in rows], RESULT).repartition(3)


def test_cards_of_the_first_kind_with_any_hit(spark):
    pages = _pages(
        spark,
        [
            (0, 0, '<p class="cXedhc">no</p><div class="VkpGBb">a</div><div class="q VkpGBb">b<i>c</i></div>'),
            (0, 1, '<a class="rllt__link">d</a><p data-rc="1">no</p>'),
            (1, 0, "<p data-rc>e</p><p class='cXedhc'>é😀f</p>"),
            (1, 1, "<p data-rc>g</p><p data-rc='2'>h</p>"),
        ],
    )
    cards = [tuple(r) for r in listing_cards(pages, names=()).orderBy("query_ord", "page_no", "idx").collect()]
    assert cards == [
        (0, 0, 0, 1, '<div class="VkpGBb">a</div>'),
        (0, 0, 1, 1, '<div class="q VkpGBb">b<i>c</i></div>'),
        (0, 1, 0, 2, '<a class="rllt__link">d</a>'),
        (1, 0, 0, 3, "<p class='cXedhc'>é😀f</p>"),
        (1, 1, 0, 4, "<p data-rc>g</p>"),
        (1, 1, 1, 4, "<p data-rc='2'>h</p>"),
    ]


def test_result_ends_at_its_first_page_without_cards(spark):
    card = '<div class="VkpGBb">a</div>'
    pages = _pages(
        spark,
        [
            (0, 0, card), (0, 1, "<p>none</p>"), (0, 2, card),
            (1, 0, "<!-- " + card + " -->"), (1, 1, card),
            (2, 0, card), (2, 1, card), (2, 5, None), (2, 6, card),
            (3, 0, '<div title="<div class=VkpGBb>">'),
        ],
    )
    kept = sorted((r.query_ord, r.page_no) for r in pages_in_result(pages).collect())
    assert kept == [(0, 0), (2, 0), (2, 1)]
    assert sorted((r.query_ord, r.page_no) for r in listing_cards(pages).collect()) == kept


def test_cards_told_by_what_they_stand_under(spark):
    sels = (Sel("li", within=Sel(classes=("results",))), Sel("p", without=("ad",)))
    pages = _pages(
        spark,
        [
            (0, 0, '<ul class="results"><li>a<li>b</ul><li>no'), (0, 1, '<p class="ad">no</p><p>c</p>'),
            (0, 2, '<p class="ad">no</p><li>no'), (0, 3, "<p>late</p>"), (1, 0, "<ul><li>no</ul>"),
        ],
    )
    cards = [tuple(r) for r in listing_cards(pages, sels=sels, names=()).orderBy("query_ord", "page_no", "idx").collect()]
    assert cards == [(0, 0, 0, 1, "<li>a"), (0, 0, 1, 1, "<li>b"), (0, 1, 0, 2, "<p>c</p>")]
    assert sorted((r.query_ord, r.page_no) for r in pages_in_result(pages, sels=sels).collect()) == [(0, 0), (0, 1)]
    with pytest.raises(ValueError):
        has_card(F.col("html"), sels)


def test_pages_are_read_once_and_not_shuffled(spark, tmp_path):
    """The cards of a stored table: what is planned after the one pass holds neither a scan nor a page."""
    path = str(tmp_path / "pages")
    _pages(spark, [(q, p, f'<div class="VkpGBb">{p}</div>' + "x" * 500) for q in range(3) for p in range(20)]).write.parquet(path)
    cards = listing_cards(spark.read.parquet(path), keep=["url"])
    plan = cards._jdf.queryExecution().executedPlan().toString()
    assert cards.count() == 60
    assert "FileScan" not in plan and " html" not in plan.replace("card_html", "") and "ArrowEvalPython" not in plan


def test_a_result_with_most_pages_is_split(spark):
    card = '<div class="VkpGBb">a</div>'
    pages = spark.range(4_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 40 + 1).otherwise(0).cast("int").alias("query_ord"),
        F.col("id").cast("int").alias("page_no"),
        F.lit(URL).alias("url"),
        F.when(F.col("id").isin(3_001, 3_003), F.sha2(F.col("id").cast("string"), 512))
        .otherwise(F.concat(F.lit(card), F.sha2(F.col("id").cast("string"), 512)))
        .alias("html"),
    ).repartition(16)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    saved = {n: spark.conf.get(n, None) for n in conf}
    for n, v in conf.items():
        spark.conf.set(n, v)
    try:
        kept = pages_in_result(pages)
        rows = kept.collect()
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in saved.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    ends = {0: 3_001, 3_003 % 40 + 1: 3_003}
    expected = sum(
        1 for i in range(4_000) if i < ends.get(i % 40 + 1 if i % 3 == 0 else 0, 10_000)
    )
    assert len(rows) == expected
    assert "skew=true" in plan


def test_listings_from_pages_and_panels(spark):
    pages = _pages(spark, [(0, 0, '<p class="VkpGBb">a</p><p class="VkpGBb">b</p>'), (0, 1, "<p>end</p>")])
    panels = spark.createDataFrame([(0, 0, 1, "<i>panel b</i>")], "query_ord int, page_no int, idx int, panel_html string")
    rows = sorted(tuple(r) for r in listings_of(pages, panels).collect())
    assert rows == [
        (0, 0, 0, URL, '<p class="VkpGBb">a</p>', None, None, 0),
        (0, 0, 1, URL, '<p class="VkpGBb">b</p>', "<i>panel b</i>", None, 0),
    ]
    assert listings_of(pages, panels, names=()).columns == ["query_ord", "page_no", "idx", "url", "card_html", "panel_html"]


def _named(spark, html, panels):
    """Names by idx of the directory made of one result page and its panels."""
    from storefront.plans.directory import build_directory
    from storefront.sources.captures import PAGES

    keys = "query_ord int, page_no int, idx int, panel_html string"
    opened = spark.createDataFrame([(0, 0, idx, panel) for idx, panel in panels.items()], keys)
    listings = listings_of(_pages(spark, [(0, 0, html)]), opened)
    rows = build_directory(listings, spark.createDataFrame([], PAGES), with_contacts=False)
    return {r.idx: r.name for r in rows.collect()}


def test_the_last_name_rule_counts_over_the_result_page(spark):
    names = "".join(f'<h3 class="dbg0pd"><i class="OSrXXb"> Name {i} </i></h3>' for i in range(3))
    bare = '<p class="VkpGBb">card</p>' * 3
    own = {i: f'<i class="OSrXXb">Panel {i}</i>' for i in range(3)}
    # Three cards without a name, names elsewhere in the page.
    every = {0: "Name 0", 1: "Name 1", 2: "Name 2"}
    assert _named(spark, bare + names, {i: "<p>x</p>" for i in range(3)}) == every
    assert _named(spark, names + bare, {}) == every
    # Each panel holds its one name: the page counts first.
    assert _named(spark, bare + names, own) == every
    # After the names of the page the count goes on in the panel.
    assert _named(spark, bare + '<i class="OSrXXb">Name 0</i><i class="OSrXXb">Name 1</i>', own) == {
        0: "Name 0", 1: "Name 1", 2: "Panel 2",
    }
    assert _named(spark, bare, own) == {0: "Panel 0"}
    # An element that is there but blank gives no name; the rules before win.
    assert _named(spark, bare + '<i class="OSrXXb"> </i>' * 3, own) == {}
    titled = {1: '<h2 data-attrid="title">Titled</h2>'}
    assert _named(spark, bare + names, titled) == every | {1: "Titled"}


def test_listings_of_a_table_with_and_without_page_names(spark, tmp_path):
    from storefront.sources.captures import LISTINGS, NAMED_LISTINGS, read_captures

    rows = [(0, 0, 0, URL, None, '<i class="OSrXXb">Only</i>')]
    spark.createDataFrame(rows, LISTINGS).write.parquet(str(tmp_path / "old"))
    spark.createDataFrame([(*rows[0], "Page", 1)], NAMED_LISTINGS).write.parquet(str(tmp_path / "new"))
    found = [
        listing_fields(read_captures(spark, str(tmp_path / name), NAMED_LISTINGS), ["idx"]).first()["name"]
        for name in ("old", "new")
    ]
    assert found == ["Only", "Page"]


def test_flag_agrees_with_the_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for sels in ((Sel("a", attrs=(("href", "*=", "è"),)),), (Sel("div", classes=("ad",)),), (Sel("h4"),)):
        nodes = node_ops.html_nodes(F.col("html"), node_ops.interest_of(sels))
        both = pages.select(has_card(F.col("html"), sels).alias("flag"), nodes.alias("_page")).select(
            "flag", (F.size(node_ops.select_nodes("_page.nodes", sels)) > 0).alias("parsed")
        )
        assert both.where("flag <> parsed").count() == 0


def test_default_rules_cover_the_four_fields():
    assert {r.field for r in LISTING_RULES} == {"name", "website", "phone", "address"}


def test_every_rule_gives_values_in_the_registered_query(spark):
    """The value tells the rule that found it: all sixteen do, each on a share of the rows."""
    from catalog.queries import listing_rules

    told = {"name": r"^n(\d)", "website": r"//w(\d)", "phone": r"^\+?(\d)", "address": r"^(\d)"}
    rows = listing_rules(spark, "/root/testdata/sf0.001").cache()
    for field, pattern in told.items():
        counts = {r.rule: r["count"] for r in rows.groupBy(F.regexp_extract(field, pattern, 1).alias("rule")).count().collect()}
        assert counts.keys() == {str(r.pri) for r in LISTING_RULES if r.field == field}
        assert min(counts.values()) >= 20
