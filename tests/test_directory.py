import pytest
from pyspark.sql import functions as F

from storefront.materialize import materialize
from storefront.params import BUSINESS_FIELDS
from storefront.plans.directory import build_directory, build_directory_batch, directory_of_pages
from storefront.sources.captures import LISTINGS, PAGES, read_captures
from storefront.streaming.captures import stream_contacts


def _card(name):
    return f'<div class="VkpGBb"><div class="dbg0pd"><span class="OSrXXb">{name}</span></div></div>'


def _panel(website="", phone="", address=""):
    link = f'<a class="n1obkb" href="{website}"><span class="aSAiSd">Website</span></a>' if website else ""
    return (
        f'<div class="OYzgjc">{link}<div class="C9waJd">{phone}</div>'
        f'<div class="C9waJd y7xX3d"><div><span>{address}</span></div></div></div>'
    )


@pytest.fixture(scope="module")
def captures(spark):
    url = "https://maps.test/"
    listings = [
        # Query 0, limit 4: page 0 has a card without a name, which is not replaced.
        (0, 0, 0, url, _card("Cafe"), _panel("https://cafe.test/", "091000 00000", "1 Main St, Town")),
        (0, 0, 1, url, _card(""), _panel()),
        (0, 0, 2, url, _card(" cafe "), _panel("https://other.test/")),
        (0, 0, 3, url, _card("Bar"), _panel("https://facebook.com/bar")),
        (0, 0, 4, url, _card("Fifth"), _panel()),
        (0, 1, 0, url, _card("Next"), _panel()),
        (0, 1, 1, url, _card("Beyond"), _panel()),
        (1, 0, 0, url, _card("Cafe"), _panel("https://nohome.test/")),
        (3, 0, 0, url, _card("Repeated"), _panel()),
    ]
    pages = [
        (1, "https://cafe.test/", '<a href="https://instagram.com/cafe">i</a>'),
        (2, "https://cafe.test/about", "<p>hi@cafe.test</p>"),
        (3, "https://facebook.com/bar", "<p>no@facebook.test</p>"),
        (4, "https://nohome.test/contact", "no@nohome.test"),
    ]
    return (
        spark.createDataFrame(listings, LISTINGS).repartition(4),
        spark.createDataFrame(pages, PAGES).repartition(2),
    )


CAFE = ("Cafe", "https://cafe.test/", "091000 00000", "hi@cafe.test", "1 Main St, Town", "", "https://instagram.com/cafe", "", "")


def _blank(name, website=""):
    return (name, website, *[""] * 7)


def _result(df):
    assert df.columns[:3] == ["query_ord", "page_no", "idx"]
    assert tuple(df.columns[3:]) == BUSINESS_FIELDS
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


def test_page_quota(captures):
    assert _result(build_directory(*captures, limit=4)) == {
        (0, 0, 0): CAFE,
        (0, 0, 3): _blank("Bar"),
        (0, 1, 0): _blank("Next"),
        (1, 0, 0): _blank("Cafe", "https://nohome.test/"),
        (3, 0, 0): _blank("Repeated"),
    }


def test_plain_limit_and_no_contacts(captures):
    found = _result(build_directory(*captures, limit=4, limit_mode="rows", with_contacts=False))
    assert found == {
        (0, 0, 0): CAFE[:3] + ("",) + CAFE[4:5] + ("",) * 4,
        (0, 0, 3): _blank("Bar"),
        (0, 0, 4): _blank("Fifth"),
        (1, 0, 0): _blank("Cafe", "https://nohome.test/"),
        (3, 0, 0): _blank("Repeated"),
    }


def test_arguments(captures):
    with pytest.raises(ValueError):
        build_directory(*captures, limit=0)
    with pytest.raises(ValueError):
        build_directory(*captures, limit_mode="pages")


def test_batch(spark, captures):
    cities = spark.createDataFrame([(0, "Delhi"), (1, "Pune"), (2, "Goa"), (3, "Delhi")], "ord int, city string")
    out = build_directory_batch(cities, "cafes in [city]", *captures, limit=4)
    rows = {(r.city_ord, r.city, r.query, r.name) for r in out.collect()}
    assert rows == {
        (0, "Delhi", "cafes in Delhi", "Cafe"),
        (0, "Delhi", "cafes in Delhi", "Bar"),
        (0, "Delhi", "cafes in Delhi", "Next"),
        (1, "Pune", "cafes in Pune", "Cafe"),
    }
    with pytest.raises(ValueError):
        build_directory_batch(cities, "cafes in town", *captures)


def test_without_any_capture(captures):
    listings, pages = captures
    assert build_directory(listings.limit(0), pages).count() == 0
    assert _result(build_directory(listings, pages.limit(0), limit=1))[(0, 0, 0)][3] == ""


def test_pages_alone(spark):
    pages = spark.createDataFrame(
        [
            (2, "https://a.test/2", "<title> One </title>x@a.test"),
            (1, "https://www.a.test/1", "<title>one</title>"),
            (3, "https://a.test/3", "<title></title>z@a.test"),
            (4, "https://fb.com/4", "<title>One</title>f@fb.test"),
        ],
        PAGES,
    )
    rows = {(r.host, r.page_id): (r.name, r.website, r.email) for r in directory_of_pages(pages).collect()}
    assert rows == {
        ("a.test", 1): ("one", "https://www.a.test/1", ""),
        ("fb.com", 4): ("One", "", ""),
    }


def test_result_does_not_depend_on_partitioning(spark, captures):
    listings, pages = captures
    expected = _result(build_directory(listings, pages, limit=3))
    assert _result(build_directory(listings.repartition(7, "idx"), pages.coalesce(1), limit=3)) == expected


def test_listings_are_parsed_once(spark, captures, tmp_path):
    """One Python stage and one scan of the listings."""
    listings, pages = captures
    listings.write.parquet(str(tmp_path / "listings"))
    stored = spark.read.parquet(str(tmp_path / "listings"))
    out = build_directory(stored, pages, limit=4, limit_mode="rows", with_contacts=False)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ArrowEvalPython") == 1 and plan.count("FileScan parquet") == 1
    # the page quota writes the rows it has parsed, and reads those
    out = build_directory(stored, pages, limit=4, with_contacts=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "FileScan" not in plan


def test_materialized_rows_are_read_back(spark, captures):
    listings, _ = captures
    narrow = listings.select("idx", F.length("panel_html").alias("n"))
    cut = materialize(narrow)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, narrow.collect()))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "panel_html" not in plan and "Exchange" not in plan


def test_captures_are_read_with_a_stated_schema(spark, tmp_path, captures):
    _, pages = captures
    path = str(tmp_path / "pages")
    pages.withColumn("more", F.lit(1)).write.parquet(path)
    assert read_captures(spark, path).columns == ["page_id", "url", "html"]
    assert read_captures(spark, path).count() == 4


def test_contacts_of_a_stream_equal_those_of_a_table(spark, tmp_path, captures):
    _, pages = captures
    path = str(tmp_path / "pages")
    pages.write.parquet(path)
    query = (
        stream_contacts(spark, path)
        .writeStream.format("memory")
        .queryName("streamed")
        .trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "state"))
        .start()
    )
    query.awaitTermination(120)
    rows = {r.page_id: (r.email, r.instagram) for r in spark.table("streamed").collect()}
    assert rows == {
        1: (None, "https://instagram.com/cafe"),
        2: ("hi@cafe.test", None),
        3: ("no@facebook.test", None),
        4: ("no@nohome.test", None),
    }
