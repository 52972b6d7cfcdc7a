import pytest
from pyspark.sql import functions as F

from storefront.operators.sites import site_contacts, site_pages, without_contacts

PAGES = "page_id long, url string, html string"


def _links(*hrefs):
    return "".join(f'<a href="{h}">x</a>' for h in hrefs)


def _sites(spark, websites):
    return spark.createDataFrame(list(enumerate(websites)), "id int, website string").repartition(3)


def _contacts(sites, pages, **options):
    out = site_contacts(sites, pages, ["id"], **options)
    return {r.id: tuple(r)[2:] for r in out.collect()}


def test_first_value_over_home_and_contact_pages(spark):
    pages = spark.createDataFrame(
        [
            (1, "https://s.test/deep/p?q=1", _links("https://facebook.com/1")),
            (2, "https://s.test/about", "y@s.test " + _links("https://linkedin.com/late")),
            (3, "https://s.test/contact", "x@s.test " + _links("https://facebook.com/2", "https://x.com/c")),
            (4, "https://s.test/contact?lang=en", "no@s.test"),
            (5, "https://s.test/impressum", _links("https://instagram.com/no")),
            # No capture of the home page: the contact page does not count.
            (6, "https://nohome.test/contact", "z@nohome.test"),
            # The home page was captured without content.
            (7, "https://blank.test/", None),
            (8, "https://blank.test/contact", "b@blank.test"),
            # Two captures of one page, the earlier one without an address.
            (10, "https://twice.test/#top", "second@twice.test"),
            (9, "https://twice.test/", "none here"),
            (11, "https://empty.test/", ""),
            (12, "https://empty.test/about-us", "e@empty.test"),
        ],
        PAGES,
    ).repartition(4)
    sites = _sites(
        spark,
        [
            "https://s.test/deep/p?q=1", "HTTPS://S.test:443/deep/p?q=1#x", "https://nohome.test/", "https://blank.test",
            "https://twice.test", "https://empty.test", "", None, "https://unknown.test/", "not a url",
        ],
    )
    full = ("x@s.test", "https://facebook.com/1", "", "https://x.com/c", "https://linkedin.com/late")
    none = ("", "", "", "", "")
    assert _contacts(sites, pages) == {
        0: full,
        1: full,
        2: none,
        3: none,
        4: ("second@twice.test", "", "", "", ""),
        5: ("e@empty.test", "", "", "", ""),
        6: none,
        7: none,
        8: none,
        9: none,
    }
    assert _contacts(sites, pages, paths=())[0] == ("", "https://facebook.com/1", "", "", "")
    assert _contacts(sites, pages, paths=("/about", "/contact"))[0][0] == "y@s.test"


def test_site_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.test", ""), (2, "http://a.test/about", ""), (3, "http://b.test/", ""), (4, "http://a.test/x", "")], PAGES
    )
    sites = _sites(spark, ["http://a.test/", "http://a.test/", "http://c.test/", "", None])
    rows = sorted(tuple(r) for r in site_pages(sites, pages).collect())
    assert rows == [("http://a.test/", 0, 1), ("http://a.test/", 3, 2)]


def test_contacts_off_never_reads_pages(spark):
    sites = _sites(spark, ["http://a.test/"])
    out = without_contacts(sites)
    assert [tuple(r) for r in out.collect()] == [(0, "http://a.test/", "", "", "", "", "")]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled_joins(spark):
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    saved = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in saved.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_a_website_shared_by_most_rows_is_split(spark, shuffled_joins):
    sites = spark.range(40_000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://s"), F.col("id") % 50, F.lit(".test/")))
        .otherwise("https://hot.test/")
        .alias("website"),
        F.sha2(F.col("id").cast("string"), 512).alias("payload"),
    ).repartition(16)
    pages = spark.createDataFrame(
        [(1, "https://hot.test/", "h@hot.test"), (2, "https://s1.test/", "one"), (3, "https://s1.test/contact", "c@s1.test")], PAGES
    )
    out = site_contacts(sites, pages, ["id"])
    counts = {r.email: r["count"] for r in out.groupBy("email").count().collect()}
    assert counts["h@hot.test"] == 40_000 - 13_334
    assert counts["c@s1.test"] == sites.where("website = 'https://s1.test/'").count()
    out.write.format("noop").mode("overwrite").save()
    frame = out._jdf.queryExecution()
    plan = out.collect() and frame.executedPlan().toString()
    assert "skew=true" in plan
    # The pages are read and reduced once for both look-ups.
    assert plan.count("ReusedExchange") >= 1


def test_rows_without_a_website_are_spread(spark, shuffled_joins):
    sites = spark.range(20_000).select("id", F.lit("").alias("website")).repartition(8)
    pages = spark.createDataFrame([(1, "https://a.test/", "a@a.test")], PAGES)
    out = site_contacts(sites, pages, ["id"], paths=())
    sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20_000
    assert max(sizes) < 10_000


def test_html_never_travels(spark, shuffled_joins):
    sites = _sites(spark, ["http://a.test/"])
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = site_contacts(sites, pages, ["id"])._jdf.queryExecution().executedPlan()
    lines = plan.toString().split("\n")
    assert not [line for line in lines if "Exchange" in line and "html" in line]
    assert "NestedLoop" not in plan.toString() and "Cartesian" not in plan.toString()
