import random
from itertools import groupby

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storefront.operators.joins import spread_join
from storefront.operators.rows import dedup, dedup_counts, limit_page_quota, limit_rows

LIGHT = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(autouse=True, scope="module")
def ranges_stay_apart(spark):
    """Small tables would all be one partition, and no group in several."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def _named(spark, names, city="A"):
    rows = [(city, i, n) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "city string, ord int, name string").repartition(3)


def test_first_of_each_name_stays(spark):
    names = ["Cafe", " cafe ", "CAFÉ", "café", "", None, " Cafe", "  "]
    rows = _named(spark, names).union(_named(spark, ["cafe"], "B"))
    kept = sorted((r.city, r.ord) for r in dedup(rows, ["city"], ["ord"]).collect())
    assert kept == [("A", 0), ("A", 2), ("B", 0)]
    counts = sorted(tuple(r) for r in dedup_counts(rows, ["city"]).collect())
    assert counts == [("A", 8, 2, 6), ("B", 1, 1, 0)]


@LIGHT
@given(st.lists(st.sampled_from(["a", "A ", "b", "B", "", "c"]), min_size=1, max_size=30), st.integers(1, 7))
def test_dedup_keeps_the_first_and_is_idempotent(spark, names, parts):
    rows = _named(spark, names).repartition(parts)
    once = dedup(rows, ["city"], ["ord"])
    got = sorted(r.ord for r in once.collect())
    first = {}
    for i, n in enumerate(names):
        if n.strip():
            first.setdefault(n.strip().lower(), i)
    assert got == sorted(first.values())
    assert sorted(r.ord for r in dedup(once, ["city"], ["ord"]).collect()) == got


def test_dedup_and_limits_cut_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("concat('A', id % 2) city", "id ord", "concat('x', id % 3) name")
    for frame in (dedup(rows, ["city"], ["ord"]), limit_rows(rows, ["city"], ["ord"], 5)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "row_number(), 1, Partial" in plan or "row_number(), 5, Partial" in plan


def test_plain_limit(spark):
    rows = spark.createDataFrame([(c, o) for c in "AB" for o in range(5)], "city string, ord int")
    out = sorted(tuple(r) for r in limit_rows(rows, ["city"], ["ord"], 2).collect())
    assert out == [("A", 0), ("A", 1), ("B", 0), ("B", 1)]
    with pytest.raises(ValueError):
        limit_rows(rows, ["city"], ["ord"], 0)


def _cards(spark, pages, parts=3):
    """``pages``: per city a list of pages, each a list of flags."""
    rows = [
        (city, page, idx, ok)
        for city, result in enumerate(pages)
        for page, flags in enumerate(result)
        for idx, ok in enumerate(flags)
    ]
    schema = "city int, page_no int, idx int, ok boolean"
    return spark.createDataFrame(rows, schema).repartition(parts)


def _read_pages(pages, limit):
    """The rule, card by card."""
    taken = []
    for city, result in enumerate(pages):
        left = limit
        for page, flags in enumerate(result):
            for idx, ok in enumerate(flags[:left]):
                if ok:
                    taken.append((city, page, idx))
            left = limit - sum(1 for t in taken if t[0] == city)
            if left <= 0:
                break
    return taken


def _quota(cards, limit):
    out = limit_page_quota(cards, ["city"], "page_no", "idx", limit, F.col("ok"))
    assert out.columns == cards.columns
    return sorted((r.city, r.page_no, r.idx) for r in out.collect())


def test_cards_that_fail_are_not_replaced(spark):
    pages = [[[True, False, True, True], [True, True]]]
    assert _quota(_cards(spark, pages), 3) == [(0, 0, 0), (0, 0, 2), (0, 1, 0)]


def test_pages_that_start_late_are_read_in_order(spark):
    late = [False, False, True]
    pages = [[late] * 6 + [[True]] * 3, [[False] * 4 + [True], [False, True]], [[False]], [[]]]
    for limit in (1, 2, 3, 4, 5, 9):
        assert _quota(_cards(spark, pages), limit) == _read_pages(pages, limit)


pages_strategy = st.lists(
    st.lists(st.lists(st.booleans(), min_size=1, max_size=6), min_size=1, max_size=12), min_size=1, max_size=4
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pages_strategy, st.integers(1, 9), st.integers(1, 5))
def test_quota_equals_reading_card_by_card(spark, pages, limit, parts):
    assert _quota(_cards(spark, pages, parts), limit) == _read_pages(pages, limit)


@pytest.mark.parametrize("limit", [501, 1500, 5000])
def test_quota_at_large_limits(spark, limit):
    """Also beyond the limit at which Spark's own cut per task ends by default."""
    rng = random.Random(limit)
    pages = [[[rng.random() < 0.7 for _ in range(rng.randrange(1, 25))] for _ in range(n)] for n in (500, 40, 3)]
    assert _quota(_cards(spark, pages, 7), limit) == _read_pages(pages, limit)


def test_a_deep_limit_is_cut_in_each_task(spark):
    rows = spark.range(0, 200_000, 1, 4).selectExpr("if(id % 10 = 0, 'B', 'A') city", "id * 7919 % 200003 ord")
    out = limit_rows(rows, ["city"], ["ord"], 1500)
    want = {}
    for city, order in rows.collect():
        want.setdefault(city, []).append(order)
    got = {}
    for city, order in out.collect():
        got.setdefault(city, []).append(order)
    assert {c: sorted(v) for c, v in got.items()} == {c: sorted(v)[:1500] for c, v in want.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1500, Partial" in plan and "Arrow" not in plan and "Python" not in plan


def test_a_cut_that_is_off_stays_off(spark):
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    saved = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        assert limit_rows(spark.range(9).selectExpr("1 city", "id"), ["city"], ["id"], 5).count() == 5
        assert spark.conf.get(name) == "-1"
    finally:
        spark.conf.set(name, saved)


def test_a_city_of_many_pages_is_read_in_many_tasks(spark):
    """One city, at a limit that no few pages meet: its pages lie in several ranges, which are read side by side."""
    cards = spark.range(60_000).selectExpr("'A' city", "id div 6 page_no", "id % 6 idx", "id % 11 = 0 ok")
    out = limit_page_quota(cards, ["city"], "page_no", "idx", 4000, F.col("ok"))
    sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 3 and sum(sizes) == 4000 and max(sizes) < 2500
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    flags = [[(p * 6 + i) % 11 == 0 for i in range(6)] for p in range(10_000)]
    assert sorted((0, r.page_no, r.idx) for r in out.collect()) == _read_pages([flags], 4000)


def test_groups_are_told_apart_by_every_column(spark):
    rows = [(a, b, p, i, (p + i) % 3 > 0) for a in (None, "x", "y") for b in (None, 1) for p in range(5) for i in range(4)]
    cards = spark.createDataFrame(rows, "a string, b int, page_no int, idx int, ok boolean").repartition(4)
    out = limit_page_quota(cards, ["a", "b"], "page_no", "idx", 5, F.col("ok"))
    flags = [[(p + i) % 3 > 0 for i in range(4)] for p in range(5)]
    expected = [(p, i) for _, p, i in _read_pages([flags], 5)]
    assert sorted((str(r.a), str(r.b), r.page_no, r.idx) for r in out.collect()) == sorted(
        (str(a), str(b), p, i) for a in (None, "x", "y") for b in (None, 1) for p, i in expected
    )
    whole = limit_page_quota(cards.where("a = 'x' AND b = 1"), [], "page_no", "idx", 5, F.col("ok"))
    assert sorted((r.page_no, r.idx) for r in whole.collect()) == expected


def test_quota_on_a_city_with_most_of_the_rows(spark):
    cards = spark.range(200_000).selectExpr(
        "if(id % 3 = 0, id % 50 + 1, 0) city", "cast(id div 20 as int) page_no", "id idx", "id % 7 = 0 ok"
    )
    flags = {}
    for r in cards.where("city < 3").collect():
        flags.setdefault(r.city, []).append((r.page_no, r.idx, r.ok))
    expected = []
    for city, rows in flags.items():
        left = 40
        for page, group in groupby(sorted(rows), key=lambda r: r[0]):
            hit = [(city, page, idx) for _, idx, ok in list(group)[:left] if ok]
            expected += hit
            left -= len(hit)
    assert [t for t in _quota(cards, 40) if t[0] < 3] == sorted(expected)


def test_spread_join_uses_many_tasks_for_one_key(spark):
    rows = spark.range(10_000).selectExpr("'hot' k", "id")
    small = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = spread_join(rows, small, ["k"], ["id"])
        sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 10_000 and len(sizes) > 1 and max(sizes) < 8_000
        assert out.select("v").distinct().collect()[0].v == 1
        missing = spread_join(rows, small.where("k = 'cold'"), ["k"], ["id"])
        assert missing.where("v is null").count() == 10_000
        inner = spread_join(rows, small, ["k"], ["id"], how="inner")
        assert inner.count() == 10_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    with pytest.raises(ValueError):
        spread_join(rows, small, ["k"], ["id"], how="outer")
