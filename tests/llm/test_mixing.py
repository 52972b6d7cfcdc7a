import pytest
from pyspark.sql import functions as F

from storefront.llm.mixing import CURVES, area, mix, position_of


def targets(sizes, weights, most=3):
    """Shares by weight; what is above a cap is shared again among the others."""
    total, caps, full = sum(sizes), [most * s for s in sizes], set()
    while True:
        left = total - sum(caps[i] for i in full)
        free = sum(w for i, w in enumerate(weights) if i not in full)
        out = [caps[i] if i in full else left * w / free for i, w in enumerate(weights)]
        above = {i for i in range(len(sizes)) if out[i] > caps[i]} - full
        if not above:
            return out
        full |= above


def test_weights_are_areas():
    assert [area(c) for c in CURVES] == [5, 2, 1]


@pytest.mark.parametrize("curve", [*CURVES, ((0, 0), (0.25, 0), (0.5, 4), (1, 0))])
def test_position_inverts_the_area(spark, curve):
    shares = [0.0, 0.01, 0.2, 0.5, 0.77, 0.999]
    rows = spark.createDataFrame([(s,) for s in shares], "s double").select("s", position_of(F.col("s"), curve).alias("t"))
    for share, time in rows.collect():
        cut = [(t, w) for t, w in curve if t < time]
        (t0, w0), (t1, w1) = next((a, b) for a, b in zip(curve, curve[1:]) if a[0] <= time <= b[0])
        used = area([*cut, (time, w0 + (w1 - w0) * (time - t0) / (t1 - t0))]) if cut else 0.0
        assert used / area(curve) == pytest.approx(share, abs=1e-9)


@pytest.mark.parametrize("sizes", [{"a": 900, "b": 40, "c": 5}, {"a": 10, "b": 500, "c": 480, "d": 1000, None: 3}, {"x": 7}])
def test_targets_and_what_is_taken(spark, sizes):
    rows, n = [], 0
    for source, total in sizes.items():
        while total:
            size = min(total, 1 + n % 17)
            rows.append((n, source, "w " * size))
            total, n = total - size, n + 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = mix(docs).collect()
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    want = dict(zip(order, targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    for source in sizes:
        own = [r for r in got if r["source"] == source]
        assert all(r["target"] == pytest.approx(want[source]) and r["source_size"] == sizes[source] for r in own)
        assert sum(r["taken"] for r in own) == pytest.approx(want[source], abs=1)
    assert all(r["taken"] <= 3 * r["size"] for r in got) and len(got) == len(rows)
    assert all(len(r["positions"]) == -(-r["taken"] // max(1, r["size"])) for r in got)
    times = [r["position"] for r in got if r["position"] is not None]
    assert times == sorted(times) and all(0 <= t <= 1 for t in times)
    assert [r.asDict() for r in mix(docs.repartition(2)).collect()] == [r.asDict() for r in got]


def test_curves_say_when(spark):
    rows = [(n, "abc"[n % 3], "w " * 10) for n in range(3000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    early = {r[0]: r[1] for r in got.groupBy("source").agg(F.avg("position")).collect()}
    assert early["a"] < 0.5 < early["c"]


def test_odd_tables(odd_docs, no_docs):
    got = mix(odd_docs)
    assert got.count() == odd_docs.count() and mix(no_docs).count() == 0
    assert got.where("size = 0 AND (taken != 0 OR position IS NOT NULL)").count() == 0
    empty = odd_docs.where("text IS NULL OR text = ''")
    assert all(r["target"] == 0 and r["taken"] == 0 for r in mix(empty).collect())
    assert set(mix(odd_docs, keep=("text", "size")).columns) >= {"text", "taken"}
