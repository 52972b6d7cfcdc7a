import numpy as np
import pytest
from pyspark.sql import functions as F

from storefront.llm.quality import bound_of, gram_ids, keep_good, kth_largest, resample, statistics

FOLDER = "/root/testdata/sf0.1"


def test_bound():
    good, bad = np.array([-0.1, -0.2, 0.0, -0.3]), np.array([-2.0, -1.0, -0.25])
    assert bound_of(good, bad, 0.0) == pytest.approx(-0.65)
    assert bound_of(good, bad, 0.3) == pytest.approx(-0.225) or bound_of(good, bad, 0.3) == pytest.approx(-0.65)
    assert bound_of(good, np.array([]), 0.1) == -np.inf == bound_of(np.array([]), bad, 0.1)
    assert bound_of(np.zeros(5), np.zeros(5), 0.1) == -np.inf


def test_grams_do_not_cross_texts():
    texts = [b"abcdef gh gh", b"", b"xy", "é漢字".encode(), b"a " * 40]
    together = gram_ids(texts)
    for n, text in enumerate(texts):
        for (ids, owner), (alone, _) in zip(together, gram_ids([text])):
            assert sorted(ids[owner == n]) == sorted(alone)
    evidence = -np.arange(2 * (1 << 18) + 1).astype(np.float32)
    assert np.allclose(statistics(texts, evidence), np.column_stack([statistics([t], evidence) for t in texts]))
    assert (statistics([b""], evidence) == 0).all()


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_kth_largest(spark, k):
    values = np.round(np.random.default_rng(1).normal(size=1000) ** 3, 2)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert kth_largest(rows, "v", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(rows, "v", 0) == np.inf and kth_largest(rows.limit(0), "v", 3) == -np.inf


def test_documents_without_a_label(spark):
    """Labels of half the documents are shown; the other half must come out right."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 5000")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("doc_id < 5000")
    shown = F.pmod(F.xxhash64(F.lit(99), "doc_id"), F.lit(2)) == 0
    found = resample(docs, labels.where(shown)).join(labels.where(~shown), "doc_id")
    counts = {r["g"]: (r["n"], r["kept"]) for r in found.groupBy(F.expr("if(quality = 1 and toxic = 0, 'good', if(toxic = 1, 'toxic', 'junk'))").alias("g")).agg(F.count("*").alias("n"), F.count_if("accepted").alias("kept")).collect()}
    assert counts["good"][1] >= 0.98 * counts["good"][0]
    assert counts["junk"][1] <= 0.03 * counts["junk"][0] and counts["toxic"][1] <= 0.15 * counts["toxic"][0]


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(50)] + [(None, 1, 0), (7, None, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    first = resample(odd_docs, labels)
    assert first.count() == odd_docs.count() and resample(no_docs, labels).count() == 0
    assert sorted(map(str, first.collect())) == sorted(map(str, resample(odd_docs.repartition(2), labels).collect()))
    assert resample(odd_docs, labels.limit(0)).where("NOT accepted").count() == 0
    assert first.where("doc_id IN (60, 61) AND NOT accepted").count() == 0
    kept = keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in first.where("accepted").collect())
