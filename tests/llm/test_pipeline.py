import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import check_oracles
import corpus_pipeline
from storefront.llm.decontam import normal
from storefront.llm.queries import ORACLES, QUERIES
from test_near_dup import plain_components

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_those_dealt():
    names = ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans"]
    assert [n for n, _ in corpus_pipeline.STAGES] == [*names, "mixing sources to target weights"]
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_each_stage_on_its_own_input(spark, tmp_path):
    """Every stage against a plain version over what the one before has kept (a few hundred labels are needed)."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    items = [normal(r["text"].encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    tables = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(number))
        stage(spark, tables[-1], folder).write.parquet(out)
        tables.append(spark.read.parquet(out))
    rows = [{r["doc_id"]: r for r in t.collect()} for t in tables]
    assert all(t.columns == COLUMNS for t in tables[:-1])
    assert all(rows[i + 1].keys() <= rows[i].keys() for i in range(5))

    good = [i for i in rows[0] if labels.get(i) == (1, 0)]
    poor = [i for i in rows[0] if labels.get(i, (1, 0))[0] == 0]
    assert sum(i in rows[1] for i in good) >= 0.98 * len(good) and sum(i in rows[1] for i in poor) < 0.1 * len(poor)
    found = plain_components({i: r["text"] for i, r in rows[1].items()})
    assert rows[2].keys() == {i for i, (_, _, kept) in found.items() if kept}
    leaks = {i for i, r in rows[2].items() if any(item in normal(r["text"].encode()) for item in items)}
    assert rows[3].keys() == rows[2].keys() - leaks and leaks
    assert rows[4].keys() == rows[3].keys()
    for i, r in rows[4].items():
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == rows[3][i]["text"] or "[SECRET]" in r["text"]
    assert all(0 < r["taken"] <= 3 * r["size"] and r["text"] == rows[4][i]["text"] for i, r in rows[5].items())
    assert [r["position"] for r in tables[-1].orderBy("position").collect()] == sorted(r["position"] for r in rows[5].values())


def test_run_equals_the_stages_and_itself(spark):
    first = corpus_pipeline.run(spark, FOLDER)
    again = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect())) and first.count() > 50


def test_odd_documents_pass(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs.select(*odd_docs.columns[:5])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, FOLDER)
            assert kept.columns == docs.columns
            assert kept.count() <= docs.count() and (docs.isEmpty() or kept.where("doc_id IN (60, 61)").count() == 2)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert last.where(F.col("taken") <= 0).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same, note = check_oracles.compare(spark, check_oracles.connect(FOLDER), FOLDER, name)
    assert same, note
