import random
from itertools import combinations

import numpy as np
import pytest

from storefront.llm import near_dup
from storefront.llm.near_dup import alike, forest, keep_one, linked, minima, near_duplicates, packed, shingle_set


def plain_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain_components(texts):
    sets = {n: plain_set(t) for n, t in texts.items()}
    first = {n: n for n in texts}

    def root(n):
        while first[n] != n:
            n = first[n]
        return n

    for a, b in combinations(sorted(n for n in sets if sets[n]), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            first[y] = x
    return {n: (len(sets[n]), root(n), root(n) == n) for n in texts}


@pytest.mark.parametrize("blocks", [(512, 1 << 20, 1024), (3, 500, 2)])
def test_against_all_pairs(spark, docs, texts, blocks, monkeypatch):
    """Also with blocks so small that groups span many of them."""
    for name, value in zip(("BLOCK_SETS", "BLOCK_SHINGLES", "BLOCK_SIGS"), blocks):
        monkeypatch.setattr(near_dup, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == plain_components(texts)


def test_a_large_group_of_half_alike_texts(spark):
    """Many pairs on either side of the threshold share bands."""
    rng = random.Random(8)
    base = [f"b{n}" for n in range(120)]
    texts = {}
    for n in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(120)] = f"e{rng.randrange(999)}"
        texts[n] = " ".join(own)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(rows).collect()}
    assert got == plain_components(texts) and 5 < len({c for _, c, _ in got.values()}) < 150


def test_odd_tables(spark, odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert near_duplicates(no_docs).count() == 0
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # doc 3 is there twice
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(r["doc_id"]) for r in rows if r["kept"]})


def test_one_row_of_each_component(spark, texts):
    """Repeated rows, equal ids with different texts, and components that have null ids or nothing else."""
    text = texts[10]
    near = text + " more"
    rows = [(1, text)] * 3 + [(2, text), (None, text)]
    assert keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect() == [(1, text)]
    lost = [(None, text), (None, text), (None, near)]
    assert len(keep_one(spark.createDataFrame(lost, "doc_id long, text string")).collect()) == 1
    same_id = [(7, text), (7, near), (7, texts[20]), (7, None), (7, None), (8, None), (8, ""), (None, " "), (None, " ")]
    kept = [tuple(r) for r in keep_one(spark.createDataFrame(same_id, "doc_id long, text string")).collect()]
    assert len(kept) == 6 and (7, texts[20]) in kept and ((7, text) in kept) != ((7, near) in kept)


def test_three_times_every_row(spark, docs):
    once = sorted(map(str, keep_one(docs).collect()))
    assert sorted(map(str, keep_one(docs.unionByName(docs).unionByName(docs)).collect())) == once


def test_many_rows_of_one_id(spark):
    """Texts meet their own classes only, however many share an id or have none."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(300)]
    rows = spark.createDataFrame([(None, t + end) for t in texts for end in ("", " x")], "doc_id long, text string")
    classes = near_dup.classes_of(near_dup.signatures(rows))
    sets = near_dup.full_sets(rows, classes.select("vid", "row", "digest"))
    assert sets.count() == 600 and keep_one(rows).count() == 300
    joined = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "_key" in joined.split("Join")[1].split("\n")[0]


def test_linked_and_forest():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.int64)) for _ in range(30)]
    table = linked(sets)
    for i, j in combinations(range(30), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert table[i, j] == (100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both))
    assert (linked(sets[:10], sets[10:]) == table[:10, 10:]).all()
    roots = forest(np.array([[1, 1, 0, 0], [1, 1, 0, 1], [0, 0, 1, 0], [0, 1, 0, 1]], bool))
    assert roots.tolist() == [0, 0, 2, 0]


def test_estimates_pass_what_is_alike():
    rng = random.Random(9)
    for _ in range(30):
        words = [f"q{rng.randrange(10**6)}" for _ in range(200)]
        other = list(words)
        for _ in range(5):
            other[rng.randrange(200)] = "z"
        one, two = (packed(minima(shingle_set(" ".join(w).encode()))) for w in (words, other))
        far = packed(minima(shingle_set(" ".join(f"f{rng.randrange(10**6)}" for _ in range(200)).encode())))
        assert alike([one, two, far])[0].tolist() == [True, True, False]
