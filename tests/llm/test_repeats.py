import random
from collections import Counter

import numpy as np
import pytest

from storefront.llm import byte_repeats, count_min, word_repeats
from storefront.llm.byte_repeats import remove_repeated_bytes, repeated_starts
from storefront.llm.window_groups import ELSEWHERE, SETTLED, Groups, settle
from storefront.llm.word_repeats import Windows, remove_repeats

SPACES = " \t\n\x0b\x0c\r"


def covered(parts, size):
    """For each sequence, which elements a window covers that starts anywhere else too."""
    count = Counter(tuple(p[i : i + size]) for p in parts for i in range(len(p) - size + 1))
    out = []
    for p in parts:
        gone = [False] * len(p)
        for i in range(len(p) - size + 1):
            if count[tuple(p[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def plain_words(texts):
    keys = list(texts)
    words = [[w for w in "".join(" " if c in SPACES else c for c in texts[k] or "").split(" ") if w] for k in keys]
    rows = {}
    for key, own, gone in zip(keys, words, covered(words, 35)):
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        rows[key] = (len(own), sum(gone), kept)
    return rows


def plain_bytes(texts):
    keys = list(texts)
    data = [(texts[k] or "").encode() for k in keys]
    rows = {}
    for key, own, gone in zip(keys, data, covered(data, 200)):
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rows[key] = (len(own), sum(gone), runs, bytes(b for b, g in zip(own, gone) if not g))
    return rows


def test_words_against_all_windows(docs, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(docs).collect()}
    want = plain_words(texts)
    assert got == want and 0 < sum(w[1] for w in want.values()) < sum(w[0] for w in want.values())


def test_bytes_against_all_windows(docs, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeated_bytes(docs).collect()}
    want = plain_bytes(texts)
    assert got == want and any(w[2] > 1 for w in want.values())


def test_frequent_anchors_give_the_same(spark, docs, texts, monkeypatch):
    """All repeated anchors count as frequent, and tasks settle in small parts."""
    monkeypatch.setattr(byte_repeats, "FREQUENT", 2)
    monkeypatch.setattr(byte_repeats, "HELD", 1 << 12)
    rows = docs.where("doc_id >= 40 AND doc_id != 65")
    small = {n: t for n, t in texts.items() if n >= 40 and n != 65}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeated_bytes(rows).collect()}
    assert got == plain_bytes(small)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    part = "".join(rng.choice("abcdefgh") for _ in range(700))
    texts = {n: "".join(rng.choice("abcdefgh") for _ in range(1500)) + part * (n % 3) for n in range(6)}
    monkeypatch.setattr(byte_repeats, "PIECE", 300)
    found = [byte_repeats.ByteWindows(parts) for _, _, parts in byte_repeats.pieces_of([t.encode() for t in texts.values()])]
    assert sum(int((w.end - w.begin - 199).sum()) for w in found) == sum(len(t) - 199 for t in texts.values())
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeated_bytes(rows).collect()}
    assert got == {n: w[1] for n, w in plain_bytes(texts).items()}


@pytest.mark.parametrize("operator", [remove_repeats, remove_repeated_bytes])
def test_odd_tables(operator, odd_docs, no_docs):
    got = operator(odd_docs)
    assert got.count() == odd_docs.count() and operator(no_docs).count() == 0
    # the row that is there twice goes whole
    twice = [r for r in got.collect() if r["doc_id"] == 3]
    assert len(twice) == 2 and all(r["n_removed"] == r[1] for r in twice)


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merged_transforms(shards):
    rng = random.Random(shards)
    base = [bytes(rng.choice(b"ab") for _ in range(500)) for _ in range(2)]
    for _ in range(30):
        strings = {}
        for _ in range(rng.randrange(1, 12)):
            left, right = rng.randrange(169), rng.randrange(100, 201)
            x, y = bytearray(rng.choice(base)[:168]), bytearray(rng.choice(base)[200:400])
            for part in (x, y):
                if rng.random() < 0.5:
                    part[rng.randrange(len(part))] = rng.choice([99, 0])
            string = bytes(x[168 - left :]) + b"#" * 32 + bytes(y[:right])
            if len(string) >= 200:
                strings[string] = left
        if strings:
            flags = repeated_starts(list(strings), list(strings.values()), shards)
            count = Counter(s[i : i + 200] for s in strings for i in range(len(s) - 199))
            for string, own in zip(strings, flags):
                assert own.tolist() == [count[string[i : i + 200]] > 1 for i in range(len(string) - 199)]


def test_equal_windows_have_equal_anchors():
    words = " ".join(str(n % 50) for n in range(400))
    windows = Windows([words.encode(), ("other " * 3 + words).encode()])
    by_window = {}
    h1, h2 = windows.keys(np.arange(len(windows.starts)))
    for key, anchor in zip(zip(h1.tolist(), h2.tolist()), windows.anchors[windows.anchor_of].tolist()):
        assert by_window.setdefault(key, anchor) == anchor


def test_sketch_is_never_low(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 3000, 6000)
    rows = spark.createDataFrame([(str(v),) for v in values], "text string").repartition(7)

    def keys(texts):
        return np.array([int(t) if t else 0 for t in texts], np.uint64)

    found = count_min.sketch(rows, keys, (2, 4))
    count = np.bincount(values, minlength=3000)
    every = np.arange(3000).astype(np.uint64)
    assert found.repeated(every)[count >= 2].all() and not found.repeated(every)[count < 2].any()
    assert (found.reaches(every, 4) == (count >= 4)).all()


def test_a_full_sketch_gives_the_same(docs, texts):
    """A few cells for thousands of anchors: nearly all pass the filter, and the exact pass decides."""
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(docs, width_bits=8).collect()}
    assert got == plain_words(texts)
    small = docs.where("doc_id >= 52 AND doc_id != 65")
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeated_bytes(small, width_bits=8).collect()}
    assert found == plain_bytes({n: t for n, t in texts.items() if n >= 52 and n != 65})


def test_groups_over_batches():
    rng = np.random.default_rng(4)
    for _ in range(50):
        h1 = rng.integers(0, 20, 60)
        rows = [settle(h1[i : i + 20], np.zeros(20, np.int32), np.arange(i, i + 20), np.arange(20, dtype=np.int32)) for i in (0, 20, 40)]
        columns = [np.concatenate(c) for c in zip(*rows)]
        order = np.lexsort((columns[1], columns[0]))
        columns = [c[order] for c in columns]
        groups, found = Groups(), []
        for start in range(0, len(order), 7):
            found += groups.add(*(c[start : start + 7] for c in columns))[0].tolist()
        count = np.bincount(h1, minlength=20)
        assert sorted(found) == np.flatnonzero(count[h1] > 1).tolist()
    assert ELSEWHERE < 0 and SETTLED < 0
