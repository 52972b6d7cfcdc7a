import random
import re

from pyspark.sql import functions as F

from storefront.llm.order_minhash import K, TUPLES, as_text, fingerprints, likeness, with_next


def rows_of(docs):
    got = fingerprints(docs).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("tuples")).alias("own"), as_text(F.col("edited_tuples")).alias("edited"),
        likeness(F.col("tuples"), F.col("edited_tuples")).alias("near_edited"), likeness(F.col("tuples"), F.col("next_tuples")).alias("near_next"),
        F.size("tuples").alias("n"),
    )
    return got.collect()


def plain_edits(texts):
    import hashlib

    ids, out = sorted(texts, reverse=True), {}
    for n, i in enumerate(ids):
        own, after = texts[i] or "", texts[ids[(n + 1) % len(ids)]] or ""
        half = len(own) // 2
        out[i] = (len(own), hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest())
    return out


def plain_units(run):
    """Pieces of 16 characters; characters of scripts without blanks alone."""
    piece = ""
    for c in run:
        alone = any(a <= ord(c) <= b for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x10FFFF)))
        if alone or len(piece) == 16:
            if piece:
                yield piece
            piece = ""
        if alone:
            yield c
        else:
            piece += c
    if piece:
        yield piece


def test_an_insertion_into_text_without_blanks(spark):
    """One character in front of thousands changes a few tuples, not all."""
    rng = random.Random(8)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4000))
    other = "".join(chr(rng.randrange(0x0E01, 0x0E3A)) for _ in range(4000))
    rows = spark.createDataFrame([(4, "我" + text), (3, text), (2, "ก" + other), (1, other)], "doc_id long, text string")
    near = {r["doc_id"]: r["near_next"] for r in rows_of(rows)}
    assert near[4] > 0.9 and near[2] > 0.9 and near[3] < 0.1


def test_against_a_plain_version(spark, docs, texts):
    """Selection, order and likeness from the k-mers' hashes, as Spark makes them, in plain Python."""
    rows = {r["doc_id"]: r for r in rows_of(docs)}
    assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in rows.items()} == plain_edits(texts)

    kmers = {}
    for i, text in texts.items():
        units = [u for run in re.findall(r"[^\x20\x09-\x0D]+", text or "") for u in plain_units(run)]
        own = [units[n : n + K] for n in range(len(units) - K + 1)] if len(units) >= K else [units] * bool(units)
        kmers[i] = own
    flat = sorted({tuple(k) for own in kmers.values() for k in own})
    table = spark.createDataFrame([(list(k),) for k in flat], "units array<string>")
    whole = F.xxhash64(*[F.get("units", F.lit(n)) for n in range(K)])
    hashed = table.select("units", F.when(F.size("units") >= K, whole).otherwise(F.xxhash64("units")).alias("h")).collect()
    hash_of = {tuple(r["units"]): r["h"] for r in hashed}
    numbered = {(h, n) for own in kmers.values() for k in [0] for h, n in _numbered(own, hash_of)}
    elements = spark.createDataFrame(sorted(numbered), "h long, n int").select("h", "n", F.xxhash64("h", "n").alias("e")).collect()
    element = {(r["h"], r["n"]): r["e"] for r in elements}
    chosen, pairs = {}, set()
    for i, own in kmers.items():
        least = {}
        for at, key in enumerate(_numbered(own, hash_of)):
            e = element[key]
            b = e & (2 * TUPLES - 1)
            if b not in least or e < least[b][0]:
                least[b] = (e, at)
        chosen[i] = []
        for t in range(TUPLES):
            two = sorted((least[b] for b in (2 * t, 2 * t + 1) if b in least), key=lambda x: x[1])
            chosen[i].append((two[0][0], two[-1][0]) if two else None)
        pairs |= {p for p in chosen[i] if p}
    made = spark.createDataFrame(sorted(pairs), "a long, b long").select("a", "b", (F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))
    sign = {(r["a"], r["b"]): r["s"] for r in made.collect()}
    ids = sorted(texts, reverse=True)
    for n, i in enumerate(ids):
        want = "".join(f"{sign[p]:08x}" if p else "-" * 8 for p in chosen[i])
        assert rows[i]["own"] == want
        after = chosen[ids[(n + 1) % len(ids)]]
        either = sum(a is not None or b is not None for a, b in zip(chosen[i], after))
        same = sum(a is not None and b is not None and sign[a] == sign[b] for a, b in zip(chosen[i], after))
        assert rows[i]["near_next"] == (same / either if either else 1.0)


def _numbered(kmers, hash_of):
    seen, out = {}, []
    for k in kmers:
        h = hash_of[tuple(k)]
        seen[h] = seen.get(h, 0) + 1
        out.append((h, seen[h]))
    return out


def test_order_counts(spark):
    """The same parts in another order are less alike than a few edits make them."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    blocks = [words[i : i + 30] for i in range(0, 600, 30)]
    rng.shuffle(blocks)
    few = list(words)
    for _ in range(6):
        few[rng.randrange(600)] = "x"
    texts = {3: " ".join(words), 2: " ".join(few), 1: " ".join(words), 0: " ".join(w for b in blocks for w in b)}
    near = {r["doc_id"]: r["near_next"] for r in rows_of(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))}
    assert near[3] == near[2] > 0.8 and near[1] < near[2] - 0.2


def test_odd_tables(spark, odd_docs, no_docs):
    rows = rows_of(odd_docs)
    assert len(rows) == odd_docs.count() and all(r["n"] == TUPLES for r in rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert rows_of(no_docs) == []
    alone = rows_of(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string"))
    assert [(r["near_next"], r["n_chars"]) for r in alone] == [(1.0, 11)]
    twins = [r["own"] for r in rows if r["doc_id"] == 3]
    assert len(twins) == 2 and twins[0] == twins[1]


def test_next_in_any_layout(spark):
    rows = spark.createDataFrame([(n * n, f"text {n}") for n in range(300)], "doc_id long, text string")
    for parts in (1, 7, 400):
        got = {r["doc_id"]: r["next_text"] for r in with_next(rows, parts).where("NOT filler").collect()}
        assert got == {n * n: f"text {(n - 1) % 300}" for n in range(300)}
