import random

import pytest

from storefront.llm.decontam import EDITS, Index, banded_distance, drop_leaks, find_leaks, normal


def edit_distance(pattern, text):
    """Least edits between the pattern and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, count):
    out = list(text)
    for _ in range(count):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyz")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("xyz"))
    return "".join(out)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(4)
    return {n: " ".join(rng.choice(["alpha", "be", "gamma", "delta", "of", "the"]) + str(rng.randrange(60)) for _ in range(12 + 3 * n)) for n in range(6)}


def test_banded_distance_equals_the_full_table():
    rng = random.Random(5)
    for _ in range(60):
        pattern = "".join(rng.choice("ab") for _ in range(rng.randrange(3, 14)))
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 16)))
        got = banded_distance(pattern.encode(), text.encode(), -len(pattern), len(text), 99)
        assert got == edit_distance(pattern, text), (pattern, text)


def test_every_text_within_the_budget_is_found(items):
    """Against the full table of edits: all within the budget, none beyond it."""
    rng = random.Random(6)
    index = Index([(n, t.encode()) for n, t in items.items() if len(t) <= 256])
    texts = []
    for n, item in items.items():
        for count in (0, 1, len(item) // 20, len(item) // 12, len(item) // 8, len(item) // 4):
            around = " ".join(rng.choice(["some", "other", "words"]) for _ in range(rng.randrange(15)))
            texts.append(f"{around} {edited(rng, item, count)} {around}")
    found = index.search([t.encode() for t in texts])
    for text, got in zip(texts, found):
        low = normal(text.encode()).decode()
        want = [n for n, t in items.items() if len(t) <= 256 and edit_distance(t.lower(), low) <= int(len(t) * EDITS)]
        assert got == want, text


def test_case_and_white_space_do_not_hide(items):
    index = Index([(0, items[0].encode())])
    assert index.search([items[0].upper().replace(" ", "\n\t ").encode(), b"", b"short"]) == [[0], [], []]


def test_long_items_are_found_by_a_part():
    rng = random.Random(7)
    item = " ".join(f"t{rng.randrange(10_000)}" for _ in range(200))
    index = Index([(9, item.encode())])
    assert index.search([f"before {item[300:700]} after".encode(), item[:100].encode()]) == [[9], []]


def test_tables(spark, items, odd_docs, no_docs):
    bench = spark.createDataFrame([*items.items(), (7, None), (8, "tiny"), (None, items[1])], "item_id long, text string")
    rows = spark.createDataFrame(
        [(1, f"see {items[1]} there"), (2, None), (3, ""), (4, "nothing of it"), (5, f"{items[2]} {'w ' * 60_000} {items[3]}")],
        "doc_id long, text string",
    )
    for block_bytes in (10**6, 300):  # one block, several blocks
        found = {r["doc_id"]: r["item_ids"] for r in find_leaks(rows, bench, block_bytes).collect()}
        assert found == {1: [-1, 1], 2: [], 3: [], 4: [], 5: [2, 3]}
    assert sorted(r["doc_id"] for r in drop_leaks(rows, bench).collect()) == [2, 3, 4]
    assert drop_leaks(odd_docs, bench).columns == odd_docs.columns and find_leaks(no_docs, bench).count() == 0
    assert find_leaks(rows, bench.limit(0)).where("contaminated").count() == 0


def test_a_block_of_many_short_items():
    rng = random.Random(8)
    items = [(n, " ".join(f"{rng.randrange(10**6)}" for _ in range(7)).encode()) for n in range(40_000)]
    index = Index(items)
    assert index.search([b"x " + items[39_999][1] + b" y " + items[5][1], b"nothing"]) == [[5, 39_999], []]


SHORT = {
    1: "What is the capital of Burkina Faso",
    2: "Name a noble gas.",
    3: "12 x 12",
    4: "tiny",
    5: "東京の人口は",
    6: "a\u00e9b",
    7: "What is the capital of Burkina Faso",
    8: " \n ",
    9: "",
    10: "exactly eight and thirty-nine bytes ok.",
    11: "eightby8",
}


@pytest.mark.parametrize(
    "text, want",
    [
        ("He asked: WHAT is the\n\tcapital of Burkina  Faso? Nobody knew.", [1, 7]),
        ("What is the capital of Burkina Faso", [1, 7]),
        ("What is the capitol of Burkina Faso", []),
        ("What is the capital of Burkina Fasos", []),
        ("xWhat is the capital of Burkina Faso, What is the capital of Burkina Faso", [1, 7]),
        ("(name a noble gas.)", [2]),
        ("rename a noble gas.", []),
        ("say 12 x 12 = 144, tiny", [3, 4]),
        ("12 x 120 tinyness 112 x 12", []),
        ("今日、東京の人口はいくつ", [5]),
        ("aéb", [6]),
        ("éaéb aébé", []),
        ("exactly eight and thirty-nine bytes ok.", [10]),
        ("eightby8", [11]),
        ("eightby80", []),
        ("", []),
    ],
)
def test_short_items_are_searched_whole(text, want):
    index = Index([(n, t.encode()) for n, t in SHORT.items()])
    assert index.search([text.encode()]) == [want]
    assert index.search([b"x", text.encode(), b"y"]) == [[], want, []]


def test_short_items_do_not_reach_over_texts():
    index = Index([(1, b"ab cd"), (2, b"what is the time")])
    assert index.search([b"ab", b"cd", b"what is", b"the time"]) == [[]] * 4
    assert Index([(1, b"a\x00"), (2, b"x")]).search([b"a", b"x"]) == [[], [2]]


def test_short_items_of_one_id_are_all_named():
    index = Index([(-1, b"tiny"), (-1, b"small"), (5, b"small")])
    assert index.search([b"tiny and small", b"small"]) == [[-1, 5], [-1, 5]]


def test_short_items_equal_a_plain_search():
    rng = random.Random(9)
    words = ["be", "or", "not", "to", "gamma", "delta", "question"]
    items = {n: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for n in range(80)}
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)]
    index = Index([(n, t.encode()) for n, t in items.items() if len(t) < 40])
    want = [[n for n, t in items.items() if len(t) < 40 and f" {t} " in f" {text} "] for text in texts]
    assert index.search([t.encode() for t in texts]) == want


def test_a_short_question_copied_is_a_leak(spark):
    bench = spark.createDataFrame([(1, SHORT[1])], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"so: {SHORT[1]}?"), (2, "nothing")], "doc_id long, text string")
    assert {r["doc_id"]: r["item_ids"] for r in find_leaks(rows, bench).collect()} == {1: [1], 2: []}
    assert [r["doc_id"] for r in drop_leaks(rows, bench).collect()] == [2]
