import hashlib
import random
from collections import Counter
from functools import cache

import numpy as np
import pytest

from storefront.llm import csr
from storefront.llm.csr import Csr, product, products, starts, transposed
from storefront.llm.queries import op11_token_incidence
from storefront.llm.token_align import BYTE_BPE, PIECE_BPE, align_tokenizers, byte_coder, piece_coder, token_links

FOLDER = "/root/testdata/sf0.001"
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]
TEXTS = [
    None,
    "",
    " ",
    "Hello world, this is a test.",
    "  leading and   inner  spaces and trailing  ",
    "line one\nline two\r\n\n\ttabbed and　wide   end",
    "naïve café — 漢字かな交じり文 😀😀 ‍ \x00 \x1c \x85 x",
    "<|endoftext|> <s> </s> <unk> <0x0A> are plain text",
    "holds the mark ▁ of the pieces",
    "▁",
    "don't we'll I'M 12345 67,890.12 a_b-c/d\\e",
    "x" * 3000,
    "ab" * 700 + " " + "é" * 500,
    "combining é ́ ̈a",
    "Hello world, this is a test.",
]


@cache
def plain_coders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(BYTE_BPE)
    one.encode_special_tokens = True
    table = {}
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
        table[chr(b) if shown else chr(256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x) for x in range(b)))] = b
    return one, SentencePieceProcessor(model_file=PIECE_BPE), table, {i: t for t, i in one.get_vocab().items()}


def plain_tokens(text):
    one, two, table, names = plain_coders()
    a = one.encode(" " + text, add_special_tokens=False).ids
    b = two.encode(text)
    bytes_a = [bytes(table[c] for c in names[i]) for i in a]
    bytes_b = []
    for i in b:
        piece = two.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode())
    return a, b, bytes_a, bytes_b


def spans(parts):
    end = 0
    for p in parts:
        yield end, end + len(p)
        end += len(p)


def plain_align(texts):
    links, groups, shared = {}, {}, {}
    for n, text in enumerate(texts):
        links[n], groups[n], shared[n] = [], [], 0
        if not text:
            continue
        a, b, bytes_a, bytes_b = plain_tokens(text)
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            continue
        span_a, span_b = list(spans(bytes_a)), list(spans(bytes_b))
        first = 0
        for i, (s, e) in enumerate(span_a):
            while span_b[first][1] <= s:
                first += 1
            j = first
            while j < len(span_b) and span_b[j][0] < e:
                links[n].append((a[i], b[j]))
                j += 1
        at_a, at_b = 0, 0
        for cut in sorted({e for _, e in span_a} & {e for _, e in span_b}):
            group = ([], [])
            while at_a < len(a) and span_a[at_a][1] <= cut:
                group[0].append(a[at_a])
                at_a += 1
            while at_b < len(b) and span_b[at_b][1] <= cut:
                group[1].append(b[at_b])
                at_b += 1
            groups[n].append(group)
            shared[n] += len(group[0]) * len(group[1])
    count = Counter(p for x in links.values() for p in x)
    best = Counter()
    for (_, b), c in count.items():
        best[b] = max(best[b], c)
    out = {}
    for n in links:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups[n])
        out[n] = (
            sum(len(a) for a, _ in groups[n]),
            sum(len(b) for _, b in groups[n]),
            len(groups[n]),
            len(links[n]),
            sum(count[p] == best[p[1]] for p in links[n]),
            sum(count[p] for p in links[n]),
            hashlib.sha256(text.encode()).hexdigest() if groups[n] else "",
            shared[n],
        )
    return out


def dense(m):
    out = np.zeros((m.height, m.width), np.int64)
    for r in range(m.height):
        for k in range(m.ptr[r], m.ptr[r + 1]):
            out[r, m.idx[k]] += 1 if m.val is None else m.val[k]
    return out


def random_matrix(rng, height, width, valued):
    sizes = rng.integers(0, 5, height)
    idx = np.concatenate([rng.choice(width, s, replace=False) for s in sizes] + [np.zeros(0, np.int64)]).astype(np.int64)
    return Csr(starts(sizes), idx, width, rng.integers(1, 9, len(idx)) if valued else None)


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_products_against_dense(most):
    rng = np.random.default_rng(3)
    for valued in (False, True):
        left, right = random_matrix(rng, 30, 17, valued), random_matrix(rng, 17, 23, valued)
        assert (dense(product(left, right)) == dense(left) @ dense(right)).all()
        assert (dense(transposed(left)) == dense(left).T).all()
        parts = list(products(left, right, most))
        assert sum(len(p[0]) for p in parts) == np.count_nonzero(dense(left) @ dense(right))
        assert all((np.diff(p[0]) >= 0).all() for p in parts) and (most > 100 or len(parts) > 5)


@pytest.mark.parametrize("block", [1, 40, 1 << 23])
def test_against_plain_version(spark, block):
    """Also with blocks of one text and with links counted in pieces."""
    rng = random.Random(6)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta,", "gamma-delta", "Über", "x1", "\n"]) for _ in range(60)) for _ in range(12)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in align_tokenizers(rows, block=block).collect()}
    assert got == plain_align(texts)
    assert got[8][:6] == (0,) * 6 and got[7][0] > 0 and got[3] == got[14]


def test_a_group_of_very_many_tokens_costs_linear_time():
    """Tokens that never end together make one group: its links are counted, not laid out."""
    from storefront.llm.token_align import Coder, align_texts

    def coder(size, first):
        def encode(units):
            return [[0] * (first > 0) + [1] * ((len(u) - first) // size) + [0] * ((len(u) - first) % size) for u in units]

        return Coder(encode, [b"x", b"x" * size], np.array([1, size], np.int64))

    text = "x" * 400_001
    one, two = coder(2, 0), coder(2, 1)
    rows, _, _ = align_texts([text], Coder(lambda u: one.encode([x[1:] for x in u]), one.pieces, one.sizes), two)
    assert rows[0]["n_links"] == 0  # the blank in front comes back from neither
    plain = [b"x" * 2, b" x"]
    left = Coder(lambda u: [[1, *[0] * ((len(x) - 2) // 2)] for x in u], plain, np.array([2, 2], np.int64))
    right = Coder(lambda u: [[0, *[1] * ((len(x) - 2) // 2), 2] for x in u], [b" ", b"xx", b"x"], np.array([1, 2, 1], np.int64))
    rows, _, _ = align_texts([text], left, right)
    n = 200_001
    assert (rows[0]["n_a"], rows[0]["n_b"], rows[0]["n_groups"]) == (n, n + 1, 1)
    assert rows[0]["n_links"] == 2 * n and rows[0]["n_shared"] == n * (n + 1)


def test_links_as_rows(spark, monkeypatch):
    monkeypatch.setattr(csr, "SLICE", 5)
    texts = [t for t in TEXTS if t is None or len(t) < 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = plain_align(texts)
    for kind, figure in (("overlap", 3), ("group", 7)):
        count = Counter(r["doc_id"] for r in token_links(rows, kind).collect())
        assert {n: e[figure] for n, e in expected.items() if e[figure]} == dict(count)
    covered = {r["doc_id"]: r["n"] for r in token_links(rows).groupBy("doc_id").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "n").collect()}
    assert all(n == len((" " + texts[i]).encode()) for i, n in covered.items())
    with pytest.raises(ValueError):
        token_links(rows, "other")


def test_bytes_of_all_ids():
    one, two = byte_coder(BYTE_BPE), piece_coder(PIECE_BPE)
    assert len(one.pieces) == 50257 and len(two.pieces) == 32000
    assert one.pieces[220] == b" " and two.pieces[3] == b"\x00" and min(one.sizes.min(), two.sizes.min()) > 0


def test_query_on_its_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    ids = list(texts)
    rows = op11_token_incidence(spark, FOLDER).collect()
    expected = plain_align([texts[i] for i in ids])
    assert {r["doc_id"]: tuple(r[n] for n in NAMES) for r in rows} == {i: expected[n] for n, i in enumerate(ids)}


def test_odd_tables(spark, odd_docs, no_docs):
    rows = align_tokenizers(odd_docs)
    assert rows.count() == odd_docs.count() and rows.where("doc_id IS NULL").count() == 1
    assert align_tokenizers(no_docs).collect() == []
