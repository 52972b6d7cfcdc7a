"""Alignment of two tokenizers over the same bytes.

Tokens of each side are rows of a sparse matrix over the bytes of a text, A and B. Row
products A x B' give the overlap links: pairs of tokens with bytes in common. Where
tokens of both sides end, the text is cut into groups; the products of the tokens'
matrices over groups give the links within a group. Both are hand-built compressed
rows (``csr``), multiplied row by row.

Texts are read in units that neither tokenizer looks across (up to a blank before which
and after which there is none), so equal units of a block of texts are encoded once. A
task keeps of each text its pairs of ids as numbers into the block's list of pairs. Only
those lists are shuffled to count a pair over the corpus; the counts return to the
blocks they came from, where the texts' rows meet them in a stream. No text leaves the
task that reads it, and no table of counts is broadcast: a block gets its own pairs.

Defined cases: a null or empty text has no tokens, nor has one whose bytes do not come
back from the tokens of either side; such rows have zeros and a blank hash, and add to
no count. Repeated rows, equal and null ids each give a row of their own; an empty
table gives no rows; extra columns are not read. A single text is one block at least.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.llm.common import stored
from storefront.llm.csr import Csr, labels, product, products, runs, spread, starts, transposed

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text that a block holds, if no single text is longer.
BLOCK = 1 << 23
#: Units handed to a tokenizer at once, and how many of them in a row.
CHUNK, ROW = 1 << 14, 1 << 7
_UNITS = re.compile(r"(?<=\S)(?= \S)")


@dataclass(frozen=True)
class Coder:
    """One side: ids of texts, and the bytes each id stands for."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: list[bytes]
    sizes: np.ndarray

    def tokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, how many each has, and whether its bytes come back.

        Units are handed on many in a row where that makes no difference, which the bytes of
        their tokens tell; the others one by one.
        """
        plain = [u.encode() for u in units]
        alone = np.array([u[-1:].isspace() or u[1:2].isspace() or len(u) < 2 for u in units], bool)
        together = np.flatnonzero(~alone)
        ids, counts, order = [], [], []
        for at in range(0, len(together), CHUNK):
            some = together[at : at + CHUNK].tolist()
            rows = [some[n : n + ROW] for n in range(0, len(some), ROW)]
            flat = np.array([i for x in self.encode(["".join([units[n] for n in row]) for row in rows]) for i in x], np.int64)
            ends = np.cumsum(np.fromiter((len(plain[n]) for n in some), np.int64, len(some)))
            reached = np.cumsum(self.sizes[flat])
            last = np.searchsorted(reached, ends)
            if len(reached) and reached[-1] == ends[-1] and (reached[last] == ends).all() and self._back(flat.tolist()) == b"".join([plain[n] for n in some]):
                ids.append(flat)
                counts.append(np.diff(last + 1, prepend=0))
                order.append(together[at : at + CHUNK])
            else:
                alone[some] = True
        valid = ~alone
        single = np.flatnonzero(alone)
        for at in range(0, len(single), CHUNK):
            some = single[at : at + CHUNK]
            found = self.encode([units[n] for n in some.tolist()])
            ids.append(np.array(list(chain.from_iterable(found)), np.int64))
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            order.append(some)
            valid[some] = [self._back(x) == plain[n] for x, n in zip(found, some.tolist())]
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), valid
        place = np.argsort(np.concatenate(order))
        flat, many = np.concatenate(ids), np.concatenate(counts)
        return flat[spread(starts(many), place)[0]], many[place], valid

    def _back(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


def _byte_alphabet() -> dict[str, int]:
    """Which character stands for which byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def _coder(encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes]) -> Coder:
    return Coder(encode, pieces, np.array([len(p) for p in pieces], np.int64))


@lru_cache(maxsize=4)
def byte_coder(path: str) -> Coder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark spreads the work
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    alphabet = _byte_alphabet()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        pieces[number] = bytes(alphabet[c] for c in token if c in alphabet)

    def encode(units: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    return _coder(encode, pieces)


@lru_cache(maxsize=4)
def piece_coder(path: str) -> Coder:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        bytes([int(p[3:5], 16)]) if model.is_byte(n) else p.replace("▁", " ").encode()
        for n, p in ((n, model.id_to_piece(n)) for n in range(model.get_piece_size()))
    ]

    def encode(units: list[str]) -> list[list[int]]:
        # the model puts a blank before what it reads
        return model.encode([u[1:] for u in units], num_threads=1)

    return _coder(encode, pieces)


@dataclass(frozen=True)
class Aligned:
    """The distinct units of a block: tokens of both sides, links and groups, in order of units."""

    valid: np.ndarray  # whether the bytes of a unit come back
    a: np.ndarray
    b: np.ndarray
    a_ptr: np.ndarray
    b_ptr: np.ndarray
    links: Csr  # A x B'
    group_a: np.ndarray
    group_b: np.ndarray
    n_groups: int

    def groups(self) -> tuple[Csr, Csr]:
        """The incidence of tokens and groups, one matrix a side."""
        return labels(self.group_a, self.n_groups), labels(self.group_b, self.n_groups)


def align(units: Sequence[str], one: Coder, two: Coder) -> Aligned:
    """Tokens, links and groups of units that each begin with a blank."""
    (a, many_a, valid_a), (b, many_b, valid_b) = one.tokens(list(units)), two.tokens(list(units))
    valid = valid_a & valid_b
    if not valid.all():  # those that do not come back have no tokens
        a, b = a[np.repeat(valid, many_a)], b[np.repeat(valid, many_b)]
        many_a, many_b = many_a * valid, many_b * valid
    over_a, over_b = runs(one.sizes[a]), runs(two.sizes[b])
    links = product(over_a, transposed(over_b))
    ends = np.zeros(over_b.width + 1, bool)
    ends[over_b.ptr] = True
    cuts = over_a.ptr[1:][ends[over_a.ptr[1:]]]
    group_a, group_b = (np.searchsorted(cuts, m.ptr[1:]) for m in (over_a, over_b))
    return Aligned(valid, a, b, starts(many_a), starts(many_b), links, group_a, group_b, len(cuts))


def group_texts(found: Aligned, names_a: tuple[np.ndarray, np.ndarray], names_b: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Each unit as ``a1,a2|b1;a3|b2,b3;``: ids of both sides by group.

    ``names_a`` and ``names_b``: for each id its text when more of its side follow in the group, and when not.
    """

    def named(ids: np.ndarray, group: np.ndarray, names: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        last = np.append(group[1:] != group[:-1], True)[: len(group)]
        return np.where(last, names[1][ids], names[0][ids])

    of_a, of_b = (starts(np.bincount(g, minlength=found.n_groups)) for g in (found.group_a, found.group_b))
    merged = np.empty(len(found.a) + len(found.b), object)
    merged[np.arange(len(found.a)) + of_b[found.group_a]] = named(found.a, found.group_a, names_a)
    merged[np.arange(len(found.b)) + of_a[found.group_b + 1]] = named(found.b, found.group_b, names_b)
    bounds, parts = (found.a_ptr + found.b_ptr).tolist(), merged.tolist()
    return ["".join(parts[start:end]) for start, end in zip(bounds, bounds[1:])]


@lru_cache(maxsize=8)
def _names(count: int, end: str) -> tuple[np.ndarray, np.ndarray]:
    return np.array([f"{n}," for n in range(count)], object), np.array([f"{n}{end}" for n in range(count)], object)


def align_texts(texts: Sequence[str | None], one: Coder, two: Coder) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """For each text its figures and its pairs of ids; the pairs of all, and how often each is linked.

    A pair is ``a * (number of B's ids) + b``; a text's ``pairs`` are places in the list.
    """
    parts = [_UNITS.split(" " + t) if t else [] for t in texts]
    bounds = starts(np.array([len(p) for p in parts], np.int64)).tolist()
    place, units = pd.factorize(np.array([*chain.from_iterable(parts), None], object)[:-1])
    del parts
    coded = [place[start:end] for start, end in zip(bounds, bounds[1:])]
    found = align(units.tolist(), one, two)
    n_a, n_b = np.diff(found.a_ptr), np.diff(found.b_ptr)
    unit_links = np.diff(found.links.ptr[found.a_ptr])
    firsts = np.searchsorted(found.group_a, np.arange(found.n_groups))  # the first token of each group
    n_groups = np.diff(np.searchsorted(firsts, found.a_ptr))
    # a row of the product over groups has as many entries as its group has tokens of the other side
    by_a, by_b = found.groups()
    shared = np.diff(transposed(by_b).ptr)[by_a.idx]
    n_shared = np.diff(starts(shared)[found.a_ptr])
    named = group_texts(found, _names(len(one.pieces), "|"), _names(len(two.pieces), ";"))

    a_of = np.repeat(found.a, np.diff(found.links.ptr))
    place, pairs = pd.factorize(a_of * len(two.pieces) + found.b[found.links.idx])
    valid = [len(c) > 0 and bool(found.valid[c].all()) for c in coded]
    coded = [c if ok else c[:0] for c, ok in zip(coded, valid)]
    texts_units = Csr(starts(np.array([len(c) for c in coded], np.int64)), np.concatenate([*coded, np.zeros(0, np.int64)]).astype(np.int64), len(units))
    units_pairs = Csr(starts(unit_links), place.astype(np.int64), len(pairs))
    totals = np.zeros(len(pairs), np.int64)
    rows: list[dict] = []
    for c, ok in zip(coded, valid):
        text = "".join([named[u] for u in c.tolist()])[:-1] if ok else ""
        row = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": unit_links, "n_shared": n_shared}
        row = {k: int(v[c].sum()) for k, v in row.items()}
        none = np.zeros(0, np.int32)
        rows.append(row | {"groups_sha256": hashlib.sha256(text.encode()).hexdigest() if ok else "", "pairs": none, "times": none})
    for text, pair, times in products(texts_units, units_pairs):
        totals += np.bincount(pair, weights=times, minlength=len(pairs)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        for n, start, end in zip(text[new].tolist(), new.tolist(), [*new[1:].tolist(), len(text)]):
            rows[n]["pairs"], rows[n]["times"] = pair[start:end].astype(np.int32), times[start:end].astype(np.int32)
    return rows, pairs, totals


_FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def encoded_blocks(docs: DataFrame, byte_bpe: str, piece_bpe: str, block: int) -> DataFrame:
    """Rows of texts, and one row a block with its ``codes`` (pairs of ids) and their ``totals``."""
    schema = (
        "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, "
        "pairs array<int>, times array<int>, codes array<long>, totals array<long>"
    )
    kinds = [pa.int64()] * 7 + [pa.string()] + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] * 2
    names = ["block", "doc_id", *_FIGURES, "groups_sha256", "pairs", "times", "codes", "totals"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_coder(byte_bpe), piece_coder(piece_bpe)
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[str | None] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            rows, pairs, totals = align_texts(texts, one, two)
            columns = [[number] * len(rows), list(ids), *([r[n] for r in rows] for n in names[2:10]), *[[None] * len(rows)] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            columns = [[number], *[[None]] * 9, [pairs], [totals]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            number, size = number + 1, 0
            ids.clear()
            texts.clear()

        for batch in batches:
            for n in range(batch.num_rows):
                text = batch.column("text")[n].as_py()
                ids.append(batch.column("doc_id")[n].as_py())
                texts.append(text)
                size += len(text or "") + 1
                if size >= block:
                    yield from done()
        if texts:
            yield from done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)


def align_tokenizers(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared`` of each row.

    Tokens of both sides, groups, overlap links; ``n_best`` of the links join a pair that
    is linked as often in the corpus as any of its B id, ``count_sum`` adds up how often
    the links' pairs are; ``n_shared`` are the links of tokens within one group.
    """
    rows = stored(encoded_blocks(docs, byte_bpe, piece_bpe, block))
    lists = rows.where("codes IS NOT NULL")
    told = lists.select("block", F.posexplode(F.arrays_zip("codes", "totals")).alias("place", "_pair"))
    told = told.select("block", "place", F.col("_pair.codes").alias("code"), F.col("_pair.totals").alias("n"))
    side = F.col("code") % F.lit(len(piece_coder(piece_bpe).pieces))
    counts = stored(told.groupBy("code").agg(F.sum("n").alias("count")).withColumn("b", side))
    best = counts.groupBy("b").agg(F.max("count").alias("_most"))
    known = counts.join(best, "b").select("code", "count", (F.col("count") == F.col("_most")).alias("best"))
    answers = told.select("block", "place", "code").join(known, "code").select("block", "place", "count", "best")
    texts = rows.where("codes IS NULL").drop("codes", "totals")
    met = texts.unionByName(answers, allowMissingColumns=True).repartition("block")
    met = met.sortWithinPartitions("block", F.col("place").asc_nulls_last())
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts, best = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column("block").to_numpy()
            answer = batch.column("place").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((number[1:] != number[:-1]) | (answer[1:] != answer[:-1])) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if number[start] != current:
                    current, counts, best = number[start], [], []
                part = batch.slice(start, end - start)
                if answer[start]:
                    counts.append(part.column("count").to_numpy())
                    best.append(part.column("best").to_numpy(zero_copy_only=False).astype(bool))
                    continue
                counts, best = ([np.concatenate([*x, np.zeros(0, t)])] for x, t in ((counts, np.int64), (best, bool)))
                pairs, times = part.column("pairs"), part.column("times")
                flat, times = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
                sizes = pairs.value_lengths().to_numpy()
                ptr = starts(sizes)
                sums, hits = (starts(v)[ptr] for v in (times * counts[0][flat], times * best[0][flat]))
                own = {n: part.column(n) for n in names if n not in ("n_best", "count_sum")}
                own |= {"n_best": pa.array(np.diff(hits), pa.int64()), "count_sum": pa.array(np.diff(sums), pa.int64())}
                yield pa.RecordBatch.from_arrays([own[n] for n in names], names)

    kinds = [f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in names]
    return met.mapInArrow(score, ", ".join(kinds))


def token_links(
    docs: DataFrame, kind: str = "overlap", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE
) -> DataFrame:
    """``doc_id, a_place, a_id, b_place, b_id, weight``: a row for each link of each text.

    ``kind`` is ``overlap`` (``weight``: bytes in common) or ``group`` (tokens of one group, weight 1).
    """
    if kind not in ("overlap", "group"):
        raise ValueError("kind must be 'overlap' or 'group'")
    names = ["doc_id", "a_place", "a_id", "b_place", "b_id", "weight"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_coder(byte_bpe), piece_coder(piece_bpe)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                found = align(_UNITS.split(" " + text), one, two)
                if not found.valid.all():
                    continue
                by_a, by_b = found.groups()
                right = transposed(by_b)
                parts = products(by_a, right) if kind == "group" else [_entries(found.links)]
                for a, b, weight in parts:
                    columns = [pa.array([doc_id] * len(a), pa.int64()), *map(pa.array, (a, found.a[a], b, found.b[b], weight))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, ", ".join(f"{n} long" for n in names))


def _entries(m: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(np.arange(m.height), np.diff(m.ptr)), m.idx, m.val
