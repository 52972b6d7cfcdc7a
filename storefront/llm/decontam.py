"""Benchmark items in documents, whole or lightly edited, by the q-gram lemma.

An item of m bytes within k edits of a stretch of text shares at least
m + 1 - q - k q of its q-grams with it, all on diagonals (position in the text
minus position in the item) that drift by k at most. So shared q-grams are counted
in diagonal bands that overlap by half: whatever drifts by k lies in one band
whole. Bands that reach the bound are the only regions left; each is verified by
an alignment that keeps to its diagonals. The filter loses none.

Texts are compared in lower case (A-Z) and with any run of white space as one
space; edits count in bytes of UTF-8. Items over ``PIECE`` bytes are searched in
pieces that overlap by half; items under ``LEAST`` bytes after that are searched
whole, without edits and on word bounds, by all their q-grams, and those of less
than a q-gram by their bytes.

The benchmark may be of any size: its items are dealt into blocks of bounded bytes,
and each block's index, whose size is so bounded, goes to the tasks; texts are read
once for all blocks and never shuffled.

Defined cases: a null or empty text has no items; null items and items of white
space alone are not searched;
equal items are all named; an empty benchmark finds nothing; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storefront.llm.common import chunks, distinct, text_bytes

Q = 8
EDITS = 0.1
PIECE = 256
LEAST = 40
BLOCK_BYTES = 2_000_000
TABLE_BITS = 22
HALF_BITS = 34  # of a half band; a place has 8, which leaves 21 for a block's pieces
MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def pieces_of(text: bytes, piece: int = PIECE) -> list[bytes]:
    """The text itself, or pieces of ``piece`` bytes that overlap by half."""
    if len(text) <= piece:
        return [text]
    starts = [*range(0, len(text) - piece, piece // 2), len(text) - piece]
    return [text[s : s + piece] for s in starts]


def q_grams(data: bytes) -> np.ndarray:
    """The eight bytes from each position as a number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", data, 0, (1,))


def joins(char: str) -> bool:
    """Whether a word goes on at this character; scripts without blanks have no such bounds."""
    return (char.isalnum() or char == "_") and not (
        char >= "\u2e80" or "\u0e00" <= char <= "\u0eff" or "\u1000" <= char <= "\u109f" or "\u1780" <= char <= "\u17ff"
    )


def on_bounds(text: bytes, start: int, end: int) -> bool:
    """Whether no word goes on over the ends of ``text[start:end]``."""
    for at in (start, end):
        before = text[max(0, at - 4) : at].decode(errors="ignore")[-1:]
        after = text[at : at + 4].decode(errors="ignore")[:1]
        if before and after and joins(before) and joins(after):
            return False
    return True


class Index:
    """Where each q-gram occurs in the pieces of one block of items."""

    def __init__(self, items: list[tuple[int, bytes]], edits: float = EDITS) -> None:
        self.items, self.pieces = [], []
        tiny: dict[bytes, list[int]] = {}
        for item, text in sorted(items):
            for piece in pieces_of(normal(text)):
                if len(piece) >= Q:
                    self.items.append(item)
                    self.pieces.append(piece)
                elif piece:
                    tiny.setdefault(piece, []).append(item)
        # items of less than a q-gram: for each length their codes in order, and their ids
        self.tiny: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in {len(piece) for piece in tiny}:
            coded = sorted((int.from_bytes(p, "little"), ids) for p, ids in tiny.items() if len(p) == size)
            self.tiny[size] = np.array([c for c, _ in coded], np.uint64), [ids for _, ids in coded]
        lengths = np.array([len(p) for p in self.pieces], np.int64)
        # a larger budget would leave no q-gram to count
        self.budget = np.minimum((lengths * edits).astype(np.int64), (lengths - Q) // Q)
        self.budget[lengths < LEAST] = 0
        self.need = np.maximum(lengths + 1 - Q - self.budget * Q, 1)
        grams = [q_grams(p) for p in self.pieces]
        codes = np.concatenate([np.zeros(0, np.uint64), *grams])
        piece = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(codes, kind="stable")
        self.piece, self.place = piece[order].astype(np.int32), place[order].astype(np.int32)
        self.codes, self.starts = np.unique(codes[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(codes)))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.slot(self.codes)] = True

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return ((codes * MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position in ``data``, piece and place in it, of all shared q-grams."""
        codes = q_grams(data)
        at = np.flatnonzero(self.table[self.slot(codes)])
        found = np.searchsorted(self.codes, codes[at])
        found[found == len(self.codes)] = 0
        real = self.codes[found] == codes[at] if len(self.codes) else np.zeros(0, bool)
        at, found = at[real], found[real]
        times = self.counts[found]
        ends = np.cumsum(times)
        entry = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times) + np.repeat(
            self.starts[found], times
        )
        return np.repeat(at, times), self.piece[entry].astype(np.int64), self.place[entry].astype(np.int64)

    def search(self, texts: list[bytes]) -> list[list[int]]:
        """For each text, the items found in it, in order."""
        out: list[list[int]] = [[] for _ in texts]
        if not self.pieces and not self.tiny:
            return out
        plain = [normal(t) for t in texts]
        for first, last in chunks(plain):
            part = plain[first:last]
            data = b"\x00".join(part)
            starts = np.cumsum([0, *(len(t) + 1 for t in part)])
            for at, size, found in self.tiny_hits(data):
                d = int(np.searchsorted(starts, at, side="right")) - 1
                begin, known = at - int(starts[d]), out[first + d]
                new = [item for item in found if item not in known]
                if new and begin + size <= len(part[d]) and on_bounds(part[d], begin, begin + size):
                    known.extend(dict.fromkeys(new))
            for piece, band in self.regions(data):
                low, high = self.diagonals(piece, band)
                docs = np.searchsorted(starts, [max(low, 0), high + len(self.pieces[piece])], side="right") - 1
                item = self.items[piece]
                for d in range(docs[0], min(docs[1] + 1, len(part))):
                    begin = int(starts[d])
                    if item not in out[first + d] and self.verify(part[d], piece, low - begin, high - begin):
                        out[first + d].append(item)
        return [sorted(found) for found in out]

    def tiny_hits(self, data: bytes) -> Iterator[tuple[int, int, list[int]]]:
        """Position, length and ids of all items of less than a q-gram in ``data``."""
        grams = q_grams(data + b"\x00" * (Q - 1)) if self.tiny else None
        for size, (codes, ids) in self.tiny.items():
            cut = grams & np.uint64((1 << 8 * size) - 1)
            entry = np.minimum(np.searchsorted(codes, cut), len(codes) - 1)
            at = np.flatnonzero(codes[entry] == cut)
            for position, n in zip(at.tolist(), entry[at].tolist()):
                yield position, size, ids[n]

    def regions(self, data: bytes) -> list[tuple[int, int]]:
        """Pieces and diagonal bands in which enough places of the piece are shared."""
        at, piece, place = self.hits(data)
        half = (at - place + PIECE) // (self.budget[piece] + 1)  # never below 0
        # piece, half band and place in one number; a place counts once
        keys, _ = distinct((((piece << HALF_BITS) | half) << 8) | place)
        cells, count = distinct(keys >> 8)
        both = count.copy()
        if len(count) > 1:
            both[:-1] += np.where(cells[1:] == cells[:-1] + 1, count[1:], 0)
        good = cells[both >= self.need[cells >> HALF_BITS]]
        return [(int(c >> HALF_BITS), int(c & ((1 << HALF_BITS) - 1))) for c in good]

    def diagonals(self, piece: int, band: int) -> tuple[int, int]:
        """The band's first and last diagonal, with room for the drift."""
        budget = int(self.budget[piece])
        return band * (budget + 1) - PIECE - budget, (band + 2) * (budget + 1) - PIECE + budget

    def verify(self, text: bytes, piece: int, low: int, high: int) -> bool:
        """Whether the piece is within its budget of some stretch on these diagonals."""
        pattern, budget = self.pieces[piece], int(self.budget[piece])
        if len(pattern) < LEAST:
            at = text.find(pattern, max(0, low), max(0, high + len(pattern)))
            while at >= 0 and not on_bounds(text, at, at + len(pattern)):
                at = text.find(pattern, at + 1, max(0, high + len(pattern)))
            return at >= 0
        if pattern in text[max(0, low) : max(0, high + len(pattern))]:
            return True
        return banded_distance(pattern, text, low, high, budget) <= budget


def banded_distance(pattern: bytes, text: bytes, low: int, high: int, limit: int) -> int:
    """Least edits between ``pattern`` and a stretch of ``text``, on diagonals ``low``..``high``.

    Row i holds the cells (i, i + d) for each diagonal d. Stops once all cells of
    a row are over ``limit``.
    """
    far = len(pattern) + high - low + 2
    diagonals = np.arange(low, high + 1)
    size = len(diagonals)
    symbols = np.frombuffer(pattern, np.uint8)
    padded = np.zeros(size + len(pattern), np.int16) - 1  # text[low + x], -1 outside
    inner_low, inner_high = max(0, low), min(len(text), low + len(padded))
    if inner_high > inner_low:
        padded[inner_low - low : inner_high - low] = np.frombuffer(text, np.uint8)[inner_low:inner_high]
    row = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)
    steps = np.arange(size)
    for i in range(1, len(pattern) + 1):
        column = diagonals + i
        same = padded[i - 1 : i - 1 + size] == symbols[i - 1]
        best = row + np.where(same, 0, 1)  # both move on
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)  # a byte of the pattern is extra
        best = np.where((column >= 0) & (column <= len(text)), best, far)
        best[column == 0] = np.minimum(best[column == 0], i)
        best = np.minimum.accumulate(best - steps) + steps  # a byte of the text is extra
        best = np.where((column >= 0) & (column <= len(text)), best, far)
        row = best
        if row.min() > limit:
            return int(row.min())
    return int(row.min())


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[Index]:
    """The benchmark's items in blocks of about ``block_bytes`` bytes of text."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("text"), F.lit(count))
    out = []
    for n in range(count):
        rows = items.where(block == n).collect()
        out.append(Index([(-1 if r["item_id"] is None else r["item_id"], r["text"].encode()) for r in rows]))
    return out


def _searched(text: Column, index: Broadcast) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def search(texts: pa.Array) -> pa.Array:
        return pa.array(index.value.search(text_bytes(texts)), pa.list_(pa.int64()))

    return search(text)


def found_items(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Column:
    """A column with the ids of the items that ``text`` holds, in order."""
    context = docs.sparkSession.sparkContext
    found = [_searched(F.col("text"), context.broadcast(index)) for index in blocks_of(benchmark, block_bytes)]
    return found[0] if len(found) == 1 else F.array_sort(F.array_distinct(F.concat(*found)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids`` of each document."""
    rows = docs.select("doc_id", found_items(docs, benchmark, block_bytes).alias("item_ids"))
    count = F.size("item_ids")
    return rows.select("doc_id", (count > 0).alias("contaminated"), count.cast("long").alias("n_items"), "item_ids")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, as they are."""
    return docs.where(F.size(found_items(docs, benchmark, block_bytes)) == 0)
