"""A count-min sketch of 64-bit keys: partial sketches of tasks, merged cell by cell.

Counts stop at 255. The width is fixed, and so is the size of what is collected and
sent to the tasks: a bit per cell for each question asked of the sketch, 32 MB a
question. An estimate is never below the true count (or 255). A corpus of many more
keys than cells fills the sketch, which then tells few keys apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storefront.llm.common import chunks, distinct, text_bytes
from storefront.llm.hashing import mixed

ROWS = 2
WIDTH_BITS = 27
PIECE_BITS = 20  # cells that are merged in one place
HELD = 1 << 20  # keys a task counts before it sends them on
MOST = 255
SALTS = (np.uint64(0), np.uint64(0x632BE59BD9B4E019))


def cells(keys: np.ndarray, width_bits: int) -> Iterator[np.ndarray]:
    """The cell of each key in each row."""
    for salt in SALTS[:ROWS]:
        yield (mixed(keys ^ salt) >> np.uint64(64 - width_bits)).astype(np.int64)


@dataclass(frozen=True)
class Sketch:
    """What is asked of the merged sketch: which cells reach each of ``counts``, a bit per cell and row."""

    counts: tuple[int, ...]
    bits: np.ndarray
    width_bits: int

    def reaches(self, keys: np.ndarray, count: int) -> np.ndarray:
        """Which keys may occur ``count`` times."""
        out = np.ones(len(keys), bool)
        for row, at in zip(self.bits[self.counts.index(count)], cells(keys, self.width_bits)):
            out &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0
        return out

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        return self.reaches(keys, 2)


def _partial(keys: np.ndarray, width_bits: int, piece_bits: int) -> pa.RecordBatch:
    numbers, places, counts = [], [], []
    pieces = 1 << (width_bits - piece_bits)
    for row, at in enumerate(cells(keys, width_bits)):
        cell, count = distinct(at)
        count = np.minimum(count, MOST).astype(np.uint8)
        ends = np.searchsorted(cell, np.arange(1, pieces + 1) << piece_bits)
        for piece, (start, end) in enumerate(zip([0, *ends[:-1]], ends)):
            if end > start:
                numbers.append(row * pieces + piece)
                places.append((cell[start:end] & ((1 << piece_bits) - 1)).astype("<u4").tobytes())
                counts.append(count[start:end].tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())],
        ["piece", "cells", "counts"],
    )


def sketch(docs: DataFrame, keys_of: Callable[[list[bytes]], np.ndarray], counts: Sequence[int] = (2,), width_bits: int = WIDTH_BITS) -> Sketch:
    """The sketch of all keys of all texts; ``counts`` (at most 255 each) are those it will be asked for."""
    piece_bits = min(PIECE_BITS, width_bits)
    pieces = 1 << (width_bits - piece_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for start, end in chunks(texts):
                held.append(keys_of(texts[start:end]))
                if sum(map(len, held)) > HELD:
                    yield _partial(np.concatenate(held), width_bits, piece_bits)
                    held = []
        if held:
            yield _partial(np.concatenate(held), width_bits, piece_bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by piece; one piece is held at a time
        current, total = None, np.zeros(1 << piece_bits, np.uint8)

        def done() -> pa.RecordBatch:
            bits = zlib.compress(b"".join(np.packbits(total >= count).tobytes() for count in counts), 1)
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([bits], pa.binary())], ["piece", "bits"])

        for batch in batches:
            for n, piece in enumerate(batch.column("piece").to_pylist()):
                if piece != current:
                    if current is not None:
                        yield done()
                    current, total = piece, np.zeros(1 << piece_bits, np.uint8)
                cell = np.frombuffer(batch.column("cells")[n].as_buffer(), "<u4")
                more = np.frombuffer(batch.column("counts")[n].as_buffer(), np.uint8)
                total[cell] += np.minimum(more, MOST - total[cell])
        if current is not None:
            yield done()

    parts = docs.select("text").mapInArrow(count, "piece int, cells binary, counts binary")
    merged = parts.repartition(ROWS * pieces, "piece").sortWithinPartitions("piece")
    bits = np.zeros((len(counts), ROWS * pieces, 1 << (piece_bits - 3)), np.uint8)
    for row in merged.mapInArrow(merge, "piece int, bits binary").collect():
        bits[:, row["piece"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8).reshape(len(counts), -1)
    return Sketch(tuple(counts), bits.reshape(len(counts), ROWS, -1), width_bits)
