"""Repeated word windows, found exactly behind a count-min sketch, and removed.

A window is ``WINDOW`` consecutive words. Its anchor is the least hash among its
``GRAM``-word grams, so equal windows have equal anchors, and neighbouring windows
mostly share one: there is about one anchor place to a dozen windows.

Pass 1 counts anchor places in count-min sketches, one per task, which are merged
cell by cell; the estimate for its anchor is never below the count of a window.
Pass 2 reads the texts again and takes up only windows whose anchor is estimated
to occur twice; those are grouped exactly, by 96 bits of hash. None is lost: a low
estimate proves that a window is alone. Pass 3 takes the covered words out.

The sketch has a fixed width, and so has what is sent to the tasks; a corpus that fills
it lets more windows through to the exact pass, with the same result. Windows that repeat within what a task holds are
settled there, and it sends each of them on once, so a passage that stands in every
document costs one row per task.

Defined cases: a null or blank text has no words; texts of fewer words than a
window keep all; rows with equal ``doc_id`` and text are two places of each window;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.llm.common import chunks, text_bytes
from storefront.llm.count_min import WIDTH_BITS, sketch
from storefront.llm.hashing import mixed
from storefront.llm.window_groups import Groups, settle

WINDOW = 35
GRAM = 12
HELD = 1 << 20  # windows a task settles at once
GOLD = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xD6E8FEB86659FD93)


def joined(left: np.ndarray, right: np.ndarray, offset: int) -> np.ndarray:
    """Hashes of spans of words, from those of two parts, the second ``offset`` words on."""
    count = max(0, min(len(left), len(right) - offset))
    return mixed(left[:count] * GOLD + right[offset : offset + count])


def spans(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words from each position."""
    powers, size = {1: hashes}, 1
    while size * 2 <= length:
        powers[size * 2] = joined(powers[size], powers[size], size)
        size *= 2
    out, have = powers[size], size
    while have < length:
        size = 1 << ((length - have).bit_length() - 1)
        out = joined(out, powers[size], have)
        have += size
    return out


class Windows:
    """The windows of some texts: their places, anchors and hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        words = [t.split() for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.hashes = np.fromiter(
            map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(lengths.sum())
        )
        owner = np.repeat(np.arange(len(texts)), lengths)
        first = np.cumsum(lengths) - lengths
        count = max(0, len(owner) - WINDOW + 1)
        self.starts = np.flatnonzero(owner[:count] == owner[len(owner) - count :])
        self.owner = owner[self.starts]
        self.place = self.starts - first[self.owner]
        grams = spans(self.hashes, GRAM)
        within = WINDOW - GRAM + 1
        if len(self.starts):
            least = np.lib.stride_tricks.sliding_window_view(grams, within)
            at = least[: count].argmin(axis=1)[self.starts] + self.starts
        else:
            at = self.starts
        #: For each window, the number of its anchor place; for each anchor place, its hash.
        new = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
        self.anchor_of = np.cumsum(new) - 1
        self.anchors = grams[at[new]]

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each chosen window, the second never below 0."""
        at = self.starts[chosen]
        first, second = spans(self.hashes, WINDOW)[at], spans(mixed(self.hashes ^ SECOND), WINDOW)[at]
        return first.view(np.int64), (second >> np.uint64(33)).astype(np.int32)


def anchors_of(texts: list[bytes]) -> np.ndarray:
    return Windows(texts).anchors


def repeated_windows(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """``row_key, place`` of each window that stands elsewhere too; ``docs`` has row_key and text."""
    names = ["h1", "h2", "row_key", "place"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]

    def settled(parts: list[tuple]) -> pa.RecordBatch:
        columns = settle(*(np.concatenate(p) for p in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def take_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            for start, end in chunks(texts):
                windows = Windows(texts[start:end])
                chosen = np.flatnonzero(shared.value.repeated(windows.anchors)[windows.anchor_of])
                if len(chosen):
                    h1, h2 = windows.keys(chosen)
                    owners = keys[start:end][windows.owner[chosen]]
                    held.append((h1, h2, owners, windows.place[chosen].astype(np.int32)))
                    size += len(chosen)
                if size > HELD:
                    yield settled(held)
                    held, size = [], 0
        if held:
            yield settled(held)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups()
        for batch in batches:
            found = groups.add(*(batch.column(n).to_numpy(zero_copy_only=False) for n in names))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int32())], names[2:])

    rows = docs.select("row_key", "text").mapInArrow(take_up, "h1 long, h2 int, row_key long, place int")
    parts = rows.repartition(F.col("h1")).sortWithinPartitions("h1", "h2")
    return parts.mapInArrow(group, "row_key long, place int")


def remove_repeats(docs: DataFrame, width_bits: int = WIDTH_BITS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of each row: the words no repeated window covers, by one space."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, anchors_of, width_bits=width_bits))
    places = repeated_windows(keyed, shared).groupBy("row_key").agg(F.collect_list("place").alias("places"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            places = batch.column("places")
            for n, text in enumerate(text_bytes(batch.column("text"))):
                words = text.split()
                counts.append(len(words))
                gone = np.zeros(len(words) + 1, np.int32)
                if places[n].is_valid:
                    at = places[n].values.to_numpy(zero_copy_only=False)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + WINDOW, -1)
                covered = np.cumsum(gone[:-1]) > 0
                removed.append(int(covered.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~covered)] if removed[-1] else words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    rows = keyed.join(places, "row_key", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "places")
    return rows.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")
