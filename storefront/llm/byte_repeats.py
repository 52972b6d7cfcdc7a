"""Repeated byte strings, found by merged Burrows-Wheeler transforms, and removed.

A window is ``WINDOW`` bytes of one text. Its anchor is the least hash among its
``GRAM``-byte grams; equal windows have equal anchors. Windows whose anchor is alone
by a count-min sketch are alone. The others go, as the stretch of text that the
windows of one anchor place cover, to the task of their anchor. There

* equal stretches are one string with a count: over one, all its windows are
  repeated;
* the strings of anchors that have several are laid out in cells from the anchor
  on, dealt into shards, and the shards' transforms merged by refining their
  interleave. The common prefixes of neighbouring suffixes cut the suffixes into
  repeated intervals; a window that begins inside a cell looks at the cell before.

Anchors that the sketch calls frequent (so a group is bounded) do not gather in one
task: their windows are grouped by their own hashes, exactly, each settled first in
the task that reads it. What repeats inside a task is settled there in any case.

Defined cases: a null or empty text has no bytes; texts under ``WINDOW`` bytes keep
all; rows with equal ``doc_id`` and text are two places; removed runs may cut a
character, so what is kept is bytes; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.llm import bwt
from storefront.llm.bwt import CELL, Cells
from storefront.llm.common import chunks, text_bytes
from storefront.llm.count_min import WIDTH_BITS, sketch
from storefront.llm.hashing import mixed
from storefront.llm.window_groups import Groups, settle, settled_rows

WINDOW = 200
GRAM = 32
FREQUENT = 255
PLACE_BITS = 24  # of a place within what is read at once
PIECE = 1 << 22  # bytes of a text read at once
HELD = 1 << 25  # bytes that a task settles at once
BATCH = 1 << 21  # bytes of strings merged at once
SHARDS = 4
GOLD = np.uint64(0x9E3779B97F4A7C15)
STRETCH = -3  # in h2: the row is a stretch of text


def pieces_of(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Numbers of texts, offsets and bytes, about a MB at a time; long texts in pieces that overlap by a window less one."""
    for start, end in chunks(texts):
        numbers, offsets, parts = [], [], []
        for n in range(start, end):
            for at in range(0, max(1, len(texts[n]) - WINDOW + 1), PIECE):
                numbers.append(n)
                offsets.append(at)
                parts.append(texts[n][at : at + PIECE + WINDOW - 1])
                if len(parts[-1]) >= PIECE:
                    yield numbers, offsets, parts
                    numbers, offsets, parts = [], [], []
        if parts:
            yield numbers, offsets, parts


class ByteWindows:
    """The windows of some texts, in runs that share an anchor place."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"".join(texts)
        size = len(self.data)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lengths) - lengths
        counts = np.maximum(lengths - WINDOW + 1, 0)
        empty = np.zeros(0, np.int64)
        self.owner = self.begin = self.end = self.anchor = empty
        self.keys = np.zeros(0, np.uint64)
        if not counts.any():
            return
        codes = np.ndarray((size - 7,), "<u8", self.data, 0, (1,))
        grams = mixed(codes * GOLD)
        for step in (8, 16):
            grams = mixed(grams[:-step] * GOLD + grams[step:])
        # high bits of the hash, then the place: among equals the first is least
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width, have = WINDOW - GRAM + 1, 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        least = np.minimum(least[: size - WINDOW + 1], least[width - have :][: size - WINDOW + 1])
        at = (least & low).astype(np.int64)
        valid = np.zeros(size - WINDOW + 2, np.int8)
        some = counts > 0
        valid[first[some]] += 1
        valid[(first + counts)[some]] -= 1
        starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        at = at[starts]
        owner = np.searchsorted(first + lengths, starts, side="right")
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
        last = np.append(new[1:], len(starts)) - 1
        #: Of each run: its text, the bytes its windows cover, the place of its anchor; within ``data``.
        self.owner, self.begin, self.end, self.anchor = owner[new], starts[new], starts[last] + WINDOW, at[new]
        self.keys = grams[self.anchor]
        self.first = first

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the window at each place, the second never below 0."""
        codes = np.ndarray((len(self.data) - 7,), "<u8", self.data, 0, (1,))
        out = []
        for salt in (np.uint64(0), np.uint64(0xD6E8FEB86659FD93)):
            spans = mixed((codes ^ salt) * GOLD)
            tail, have = spans, 8
            while have < 128:
                spans = mixed(spans[:-have] * GOLD + spans[have:])
                have *= 2
                if have == 64:
                    tail = spans
            # 200 bytes are 128, and 64 from there on, and the last 8
            count = len(self.data) - WINDOW + 1
            eight = mixed((codes ^ salt) * GOLD)
            spans = mixed(spans[:count] * GOLD + tail[128 : 128 + count])
            out.append(mixed(spans * GOLD + eight[192 : 192 + count]))
        return out[0].view(np.int64), (out[1] >> np.uint64(33)).astype(np.int32)


def anchors_of(texts: list[bytes]) -> np.ndarray:
    found = [ByteWindows(parts).keys for _, _, parts in pieces_of(texts)]
    return np.concatenate([np.zeros(0, np.uint64), *found])


def repeated_starts(strings: list[bytes], lefts: list[int], shards: int = SHARDS) -> list[np.ndarray]:
    """For each string, whether the window from each of its places stands elsewhere in the strings.

    Equal windows must lie alike to the anchor, which is at ``lefts`` in each string.
    """
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    left = np.array(lefts, np.int64)
    pads = -left % CELL  # so that the anchor begins a cell
    sizes = -(-(pads + lengths) // CELL)
    whole = b"".join(bytes(int(p)) + s + bytes(int(n * CELL - p - len(s))) for s, p, n in zip(strings, pads, sizes))
    cells = Cells.of(np.frombuffer(whole, ">u8").astype(np.uint64), sizes)
    depth = WINDOW // CELL + 1
    cuts = np.unique(np.linspace(0, len(strings), min(shards, len(strings)) + 1).astype(int))
    parts = [bwt.build(cells, int(a), int(b), depth) for a, b in zip(cuts, cuts[1:])]
    suffixes, shared = bwt.merge(parts, depth)
    begins = cells.place * CELL - pads[cells.string]  # of each cell in its string; below 0 in the padding
    rest = lengths[cells.string] - np.maximum(begins, 0)
    common = bwt.common_bytes(cells, suffixes, shared, rest)
    before = np.where(cells.place > 0, np.concatenate([[np.uint64(0)], cells.codes[:-1]]), np.uint64(0))
    out = [np.zeros(max(0, n - WINDOW + 1), bool) for n in lengths.tolist()]
    offsets = np.cumsum([0, *map(len, out)])
    flags = np.zeros(offsets[-1], bool)
    for inside in range(CELL):
        # windows that begin ``inside`` bytes before a cell: that many bytes of the cell before, the rest from here on
        need = WINDOW - inside
        interval = np.cumsum(common < need)
        begin = begins[suffixes] - inside
        good = np.flatnonzero(
            (begins[suffixes] >= 0) & (begin >= 0) & (begin + WINDOW <= lengths[cells.string[suffixes]])
        )
        lead = before[suffixes[good]] & np.uint64((1 << (8 * inside)) - 1)
        order = np.lexsort((lead, interval[good]))
        good, lead = good[order], lead[order]
        same = (interval[good][1:] == interval[good][:-1]) & (lead[1:] == lead[:-1])
        twice = good[np.concatenate([[False], same])[: len(good)] | np.concatenate([same, [False]])[: len(good)]]
        flags[offsets[cells.string[suffixes[twice]]] + begin[twice]] = True
    return [flags[a:b] for a, b in zip(offsets, offsets[1:])]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """The bytes that flagged windows cover, as joined stretches."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    out: list[tuple[int, int]] = []
    for start, end in zip(edges[::2].tolist(), (edges[1::2] + WINDOW - 1).tolist()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


NAMES = ["h1", "h2", "row_key", "place", "lead", "stretch"]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
SCHEMA = "h1 long, h2 int, row_key long, place int, lead int, stretch binary"
#: ``place`` of stretches that were settled where they were read, and only tell that they exist.
TOLD = -1


class Reader:
    """Turns texts into rows: stretches by anchor, and windows of frequent anchors by their hashes."""

    def __init__(self, marks) -> None:
        self.marks = marks
        self.stretches: dict[tuple[int, bytes], list] = {}
        self.covered: list[tuple[int, int, int]] = []
        self.size = 0

    def read(self, texts: list[bytes], keys: np.ndarray) -> None:
        for numbers, offsets, parts in pieces_of(texts):
            found = ByteWindows(parts)
            if not len(found.keys):
                continue
            chosen = np.flatnonzero(self.marks.repeated(found.keys))
            frequent = self.marks.reaches(found.keys[chosen], self.marks.counts[-1])
            owners = keys[np.array(numbers)][found.owner[chosen]]
            shift = np.array(offsets)[found.owner[chosen]] - found.first[found.owner[chosen]]
            self._stretches(found, chosen, owners, shift, frequent)

    def _stretches(self, found, chosen, owners, shift, frequent) -> None:
        anchors = found.keys[chosen].view(np.int64).tolist()
        begins, ends, at = found.begin[chosen].tolist(), found.end[chosen].tolist(), found.anchor[chosen].tolist()
        hashes = found.hashes() if frequent.any() else None
        for n, (anchor, begin, end) in enumerate(zip(anchors, begins, ends)):
            stretch = found.data[begin:end]
            known = self.stretches.get((anchor, stretch))
            place = begin + int(shift[n])
            if known is None:
                windows = None
                if frequent[n]:
                    windows = tuple(h[begin : end - WINDOW + 1].copy() for h in hashes)
                self.stretches[(anchor, stretch)] = [at[n] - begin, int(owners[n]), place, False, windows]
                self.size += len(stretch) + (0 if windows is None else sum(w.nbytes for w in windows))
            else:
                if not known[3]:
                    self.covered.append((known[1], known[2], len(stretch)))
                    known[3] = True
                self.covered.append((int(owners[n]), place, len(stretch)))
                self.size += 16

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All rows so far; the reader is empty afterwards."""
        h1, keys, places, leads, stretches, windows = [], [], [], [], [], []
        for (anchor, stretch), (lead, key, place, settled, hashes) in self.stretches.items():
            if hashes is None:
                h1.append(anchor)
                keys.append(key)
                places.append(TOLD if settled else place)
                leads.append(lead)
                stretches.append(stretch)
            else:
                count = len(stretch) - WINDOW + 1
                own = np.full(count, TOLD, np.int32) if settled else np.arange(place, place + count, dtype=np.int32)
                windows.append((*hashes, np.full(count, key), own))
        columns = (h1, [STRETCH] * len(h1), keys, places, leads, stretches)
        if h1:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], NAMES)
        for start in range(0, len(windows), 4096):
            part = settle(*(np.concatenate(c) for c in zip(*windows[start : start + 4096])))
            yield self._plain(part, np.full(len(part[0]), WINDOW, np.int32))
        if self.covered:
            key, place, size = (np.array(c, np.int64) for c in zip(*self.covered))
            yield self._plain(settled_rows(key, place), size.astype(np.int32))
        self.stretches, self.covered, self.size = {}, [], 0

    @staticmethod
    def _plain(columns, lead: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(c, k) for c, k in zip((*columns, lead), KINDS)]
        return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(lead), pa.binary())], NAMES)


class Merger:
    """Finds the repeated bytes of stretches that come sorted by anchor."""

    def __init__(self) -> None:
        self.anchor: int | None = None
        self.group: dict[bytes, list] = {}
        self.batch: list[dict[bytes, list]] = []
        self.size = 0
        self.out: list[tuple[int, int, int]] = []

    def add(self, anchor: int, lead: int, key: int, place: int, stretch: bytes) -> None:
        if anchor != self.anchor:
            self.close()
            self.anchor = anchor
        known = self.group.setdefault(stretch, [lead, 0, []])
        known[1] += 1 if place >= 0 else 2  # a told one has been met twice
        if place >= 0:
            known[2].append((key, place))

    def close(self) -> None:
        """The group of an anchor is whole."""
        for stretch, (_, count, places) in self.group.items():
            if count > 1:
                self.out += [(key, place, place + len(stretch)) for key, place in places]
        if len(self.group) > 1 and any(count < 2 for _, count, _ in self.group.values()):
            self.batch.append(self.group)
            self.size += sum(map(len, self.group))
            if self.size > BATCH:
                self.flush()
        self.group = {}

    def flush(self) -> None:
        strings = [(s, known) for group in self.batch for s, known in group.items()]
        if strings:
            flags = repeated_starts([s for s, _ in strings], [known[0] for _, known in strings])
            for (_, (_, count, places)), own in zip(strings, flags):
                if count == 1 and own.any():
                    for start, end in runs_of(own):
                        self.out += [(key, place + start, place + end) for key, place in places]
        self.batch, self.size = [], 0


def repeated_bytes(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """``row_key, start, stop``: bytes that repeated windows cover; ``docs`` has row_key and text."""

    def take_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            for start, end in chunks(texts):
                reader.read(texts[start:end], keys[start:end])
                if reader.size > HELD:
                    yield from reader.rows()
        yield from reader.rows()

    def rows(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [(), (), ()]
        kinds = (pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["row_key", "start", "stop"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, merger = Groups(), Merger()
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES[:5]]
            h1, h2, keys, places, leads = columns
            stretches = batch.column("stretch")
            for n in np.flatnonzero(h2 == STRETCH).tolist():
                merger.add(int(h1[n]), int(leads[n]), int(keys[n]), int(places[n]), stretches[n].as_py())
            other = h2 != STRETCH
            done = h2[other] == -2
            settled = np.flatnonzero(other)[done]
            merger.out += zip(keys[settled].tolist(), places[settled].tolist(), (places + leads)[settled].tolist())
            key, place = groups.add(*(c[other][~done] for c in columns[:4]))
            merger.out += zip(key.tolist(), place.tolist(), (place + WINDOW).tolist())
            if len(merger.out) > 100_000:
                yield rows(merger.out)
                merger.out = []
        merger.close()
        merger.flush()
        yield rows(merger.out)

    parts = docs.select("row_key", "text").mapInArrow(take_up, SCHEMA).repartition(F.col("h1"))
    return parts.sortWithinPartitions("h1", "h2").mapInArrow(merge, "row_key long, start int, stop int")


def remove_repeated_bytes(docs: DataFrame, width_bits: int = WIDTH_BITS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: the bytes no repeated window covers."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, anchors_of, (2, FREQUENT), width_bits))
    covered = repeated_bytes(keyed, shared).groupBy("row_key").agg(F.collect_list(F.struct("start", "stop")).alias("covered"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, spans, kept = [], [], [], []
            covered = batch.column("covered")
            for n, text in enumerate(text_bytes(batch.column("text"))):
                pieces, at, runs = [], 0, 0
                if covered[n].is_valid:
                    start, stop = (f.to_numpy() for f in covered[n].values.flatten())
                    order = np.argsort(start, kind="stable")
                    last = -1
                    for a, b in zip(start[order].tolist(), stop[order].tolist()):
                        if a > last:
                            runs += 1
                            pieces.append(text[at:a])
                        last = max(last, b)
                        at = last
                pieces.append(text[at:])
                kept.append(b"".join(pieces))
                counts.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                spans.append(runs)
            numbers = [pa.array(c, pa.int64()) for c in (counts, removed, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *numbers, pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    rows = keyed.join(covered, "row_key", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "covered")
    return rows.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
