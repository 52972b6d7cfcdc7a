"""Burrows-Wheeler transforms of string collections, merged by interleave refinement.

Strings are rows of 64-bit cells (eight bytes each, the first byte highest), so a
comparison of cells is one of bytes. The transform of a shard lists, for its
suffixes in order, the cell before each. Shards are merged without their texts:
an interleave says which shard the next suffix comes from; one round sorts it,
stably, by the cells before the suffixes, and so orders by one cell more. The round
in which two neighbours part is their common prefix. After ``depth`` rounds the
interleave is right for that many cells, and the common prefixes with it.

Common prefixes that end inside a cell are measured by its leading equal bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CELL = 8


@dataclass
class Cells:
    """Strings as cells: ``codes`` in order, and of each cell its string and its place there."""

    codes: np.ndarray
    string: np.ndarray
    place: np.ndarray
    first: np.ndarray  # of each string, the number of its first cell
    symbols: np.ndarray  # codes as ranks from 1; 0 is the end of a string

    @classmethod
    def of(cls, codes: np.ndarray, sizes: np.ndarray) -> Cells:
        first = np.cumsum(sizes) - sizes
        string = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(codes, kind="stable")
        ordered = codes[order]
        symbols = np.empty(len(codes), np.int64)
        symbols[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(codes)])
        return cls(codes, string, np.arange(len(codes)) - first[string], first, symbols)


@dataclass
class Shard:
    """The suffixes of a run of strings in order, and the symbol before each (0: none).

    The empty suffixes of the strings come first, as cell number -1.
    """

    suffixes: np.ndarray
    before: np.ndarray
    strings: int


def ordered_by(keys: np.ndarray) -> np.ndarray:
    """A stable order of small keys: key and position sorted as one number."""
    bits = int(len(keys)).bit_length()
    return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


def build(cells: Cells, begin: int, end: int, depth: int) -> Shard:
    """The transform of strings ``begin``..``end``; suffixes are ordered by ``depth`` cells at least."""
    low = int(cells.first[begin])
    high = int(cells.first[end]) if end < len(cells.first) else len(cells.codes)
    rank, string = cells.symbols[low:high], cells.string[low:high]
    count, size = high - low, 1
    order = ordered_by(rank)
    while size < depth:
        follows = np.zeros(count, np.int64)
        inside = np.flatnonzero(string[: count - size] == string[size:]) if size < count else np.zeros(0, np.int64)
        follows[inside] = rank[inside + size]
        # two ranks as one dense key
        key = rank * (int(rank.max(initial=0)) + 1) + follows
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(count, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])[:count])
        size *= 2
    strings = end - begin
    last = np.append(cells.first[begin + 1 : end], high) - 1  # last cell of each string
    before = np.zeros(count, np.int64)
    before[1:] = np.where(string[1:] == string[:-1], cells.symbols[low : high - 1], 0)
    return Shard(
        np.concatenate([np.full(strings, -1), order + low]),
        np.concatenate([cells.symbols[last], before[order]]),
        strings,
    )


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (without the empty ones) of all shards in order, and the cells each shares with the one before.

    Common prefixes of ``depth`` cells and more count as ``depth``.
    """
    sizes = np.array([len(s.suffixes) for s in shards])
    empties = np.repeat(np.arange(len(shards)), [s.strings for s in shards])
    before = np.concatenate([s.before for s in shards])
    starts = np.cumsum(sizes) - sizes
    # the interleave: empty suffixes first, the others as they stand
    weave = np.concatenate([empties, np.repeat(np.arange(len(shards)), sizes - [s.strings for s in shards])])
    fixed, total = len(empties), int(sizes.sum())
    # neighbours in one block are equal so far; each empty suffix is a block of its own
    block = np.concatenate([np.arange(fixed), np.full(total - fixed, fixed)])
    shared = np.full(total, depth)
    shared[: fixed + 1] = 0

    def rows_of(weave: np.ndarray) -> np.ndarray:
        """For each suffix of the interleave its number in the shards laid end to end."""
        order = ordered_by(weave)
        rows = np.empty(total, np.int64)
        rows[order] = np.arange(total)  # shards are contiguous, and each keeps its order
        return rows

    for done in range(depth):
        symbol = before[rows_of(weave)] if len(shards) > 1 else before
        moved = np.flatnonzero(symbol)
        moved = moved[ordered_by(symbol[moved])]
        next_weave = np.concatenate([empties, weave[moved]])
        new = np.empty(total, bool)
        new[: fixed + 1] = True
        tail_symbol, tail_block = symbol[moved], block[moved]
        new[fixed + 1 :] = (tail_symbol[1:] != tail_symbol[:-1]) | (tail_block[1:] != tail_block[:-1])
        # the round in which neighbours part tells what they share
        shared[new & (shared > done)] = done
        next_block = np.cumsum(new) - 1
        if done and np.array_equal(next_weave, weave) and np.array_equal(next_block, block):
            break
        weave, block = next_weave, next_block
    suffixes = np.concatenate([s.suffixes for s in shards])[rows_of(weave)]
    return suffixes[fixed:], shared[fixed:]


def common_bytes(cells: Cells, suffixes: np.ndarray, shared: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes each suffix shares with the one before; ``lengths`` are what is left of each string's bytes."""
    out = np.zeros(len(suffixes), np.int64)
    if len(suffixes) < 2:
        return out
    left, right, cells_shared = suffixes[:-1], suffixes[1:], shared[1:]
    total = len(cells.codes)
    ends = np.append(cells.first[1:], total)
    at_left, at_right = left + cells_shared, right + cells_shared
    inside = (at_left < ends[cells.string[left]]) & (at_right < ends[cells.string[right]])
    differ = cells.codes[np.minimum(at_left, total - 1)] ^ cells.codes[np.minimum(at_right, total - 1)]
    equal = np.zeros(len(left), np.int64)
    for byte in range(1, CELL + 1):
        equal += differ < (np.uint64(1) << np.uint64(64 - 8 * byte)) if byte < CELL else differ == 0
    out[1:] = cells_shared * CELL + np.where(inside, equal, 0)
    out[1:] = np.minimum(out[1:], np.minimum(lengths[left], lengths[right]))
    return out
