"""Exact grouping of hashed windows, with nothing hot: what repeats within a task is settled there.

Rows are ``h1, h2`` (96 bits of a window's hash), ``row_key`` and ``place``. A window
that a task meets twice or more is settled: its places travel as done, and one row
without a place tells the other tasks. So a window that stands in every document
costs one row per task.
"""

from __future__ import annotations

import numpy as np

from storefront.llm.hashing import mixed

#: In ``h2``: the places of this row are known to be repeated. In ``place``: the window is elsewhere too.
SETTLED = -2
ELSEWHERE = -1

Columns = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def settled_rows(row_key: np.ndarray, place: np.ndarray) -> Columns:
    """Rows of places known to be repeated; they travel under a hash of their own document."""
    h1 = mixed(row_key.view(np.uint64)).view(np.int64)
    return h1, np.full(len(h1), SETTLED, np.int32), row_key, place.astype(np.int32)


def settle(h1: np.ndarray, h2: np.ndarray, row_key: np.ndarray, place: np.ndarray) -> Columns:
    """The rows of one task: windows met once as they are, others settled."""
    order = np.lexsort((h2, h1))
    h1, h2, row_key, place = h1[order], h2[order], row_key[order], place[order]
    same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    follows = np.concatenate([[False], same])[: len(h1)]
    again = follows | np.concatenate([same, [False]])[: len(h1)]
    once, heads = ~again, again & ~follows
    placed = again & (place >= 0)
    done = settled_rows(row_key[placed], place[placed])
    told = h1[heads], h2[heads], np.zeros(heads.sum(), np.int64), np.full(heads.sum(), ELSEWHERE, np.int32)
    alone = h1[once], h2[once], row_key[once], place[once]
    return tuple(np.concatenate(c) for c in zip(alone, told, done))


class Groups:
    """Finds the repeated places in rows that come sorted by ``h1, h2``, batch after batch."""

    def __init__(self) -> None:
        self.last: tuple[int, int] | None = None
        self.waiting: tuple[int, int] | None = None  # a place at the end of a batch, alone so far

    def add(self, h1: np.ndarray, h2: np.ndarray, row_key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``row_key, place`` of rows now known to be repeated."""
        if not len(h1):
            return row_key, place
        settled = h2 == SETTLED
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        follows = np.concatenate([[self.last == (h1[0], h2[0])], same])
        good = (follows | np.concatenate([same, [False]]) | settled) & (place >= 0)
        out_key, out_place = row_key[good], place[good]
        if self.waiting is not None and follows[0]:
            out_key, out_place = np.append(out_key, self.waiting[0]), np.append(out_place, self.waiting[1])
        self.last = (h1[-1], h2[-1])
        alone = not follows[-1] and not settled[-1] and place[-1] >= 0
        self.waiting = (row_key[-1], place[-1]) if alone else None
        return out_key, out_place
