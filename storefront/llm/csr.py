"""Sparse matrices of whole numbers by compressed rows, and their products row by row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Entries of a product that are laid out before they are added up.
SLICE = 1 << 20


@dataclass(frozen=True)
class Csr:
    """Row r has the columns ``idx[ptr[r]:ptr[r + 1]]`` with the values ``val`` there (ones if None)."""

    ptr: np.ndarray
    idx: np.ndarray
    width: int
    val: np.ndarray | None = None

    @property
    def height(self) -> int:
        return len(self.ptr) - 1


def starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of a row of neighbours begins, and the end of the last."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def runs(sizes: np.ndarray) -> Csr:
    """Row r covers the next ``sizes[r]`` columns: tokens over the bytes of a text."""
    ptr = starts(sizes)
    return Csr(ptr, np.arange(ptr[-1]), int(ptr[-1]))


def labels(column: np.ndarray, width: int) -> Csr:
    """Row r has the one column ``column[r]``: tokens and the group they are in."""
    return Csr(np.arange(len(column) + 1), column, width)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.idx, kind="stable")
    rows = np.repeat(np.arange(m.height), np.diff(m.ptr))[order]
    ptr = starts(np.bincount(m.idx, minlength=m.width))
    return Csr(ptr, rows, m.height, None if m.val is None else m.val[order])


def spread(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of ``rows``, one after the other, and how many each has."""
    sizes = ptr[rows + 1] - ptr[rows]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(ptr[rows] - (ends - sizes), sizes), sizes


def products(left: Csr, right: Csr, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``left`` x ``right`` by Gustavson: row r adds up the rows of ``right`` that its entries name.

    Rows come in order, as many at a time as lay out ``most`` entries (one row at
    least): ``(rows, columns, values)`` sorted by row and column.
    """
    work = starts((right.ptr[1:] - right.ptr[:-1])[left.idx])[left.ptr]  # entries laid out before each row
    first = 0
    while first < left.height:
        last = max(first + 1, int(np.searchsorted(work, work[first] + most, "right")) - 1)
        own = slice(int(left.ptr[first]), int(left.ptr[last]))
        places, sizes = spread(right.ptr, left.idx[own])
        rows = np.repeat(np.repeat(np.arange(first, last), np.diff(left.ptr[first : last + 1])), sizes)
        keys = rows * right.width + right.idx[places]
        values = np.ones(len(keys), np.int64) if right.val is None else right.val[places]
        if left.val is not None:
            values = values * np.repeat(left.val[own], sizes)
        if len(keys) and (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        if len(keys):
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            yield keys[new] // right.width, keys[new] % right.width, np.add.reduceat(values, new)
        first = last


def product(left: Csr, right: Csr) -> Csr:
    """``left`` x ``right`` as a whole."""
    parts = list(products(left, right))
    rows, columns, values = (np.concatenate(p) if parts else np.zeros(0, np.int64) for p in (list(zip(*parts)) or [[]] * 3))
    return Csr(starts(np.bincount(rows, minlength=left.height)), columns, right.width, values)
