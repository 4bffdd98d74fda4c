"""Sparse matrices by rows, built by hand: row starts, column numbers, values; row products by Gustavson's scheme.

A row of a product is the sum of the rows of the right matrix that the entries of the left row name. Here whole panels of
rows are expanded at once and equal places added up, so that memory is bounded by the panel and not by the product's work.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Entries that a panel expands to; one row alone may be longer.
PANEL = 1 << 19


class Csr(NamedTuple):
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(self.height), np.diff(self.starts))


def from_entries(rows: np.ndarray, columns: np.ndarray, height: int, width: int, values: np.ndarray | None = None) -> Csr:
    """Entries in any order; equal places are added up."""
    if values is None:
        values = np.ones(len(rows), np.int64)
    key = rows.astype(np.int64) * width + columns
    order = np.argsort(key, kind="stable")
    key, values = key[order], values[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    row, column = np.divmod(key[at], max(width, 1))
    sums = np.add.reduceat(values, at) if len(at) else values[:0]
    return Csr(np.searchsorted(row, np.arange(height + 1)), column, sums, width)


def one_per_row(columns: np.ndarray, width: int) -> Csr:
    return Csr(np.arange(len(columns) + 1), columns, np.ones(len(columns), np.int64), width)


def spans(lengths: np.ndarray) -> Csr:
    """Row i holds the columns of the i-th of spans that follow each other."""
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    total = int(starts[-1])
    return Csr(starts, np.arange(total), np.ones(total, np.int64), total)


def transpose(m: Csr) -> Csr:
    order = np.argsort(m.columns, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width), dtype=np.int64)])
    return Csr(starts, m.rows()[order], m.values[order], m.height)


def work(a: Csr, b: Csr) -> np.ndarray:
    """Entries that every row of the product a·b expands to, before equal places are added up."""
    each = np.concatenate([[0], np.cumsum(np.diff(b.starts)[a.columns], dtype=np.int64)])
    return np.diff(each[a.starts])


def product(a: Csr, b: Csr, panel: int = PANEL) -> Csr:
    """a·b, panel of rows by panel of rows."""
    ends = np.cumsum(work(a, b))
    parts: list[Csr] = []
    first = 0
    while first < a.height:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + panel, "right")))
        parts.append(_panel(a, b, first, last))
        first = last
    if not parts:
        return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), b.width)
    steps = np.concatenate([np.diff(p.starts) for p in parts])
    return Csr(
        np.concatenate([[0], np.cumsum(steps)]),
        np.concatenate([p.columns for p in parts]),
        np.concatenate([p.values for p in parts]),
        b.width,
    )


def _panel(a: Csr, b: Csr, first: int, last: int) -> Csr:
    own = slice(a.starts[first], a.starts[last])
    rows = np.repeat(np.arange(last - first), np.diff(a.starts[first : last + 1]))
    named, factors = a.columns[own], a.values[own]
    count = np.diff(b.starts)[named]
    ends = np.cumsum(count)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(b.starts[named] - (ends - count), count)
    return from_entries(
        np.repeat(rows, count), b.columns[at], last - first, b.width, np.repeat(factors, count) * b.values[at]
    )
