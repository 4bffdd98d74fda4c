"""Small independent NumPy versions used as cross-checks."""

from __future__ import annotations

import math

import numpy as np


def frame_table(spark, arrays):
    """Pixel table of ``{frame_id: 2-D array}``; NaN becomes NULL."""
    rows = []
    for frame_id, a in arrays.items():
        h, w = a.shape
        rows += [
            (frame_id, r, c, None if math.isnan(a[r, c]) else float(a[r, c]), h, w) for r in range(h) for c in range(w)
        ]
    return spark.createDataFrame(rows, "frame_id long, row_idx int, col_idx int, temp_c double, height int, width int")


def box(values, radius):
    finite = np.isfinite(values)
    pad = lambda a: np.pad(a, radius, mode="reflect")
    v, n = pad(np.where(finite, values, 0.0)), pad(finite.astype(float))
    h, w = values.shape
    size = 2 * radius + 1
    total = lambda a: np.array([[a[r : r + size, c : c + size].sum() for c in range(w)] for r in range(h)])
    return total(v), total(n)


def flood(mask, eight=True):
    """Labels by repeated neighbour minimum, independent of the run method."""
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    steps = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr or dc) and (eight or not (dr and dc))]
    while True:
        best = label.copy()
        for dr, dc in steps:
            moved = np.full_like(label, h * w)
            moved[max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)] = label[
                max(0, -dr) : h + min(0, -dr), max(0, -dc) : w + min(0, -dc)
            ]
            best = np.minimum(best, moved)
        best = np.where(mask, best, h * w)
        if (best == label).all():
            return label
        label = best


def metres(a, b):
    (la, lo), (lb, lp) = a, b
    la, lo, lb, lp = map(math.radians, (la, lo, lb, lp))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(math.sqrt(h))
