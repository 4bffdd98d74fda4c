"""Figures of the block sketch against NumPy, by the route of bounded arrays and by that of large sheets."""

import math
import random

import numpy as np
import pytest
from helpers import frame_table

from emberfield.operators import blocks as bl
from emberfield.operators.sheets import frame_sheets


def frames():
    rng = np.random.default_rng(8)
    a = np.round(rng.normal(30, 8, (23, 31)), 1)
    a[rng.random(a.shape) < 0.1] = math.nan
    b = np.full((9, 17), 21.5)
    c = np.full((5, 5), math.nan)
    d = np.round(rng.normal(200, 90, (16, 16)), 0)
    return {1: a, 2: b, 3: c, 4: d}


@pytest.mark.parametrize("limit", [65_536, 60])
def test_sketch_equals_numpy(spark, limit):
    data = frames()
    table = bl.block_table(frame_sheets(frame_table(spark, data)), 8).cache()
    assert bl.extents(table) == (31, 23 * 31)
    got = {r.frame_id: r for r in bl.sheet_sketch(table, limit).collect()}
    for k, a in data.items():
        v, r = np.sort(a[np.isfinite(a)]), got[k]
        assert r.n_cells == a.size and r.valid_pixels == len(v)
        if not len(v):
            assert r.minimum_c is None and r.median_c is None
            continue
        assert (r.minimum_c, r.maximum_c, r.at_min, r.at_max) == (v[0], v[-1], (v == v[0]).sum(), (v == v[-1]).sum())
        want = [v.mean(), v.std(), *np.quantile(v, [0.5, 0.9, 0.95]), np.median(np.abs(v - np.median(v)))]
        assert [r.mean_c, r.stddev_c, r.median_c, r.p90_c, r.p95_c, r.mad_c] == pytest.approx(want, abs=1e-9)


def test_pixels_come_back(spark):
    data = {1: frames()[1]}
    sheets = frame_sheets(frame_table(spark, data))
    back = bl.block_pixels(bl.block_table(sheets, 8), 8)
    assert back.exceptAll(sheets).count() == 0 and back.count() == data[1].size


@pytest.mark.parametrize("limit", [65_536, 10])
def test_rings_equal_numpy(spark, limit):
    rng = random.Random(1)
    a = frames()[1]
    table = bl.block_table(frame_sheets(frame_table(spark, {1: a})), 8).cache()
    boxes = []
    for label in range(12):
        top, left = rng.randrange(20), rng.randrange(28)
        boxes.append((1, 0, label, top, min(22, top + rng.randrange(12)), left, min(30, left + rng.randrange(12)), 23, 31))
    schema = "frame_id long, tile_id int, label long, bbox_top int, bbox_bottom int, bbox_left int, bbox_right int, height int, width int"
    got = {r.label: r for r in bl.ring_reference(spark.createDataFrame(boxes, schema), table, 3, 8, limit).collect()}
    for _, _, label, top, bottom, left, right, *_ in boxes:
        own = np.zeros_like(a, bool)
        own[max(0, top - 3) : bottom + 4, max(0, left - 3) : right + 4] = True
        own[top : bottom + 1, left : right + 1] = False
        v = a[own & np.isfinite(a)]
        assert got[label].ring_count == len(v) and got[label].ring_median == pytest.approx(np.median(v))
