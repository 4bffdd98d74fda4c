"""Tasks of the window passes follow the rows that they sort, not the size of the shuffle files."""

import numpy as np
from helpers import frame_table

from emberfield.operators import stencil
from emberfield.operators.sheets import frame_sheets


def test_tasks_grow_with_the_rows_and_results_stay(spark, monkeypatch):
    frames = {i: np.random.default_rng(i).normal(30, 1, (20, 25)) for i in range(12)}
    sheets = frame_sheets(frame_table(spark, frames))
    plain = stencil.box_sums(sheets, [1, 7]).orderBy("frame_id", "row_idx", "col_idx").toPandas()
    # (20 + 14) x (25 + 14) rows a frame
    monkeypatch.setattr(stencil, "HALO_ROWS", 34 * 39)
    assert stencil.halo_tasks(sheets, 7) == 12
    assert stencil.halo_tasks(sheets.limit(0), 7) == 2
    many = stencil.box_sums(sheets, [1, 7])
    assert many.rdd.getNumPartitions() == 12
    assert np.allclose(many.orderBy("frame_id", "row_idx", "col_idx").toPandas().astype(float), plain.astype(float), rtol=0, atol=1e-9)


def test_halo_of_small_blocks_is_counted(spark):
    sheets = frame_sheets(frame_table(spark, {0: np.full((20, 25), 30.0)}))
    rows = stencil.with_halo(sheets, 7, 16).count()
    each = (20 + 2 * 2 * 7) * (25 + 2 * 2 * 7)
    assert rows <= each and stencil.HALO_ROWS > each
