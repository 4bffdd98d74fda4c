import numpy as np
import pytest
from helpers import frame_table
from pyspark.sql import functions as F

from emberfield.operators import statistics, tiling
from emberfield.operators.sheets import frame_sheets


def test_summary_matches_numpy_on_both_routes(spark):
    rng = np.random.default_rng(1)
    arrays = {0: rng.normal(30, 8, (20, 20)), 1: np.full((9, 7), 3.0), 2: -rng.random((5, 5)) * 1e-6, 3: np.array([[5.0]])}
    arrays[0][2:4] = np.nan
    sheets = frame_sheets(frame_table(spark, arrays))
    for limit in (1, 10_000):
        got = {r.frame_id: r for r in statistics.frame_statistics(sheets, limit).collect()}
        for i, a in arrays.items():
            v = a[np.isfinite(a)]
            r = got[i]
            assert r.valid_pixels == v.size
            for name, want in {
                "minimum_c": v.min(), "maximum_c": v.max(), "mean_c": v.mean(), "median_c": np.median(v),
                "stddev_c": v.std(), "p95_c": np.percentile(v, 95),
            }.items():
                assert getattr(r, name) == pytest.approx(want, abs=1e-9), (limit, i, name)


def test_scene_statistics_routes_agree(spark):
    rng = np.random.default_rng(2)
    sheets = frame_sheets(frame_table(spark, {0: rng.normal(30, 8, (15, 15)), 1: np.round(rng.normal(20, 1, (12, 12)), 1)}))
    small = {r.frame_id: r.asDict() for r in statistics.scene_statistics(sheets).collect()}
    large = {r.frame_id: r.asDict() for r in statistics.scene_statistics(sheets, limit=10).collect()}
    for i in small:
        for k, v in small[i].items():
            assert large[i][k] == pytest.approx(v, abs=1e-9), k


def test_failed_frames(spark):
    sheets = frame_sheets(frame_table(spark, {0: np.full((2, 2), np.nan), 1: np.ones((2, 2))}))
    assert [r.frame_id for r in statistics.failed_frames(sheets).collect()] == [0]
    assert [r.frame_id for r in statistics.frame_statistics(sheets).collect()] == [1]


def test_tiles_own_every_pixel_once_and_find_the_maximum(spark):
    a = np.fromfunction(lambda r, c: r + c, (70, 90))
    pixels = frame_table(spark, {0: a})
    frames = spark.createDataFrame([(0, 70, 90)], "frame_id long, height int, width int")
    sheets, grid = tiling.tile_sheets(pixels, 32, 8), tiling.tile_grid(frames, 32, 8)
    assert grid.count() == 9
    owned = tiling.core_pixels(sheets, grid)
    assert owned.count() == 70 * 90 == owned.select("row_idx", "col_idx").distinct().count()
    assert owned.where(F.col("temp_c") != F.col("row_idx") + F.col("col_idx")).count() == 0


def test_tiled_detection_finds_a_block_on_a_tile_border(spark):
    a = np.full((96, 128), 25.0)
    a[40:60, 55:80] = 48.0
    pixels = frame_table(spark, {0: a})
    frames = spark.createDataFrame([(0, 96, 128)], "frame_id long, height int, width int")
    found, dropped, _ = tiling.detect_tiled(pixels, frames, size=64, overlap=40)
    rows = found.collect()
    assert len(rows) == 1
    assert (rows[0].bbox_left, rows[0].bbox_top, rows[0].bbox_right, rows[0].bbox_bottom) == (55, 40, 79, 59)
    assert rows[0].max_temperature_c == 48.0 and dropped.count() == 0
