"""Physical layout of pixel tables.

A *sheet* is the unit a detector looks at: a whole frame (``tile_id`` 0) or one tile with its halo.
Sheets are cut into fixed square *blocks*. All pixel-level shuffles are on (sheet, block), never on
the frame alone, so one giant frame is spread over the whole cluster instead of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["frame_id", "tile_id"]
BLOCK = 128
BLOCK_KEYS = [*KEYS, "blk_r", "blk_c"]

# Tile number of a whole-frame sheet: always 0, but not a literal. A literal would be folded into the
# shuffle expressions and keep the windows from recognising the block partitioning as their own.
WHOLE_FRAME = "CAST(frame_id % 1 AS INT)"


def int_div(value: Column, size: Column | int) -> Column:
    divisor = size if isinstance(size, Column) else F.lit(size)
    return F.floor(value / divisor).cast("int")


def frame_sheets(pixels: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Pixels as whole-frame sheets. Extents come with the pixels, else from ``frames``.

    The extent join is left to the optimizer: it broadcasts only when the frame table is measured
    small, otherwise it is a shuffle join whose skewed frames adaptive execution splits.
    """
    if "height" not in pixels.columns:
        if frames is None:
            raise ValueError("pixels without height/width need the frames table")
        pixels = pixels.join(frames.select("frame_id", "height", "width"), "frame_id")
    return pixels.select(
        F.col("frame_id"),
        F.expr(WHOLE_FRAME).alias("tile_id"),
        F.col("row_idx").cast("int").alias("row_idx"),
        F.col("col_idx").cast("int").alias("col_idx"),
        F.col("temp_c").cast("double").alias("temp_c"),
        F.col("height").cast("int").alias("height"),
        F.col("width").cast("int").alias("width"),
    )


def with_blocks(sheets: DataFrame, block: int = BLOCK) -> DataFrame:
    return sheets.withColumns(
        {"blk_r": int_div(F.col("row_idx"), block), "blk_c": int_div(F.col("col_idx"), block)}
    )


def over_blocks(per_sheet: DataFrame, block: int = BLOCK) -> DataFrame:
    """One copy of a per-sheet row for each block of the sheet.

    Joining pixels to these copies on (sheet, block) keeps the pixel side where it already is and
    gives every block its own key, so a frame holding a third of all rows is no hot key.
    """
    last = lambda n: int_div(F.col(n) - 1, block)
    return (
        per_sheet.withColumn("blk_r", F.explode(F.sequence(F.lit(0), last("height"))))
        .withColumn("blk_c", F.explode(F.sequence(F.lit(0), last("width"))))
    )


def box_blocks(
    boxes: DataFrame,
    left: Column,
    top: Column,
    right: Column,
    bottom: Column,
    block: int = BLOCK,
) -> DataFrame:
    """One row per block touched by an inclusive box; boxes that are empty disappear."""
    return (
        boxes.where((left <= right) & (top <= bottom))
        .withColumn("blk_r", F.explode(F.sequence(int_div(top, block), int_div(bottom, block))))
        .withColumn("blk_c", F.explode(F.sequence(int_div(left, block), int_div(right, block))))
    )
