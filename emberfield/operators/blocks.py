"""One row per (sheet, block): its cells and a sketch of their values, from which everything but the stencils is derived.

The table is written once. Quality metrics, frame statistics and scene statistics come from the sketch columns (counts, extremes
and how often they occur, mean and squared deviations, the sorted values), ring references from the cells of the blocks a
ring touches, and the stencils unfold the cells to pixels again. A block has at most ``block``² cells, so no row grows with a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.operators.sheets import BLOCK, BLOCK_KEYS, KEYS, box_blocks, with_blocks
from emberfield.operators.statistics import GIANT_GROUP, _scene_columns, binned_quantiles, is_giant
from emberfield.session import cut_lineage


def block_table(sheets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pixels of sheets to blocks. ``cells`` hold the place inside the block and the value; ``valid`` is sorted and without NULLs."""
    low, high = fv.PLAUSIBLE_RANGE_C
    t = F.col("temp_c")
    at = (F.col("row_idx") % block * block + F.col("col_idx") % block).cast("int")
    made = with_blocks(sheets, block).groupBy(*BLOCK_KEYS).agg(
        F.max("height").alias("height"),
        F.max("width").alias("width"),
        F.count(F.lit(1)).alias("n_cells"),
        F.count(t).alias("n_valid"),
        F.min(t).alias("low"),
        F.max(t).alias("high"),
        F.avg(t).alias("mean"),
        F.coalesce(F.var_pop(t) * F.count(t), F.lit(0.0)).alias("m2"),
        F.count_if((t < low) | (t > high)).alias("implausible"),
        F.sort_array(F.collect_list(t)).alias("valid"),
        F.collect_list(F.struct(at.alias("at"), t.alias("t"))).alias("cells"),
    )
    ties = lambda end: F.size(F.filter("valid", lambda x: x == F.col(end)))
    return made.withColumns({"at_low": ties("low"), "at_high": ties("high")})


def block_pixels(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pixels again, as sheets."""
    unfolded = blocks.select(*BLOCK_KEYS, "height", "width", F.explode("cells").alias("cell"))
    place = lambda n, inside: (F.col(n) * block + inside).cast("int")
    at = F.col("cell.at")
    return unfolded.select(
        *KEYS,
        place("blk_r", F.floor(at / block)).alias("row_idx"),
        place("blk_c", at % block).alias("col_idx"),
        F.col("cell.t").alias("temp_c"),
        "height",
        "width",
    )


def extents(blocks: DataFrame) -> tuple[int, int]:
    """Longest edge and most pixels of any sheet: two numbers that decide the routes, read from the sketch columns."""
    area = F.col("height").cast("long") * F.col("width")
    row = blocks.agg(F.max(F.greatest("height", "width")).alias("edge"), F.max(area).alias("area")).first()
    return row["edge"] or 0, row["area"] or 0


def _quantile(values: Column, p: float) -> Column:
    position = (F.size(values) - 1) * F.lit(p)
    low = F.floor(position).cast("int")
    a, b = F.get(values, low), F.get(values, F.ceil(position).cast("int"))
    return a + (b - a) * (position - low)


def _merged(part: str) -> list[Column]:
    """Figures of a sheet that add up over its blocks."""
    return [
        F.max("height").alias("height"),
        F.max("width").alias("width"),
        F.sum("n_cells").alias("n_cells"),
        F.sum("n_valid").alias("valid_pixels"),
        F.min("low").alias("minimum_c"),
        F.max("high").alias("maximum_c"),
        F.sum("implausible").alias("implausible"),
        (F.sum(F.col("mean") * F.col("n_valid")) / F.nullif(F.sum("n_valid"), F.lit(0))).alias(part),
    ]


SKETCH = [
    *KEYS, "height", "width", "n_cells", "valid_pixels", "minimum_c", "maximum_c", "at_min", "at_max", "implausible",
    "mean_c", "stddev_c", "median_c", "p90_c", "p95_c", "mad_c",
]


def sheet_sketch(blocks: DataFrame, limit: int = GIANT_GROUP, most_pixels: int | None = None) -> DataFrame:
    """One row per sheet with the figures of A1, A3 and A4.

    Sheets of up to ``limit`` pixels gather their blocks' sorted values in one bounded array. Larger ones add up their blocks' figures, meet their
    extremes once more block by block, and find their quantiles by binned counts; there is one row a block to join, not one a pixel.
    """
    most_pixels = extents(blocks)[1] if most_pixels is None else most_pixels
    some = most_pixels > limit
    small = blocks.where(~is_giant(limit)) if some else blocks
    part = F.struct("n_valid", "mean", "m2", "low", "high", "at_low", "at_high")
    one = small.groupBy(*KEYS).agg(
        *_merged("mean_c"),
        F.sort_array(F.flatten(F.collect_list("valid"))).alias("sorted"),
        F.collect_list(part).alias("parts"),
    )
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + F.coalesce(f(p), F.lit(0.0)))
    squares = total(lambda p: p["m2"] + p["n_valid"] * (p["mean"] - F.col("mean_c")) * (p["mean"] - F.col("mean_c")))
    one = one.withColumns(
        {
            "at_min": total(lambda p: F.when(p["low"] == F.col("minimum_c"), p["at_low"].cast("double"))).cast("long"),
            "at_max": total(lambda p: F.when(p["high"] == F.col("maximum_c"), p["at_high"].cast("double"))).cast("long"),
            "stddev_c": F.sqrt(squares / F.nullif(F.col("valid_pixels"), F.lit(0))),
            "median_c": _quantile(F.col("sorted"), 0.5),
            "p90_c": _quantile(F.col("sorted"), 0.9),
            "p95_c": _quantile(F.col("sorted"), 0.95),
        }
    )
    away = F.sort_array(F.transform("sorted", lambda x: F.abs(x - F.col("median_c"))))
    one = one.withColumn("away", away).withColumn("mad_c", _quantile(F.col("away"), 0.5)).select(*SKETCH)
    if not some:
        return one
    large = blocks.where(is_giant(limit))
    bounds = large.groupBy(*KEYS).agg(*_merged("mean_c"))
    again = (
        large.select(*KEYS, "n_valid", "mean", "m2", "low", "high", "at_low", "at_high")
        .join(bounds.select(*KEYS, "minimum_c", "maximum_c", "mean_c"), KEYS)
        .groupBy(*KEYS)
        .agg(
            F.coalesce(F.sum(F.when(F.col("low") == F.col("minimum_c"), F.col("at_low"))), F.lit(0)).alias("at_min"),
            F.coalesce(F.sum(F.when(F.col("high") == F.col("maximum_c"), F.col("at_high"))), F.lit(0)).alias("at_max"),
            F.sum(F.col("m2") + F.col("n_valid") * F.pow(F.col("mean") - F.col("mean_c"), 2)).alias("squares"),
        )
    )
    values = large.select(*KEYS, F.explode("valid").alias("temp_c"))
    middle = cut_lineage(binned_quantiles(values, KEYS, "temp_c", [0.5, 0.9, 0.95]))
    away_from = values.join(middle, KEYS).withColumn("d", F.abs(F.col("temp_c") - F.col("q")[0]))
    mad = binned_quantiles(away_from, KEYS, "d", [0.5]).withColumnRenamed("q", "m")
    wide = bounds.join(again, KEYS).join(middle, KEYS, "left").join(mad, KEYS, "left").withColumns(
        {
            "stddev_c": F.sqrt(F.col("squares") / F.nullif(F.col("valid_pixels"), F.lit(0))),
            "median_c": F.col("q")[0],
            "p90_c": F.col("q")[1],
            "p95_c": F.col("q")[2],
            "mad_c": F.col("m")[0],
        }
    )
    return one.unionByName(wide.select(*SKETCH))


def scene_of(sketch: DataFrame) -> DataFrame:
    """A3 in the columns of ``scene_statistics``."""
    figures = _scene_columns(F.col("median_c"), F.col("mad_c"), F.col("stddev_c"), F.col("p90_c"))
    return sketch.select(*KEYS, "height", "width", "valid_pixels", *(c.alias(n) for n, c in figures.items()))


def statistics_of(sketch: DataFrame) -> DataFrame:
    """A1 in the columns of ``frame_statistics``; sheets without a finite value are absent."""
    names = ["minimum_c", "maximum_c", "mean_c", "median_c", "stddev_c", "p95_c", "valid_pixels"]
    return sketch.where("valid_pixels > 0").select(*KEYS, *names)


def metrics_of(sketch: DataFrame) -> DataFrame:
    """What the quality gate (A4) looks at. A gap in a mosaic is a missing row, so the extent counts, not only the cells."""
    valid = F.col("valid_pixels")
    total = F.greatest("n_cells", F.col("height").cast("long") * F.col("width"))
    return sketch.select(
        "frame_id",
        total.alias("total_pixels"),
        "valid_pixels",
        "minimum_c",
        "maximum_c",
        "implausible",
        "height",
        "width",
        "at_min",
        "at_max",
        (valid / total).alias("valid_fraction"),
        (F.col("maximum_c") - F.col("minimum_c")).alias("dynamic_range_c"),
        F.when(valid > 0, F.greatest("at_min", "at_max") / valid).otherwise(0.0).alias("extreme_fraction"),
    )


def ring_values(components: DataFrame, blocks: DataFrame, margin: int, block: int) -> DataFrame:
    """``(sheet, label, ring_px, values)``: finite values around each bounding box, one row per block that the ring touches.

    Blocks lying wholly inside a box are skipped, so the work follows the ring, not the region; of the rest one row each meets
    the box, and its cells are picked by place.
    """
    c = components.select(*KEYS, "label", "bbox_top", "bbox_bottom", "bbox_left", "bbox_right", "height", "width")
    c = c.withColumns(
        {
            "out_top": F.greatest(F.lit(0), F.col("bbox_top") - margin),
            "out_left": F.greatest(F.lit(0), F.col("bbox_left") - margin),
            "out_bottom": F.least(F.col("height") - 1, F.col("bbox_bottom") + margin),
            "out_right": F.least(F.col("width") - 1, F.col("bbox_right") + margin),
        }
    ).drop("height", "width")
    edge = lambda a, b: (F.col(b) - F.col(a) + 1).cast("long")
    around = edge("out_top", "out_bottom") * edge("out_left", "out_right")
    c = c.withColumn("ring_px", around - edge("bbox_top", "bbox_bottom") * edge("bbox_left", "bbox_right"))
    c = box_blocks(c, F.col("out_left"), F.col("out_top"), F.col("out_right"), F.col("out_bottom"), block)
    row0, col0 = F.col("blk_r") * block, F.col("blk_c") * block
    swallowed = (
        (row0 >= F.col("bbox_top"))
        & (row0 + block - 1 <= F.col("bbox_bottom"))
        & (col0 >= F.col("bbox_left"))
        & (col0 + block - 1 <= F.col("bbox_right"))
    )
    # The boxes in the block's own rows and columns, so that a cell is tested by its place alone.
    own = {f"{p}_{s}": F.col(f"{p}_{s}") - (row0 if s in ("top", "bottom") else col0) for p in ("out", "bbox") for s in ("top", "bottom", "left", "right")}
    c = c.where(~swallowed).withColumns(own)

    def around_box(cell: Column) -> Column:
        row, col = F.floor(cell["at"] / block), cell["at"] % block
        within = lambda p: row.between(F.col(f"{p}_top"), F.col(f"{p}_bottom")) & col.between(F.col(f"{p}_left"), F.col(f"{p}_right"))
        return cell["t"].isNotNull() & within("out") & ~within("bbox")

    picked = F.transform(F.filter("cells", around_box), lambda cell: cell["t"])
    return c.join(blocks.select(*BLOCK_KEYS, "cells"), BLOCK_KEYS).select(*KEYS, "label", "ring_px", picked.alias("values"))


def ring_reference(components: DataFrame, blocks: DataFrame, margin: int, block: int, limit: int = GIANT_GROUP) -> DataFrame:
    """Median and count of the finite pixels around each bounding box.

    Rings of up to ``limit`` pixels gather their blocks' values in one bounded array; for longer ones the values are counted in
    bins with map-side combine, so that no ring is one task's buffer.
    """
    keys = [*KEYS, "label"]
    rings = ring_values(components, blocks, margin, block)
    tall, wide = (F.col(f"bbox_{b}") - F.col(f"bbox_{a}") + 1 for a, b in (("top", "bottom"), ("left", "right")))
    # The ring lies inside the frame of ``margin`` around the box, so this bound is never below its size.
    longest = components.agg(F.max((tall.cast("long") + wide + 2 * margin) * 2 * margin)).first()[0] or 0
    some = longest > limit
    short = rings.where(F.col("ring_px") <= limit) if some else rings
    sorted_values = F.sort_array(F.flatten(F.collect_list("values")))
    out = short.groupBy(*keys).agg(sorted_values.alias("v")).where(F.size("v") > 0).select(
        *keys, _quantile(F.col("v"), 0.5).alias("ring_median"), F.size("v").cast("long").alias("ring_count")
    )
    if not some:
        return out
    values = cut_lineage(rings.where(F.col("ring_px") > limit).select(*keys, F.explode("values").alias("temp_c")))
    found = binned_quantiles(values, keys, "temp_c", [0.5]).join(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("ring_count")), keys)
    return out.unionByName(found.select(*keys, F.col("q")[0].alias("ring_median"), "ring_count"))
