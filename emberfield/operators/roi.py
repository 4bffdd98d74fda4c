"""Region-of-interest measurements.

``rois``: ``(roi_id, frame_id, kind, x0, y0, x1, y1, cx, cy, rx, ry, width_px, kernel, points)`` with
frame extents ``height, width``. Shapes are located through the blocks their box touches, so many ROIs
on one large frame never meet all of its pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.operators.sheets import BLOCK, BLOCK_KEYS, KEYS, WHOLE_FRAME, box_blocks, with_blocks
from emberfield.operators.statistics import GIANT_GROUP, summarize


def _kind(*names: str) -> Column:
    return F.col("kind").isin(*names)


def prepare_rois(rois: DataFrame) -> DataFrame:
    """Checked ROIs with an inclusive candidate box clamped to the frame and an ``error`` text."""
    flat_line = _kind("line") & (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    r = rois.withColumn("is_spot", _kind("spot") | flat_line)
    r = r.withColumns(
        {
            "sx": F.rint("x0").cast("int"),
            "sy": F.rint("y0").cast("int"),
            "size": F.when(flat_line, 1).otherwise(F.coalesce("kernel", F.lit(4))),
            "stroke": F.coalesce("width_px", F.lit(1.5)),
            "outer_x": F.when(_kind("circle"), F.col("rx")).otherwise(F.col("rx")),
            "outer_y": F.when(_kind("circle"), F.col("rx")).otherwise(F.col("ry")),
        }
    )
    half = F.col("stroke") / 2.0
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])

    def box(low_spot, high_spot, a, b, centre, radius, points, limit):
        low = (
            F.when(F.col("is_spot"), low_spot)
            .when(_kind("rectangle"), F.least(a, b))
            .when(_kind("circle", "ellipse"), centre - radius)
            .when(_kind("line"), F.least(a, b) - half)
            .otherwise(F.array_min(points) - 1)
        )
        high = (
            F.when(F.col("is_spot"), high_spot)
            .when(_kind("rectangle"), F.greatest(a, b))
            .when(_kind("circle", "ellipse"), centre + radius)
            .when(_kind("line"), F.greatest(a, b) + half)
            .otherwise(F.array_max(points) + 1)
        )
        # a rectangle outside the frame clamps onto its border; other shapes simply miss it
        clamp = lambda v: F.greatest(F.lit(0), F.least(limit - 1, v))
        low_i, high_i = F.floor(low).cast("int"), F.ceil(high).cast("int")
        return (
            F.when(_kind("rectangle"), clamp(low_i)).otherwise(F.greatest(F.lit(0), low_i)),
            F.when(_kind("rectangle"), clamp(high_i)).otherwise(F.least(limit - 1, high_i)),
        )

    below, above = F.floor((F.col("size") - 1) / 2).cast("int"), F.floor(F.col("size") / 2).cast("int")
    left, right = box(
        F.col("sx") - below, F.col("sx") + above, F.col("x0"), F.col("x1"), F.col("cx"), F.col("outer_x"), xs, F.col("width")
    )
    top, bottom = box(
        F.col("sy") - below, F.col("sy") + above, F.col("y0"), F.col("y1"), F.col("cy"), F.col("outer_y"), ys, F.col("height")
    )
    error = (
        F.when(F.col("is_spot") & (F.col("size") <= 0), "kernel_size must be positive")
        .when(
            F.col("is_spot")
            & ((F.col("sx") < 0) | (F.col("sy") < 0) | (F.col("sx") >= F.col("width")) | (F.col("sy") >= F.col("height"))),
            "spot is outside the temperature matrix",
        )
        .when(_kind("circle") & (F.col("rx") <= 0), "radius must be positive")
        .when(_kind("ellipse") & ((F.col("rx") <= 0) | (F.col("ry") <= 0)), "ellipse radii must be positive")
        .when(_kind("line") & (F.col("stroke") <= 0), "width_px must be positive")
        .when(_kind("polygon") & (F.coalesce(F.size("points"), F.lit(0)) < 3), "polygon requires at least three points")
    )
    return r.withColumns(
        {"box_left": left, "box_right": right, "box_top": top, "box_bottom": bottom, "error": error}
    )


def _inside() -> Column:
    x, y = F.col("col_idx"), F.col("row_idx")
    ellipse = F.pow((x - F.col("cx")) / F.col("outer_x"), F.lit(2)) + F.pow((y - F.col("cy")) / F.col("outer_y"), F.lit(2)) <= 1.0
    circle = (x - F.col("cx")) * (x - F.col("cx")) + (y - F.col("cy")) * (y - F.col("cy")) <= F.col("rx") * F.col("rx")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    along = ((x - F.col("x0")) * dx + (y - F.col("y0")) * dy) / (dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    off = F.hypot(x - (F.col("x0") + t * dx), y - (F.col("y0") + t * dy))
    line = off <= F.col("stroke") / 2.0
    return (
        F.when(F.col("is_spot") | _kind("rectangle"), F.lit(True))
        .when(_kind("circle"), circle)
        .when(_kind("ellipse"), ellipse)
        .when(_kind("line"), line)
        .otherwise(_even_odd(x + 0.5, y + 0.5))
    )


def _even_odd(px: Column, py: Column) -> Column:
    """Parity of edge crossings at the pixel centre."""
    n = F.size("points")

    def crossing(i: Column) -> Column:
        cur, prev = F.get("points", i), F.get("points", F.pmod(i + n - 1, n))
        crosses = (cur["y"] > py) != (prev["y"] > py)
        rise = prev["y"] - cur["y"]
        at = F.when(F.abs(rise) < 1e-12, cur["x"]).otherwise((prev["x"] - cur["x"]) * (py - cur["y"]) / rise + cur["x"])
        return (crosses & (px < at)).cast("int")

    parity = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crossing), F.lit(0), lambda acc, c: acc + c)
    return parity % 2 == 1


def roi_pixels(pixels: DataFrame, prepared: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pixels inside each valid ROI."""
    shapes = prepared.where("error IS NULL").withColumn("tile_id", F.expr(WHOLE_FRAME)).drop("height", "width")
    shapes = box_blocks(shapes, F.col("box_left"), F.col("box_top"), F.col("box_right"), F.col("box_bottom"), block)
    located = with_blocks(
        pixels.select("frame_id", F.expr(WHOLE_FRAME).alias("tile_id"), "row_idx", "col_idx", "temp_c"), block
    )
    hit = (
        F.col("row_idx").between(F.col("box_top"), F.col("box_bottom"))
        & F.col("col_idx").between(F.col("box_left"), F.col("box_right"))
        & _inside()
    )
    return located.join(shapes, BLOCK_KEYS).where(hit).select(
        "frame_id", "roi_id", "row_idx", "col_idx", "temp_c", "box_left", "box_top", "box_right", "box_bottom"
    )


def roi_statistics(pixels: DataFrame, rois: DataFrame, block: int = BLOCK, limit: int = GIANT_GROUP) -> DataFrame:
    """A10: seven statistics per ROI. ROIs whose box exceeds ``limit`` pixels take the binned percentiles."""
    prepared = prepare_rois(rois)
    area = (F.col("box_right") - F.col("box_left") + 1).cast("long") * (F.col("box_bottom") - F.col("box_top") + 1)
    mixed = prepared.where(area > limit).limit(1).count() > 0
    return summarize(roi_pixels(pixels, prepared, block), ["frame_id", "roi_id"], giant=area > limit if mixed else None)


def roi_failures(rois: DataFrame, statistics: DataFrame) -> DataFrame:
    """Invalid ROIs, and valid ones without a finite sample."""
    prepared = prepare_rois(rois).select("frame_id", "roi_id", "error")
    return prepared.join(statistics, ["frame_id", "roi_id"], "left_anti").select(
        "frame_id",
        "roi_id",
        F.coalesce("error", F.lit("measurement contains no finite temperature samples")).alias("error"),
    )


def spot_delta(pixels: DataFrame, pairs: DataFrame, kernel: int = 4) -> DataFrame:
    """mean(second spot) − mean(first spot) for ``(frame_id, pair_id, x0, y0, x1, y1, height, width)``."""
    nothing = F.lit(None).cast("double")
    ends = F.array(F.struct(F.lit(0).alias("end"), F.col("x0").alias("x"), F.col("y0").alias("y")),
                   F.struct(F.lit(1).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    spots = pairs.withColumn("e", F.explode(ends)).select(
        "frame_id", "height", "width", F.lit("spot").alias("kind"),
        F.struct("pair_id", "e.end").alias("roi_id"),
        F.col("e.x").cast("double").alias("x0"), F.col("e.y").cast("double").alias("y0"),
        *[nothing.alias(n) for n in ("x1", "y1", "cx", "cy", "rx", "ry", "width_px")],
        F.lit(kernel).alias("kernel"),
        F.lit(None).cast("array<struct<x:double,y:double>>").alias("points"),
    )
    inside = roi_pixels(pixels, prepare_rois(spots))
    mean_at = lambda e: F.avg(F.when(F.col("roi_id.end") == e, F.col("temp_c")))
    return inside.groupBy("frame_id", F.col("roi_id.pair_id").alias("pair_id")).agg(
        (mean_at(1) - mean_at(0)).alias("delta_c")
    )
