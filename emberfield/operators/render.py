"""Presentation columns: limits, palettes, 8-bit scaling, RGB pair views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.operators.sheets import BLOCK, BLOCK_KEYS, KEYS, over_blocks, with_blocks
from emberfield.operators.statistics import GIANT_GROUP, any_giant, binned_quantiles, is_giant


def sheet_quantiles(sheets: DataFrame, probs: list[float], limit: int = GIANT_GROUP) -> DataFrame:
    """``frame_id, tile_id, height, width, q``; sheets without samples have a NULL ``q``."""
    extent = [F.max("height").alias("height"), F.max("width").alias("width")]
    mixed = any_giant(sheets, limit)
    small = sheets.where(~is_giant(limit)) if mixed else sheets
    exact = small.groupBy(*KEYS).agg(
        *extent, F.percentile("temp_c", F.array(*[F.lit(p) for p in probs])).alias("q")
    )
    if not mixed:
        return exact
    giants = sheets.where(is_giant(limit))
    binned = giants.groupBy(*KEYS).agg(*extent).join(binned_quantiles(giants, KEYS, "temp_c", probs), KEYS, "left")
    return exact.unionByName(binned)


def _widen(low: Column, high: Column) -> Column:
    return F.when(high <= low, low + 1.0).otherwise(high)


def automatic_limits(sheets: DataFrame, low_p: float = 0.02, high_p: float = 0.98) -> DataFrame:
    """low/high with span and level; a frame without samples gets (0, 1)."""
    q = sheet_quantiles(sheets, [low_p, high_p])
    low = F.coalesce(F.col("q")[0], F.lit(0.0))
    out = q.withColumns({"low_c": low, "high_c": F.coalesce(F.col("q")[1], F.lit(1.0))}).drop("q")
    out = out.withColumn("high_c", _widen(F.col("low_c"), F.col("high_c")))
    return out.withColumns(
        {"span_c": F.col("high_c") - F.col("low_c"), "level_c": (F.col("low_c") + F.col("high_c")) / 2.0}
    )


def style_limits(
    sheets: DataFrame,
    span: float | None = None,
    level: float | None = None,
    minimum: float | None = None,
    maximum: float | None = None,
) -> DataFrame:
    """Limits per sheet from span/level, explicit ends, or the 2–98 % range for the missing ends."""
    if (span is None) != (level is None):
        raise ValueError("span and level must be supplied together")
    if span is not None and span <= 0:
        raise ValueError("span must be positive")
    if minimum is not None and maximum is not None and maximum <= minimum:
        raise ValueError("maximum must exceed minimum")
    if span is not None:
        minimum, maximum = level - span / 2.0, level + span / 2.0
    auto = automatic_limits(sheets)
    raw = sheet_quantiles(sheets, [0.02, 0.98]) if minimum is not None or maximum is not None else None
    if raw is None:
        return auto.select(*KEYS, "height", "width", "low_c", "high_c")
    low = F.lit(float(minimum)) if minimum is not None else F.coalesce(F.col("q")[0], F.lit(0.0))
    high = F.lit(float(maximum)) if maximum is not None else F.coalesce(F.col("q")[1], F.lit(1.0))
    return raw.select(*KEYS, "height", "width", low.alias("low_c"), _widen(low, high).alias("high_c"))


def _scaled() -> Column:
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("temp_c") - F.col("low_c")) / (F.col("high_c") - F.col("low_c"))))
    return F.coalesce(F.when(F.col("temp_c").isNotNull(), unit), F.lit(0.0))


def palette_channel(position: Column, palette: str, channel: int) -> Column:
    """Piecewise-linear anchor interpolation, rounded half to even."""
    anchors = fv.PALETTES[palette]
    branch = F.when(position <= anchors[0][0], F.lit(float(anchors[0][1][channel])))
    for (p0, c0), (p1, c1) in zip(anchors, anchors[1:]):
        slope = (c1[channel] - c0[channel]) / (p1 - p0)
        branch = branch.when(position <= p1, slope * (position - p0) + float(c0[channel]))
    return F.rint(branch.otherwise(float(anchors[-1][1][channel]))).cast("int")


def _with_limits(sheets: DataFrame, limits: DataFrame, block: int = BLOCK) -> DataFrame:
    spread = over_blocks(limits, block).drop("height", "width")
    return with_blocks(sheets, block).join(spread, BLOCK_KEYS)


def render(
    sheets: DataFrame,
    limits: DataFrame,
    palette: str = "ironbow",
    isotherm: tuple[float, float | None] | None = None,
) -> DataFrame:
    """F16: r, g, b per pixel; temperatures stay untouched beside them."""
    key = palette.strip().lower()
    if key not in fv.PALETTES:
        raise ValueError(f"unsupported palette: {palette!r}")
    toned = _with_limits(sheets, limits).withColumn("position", _scaled())
    lit = F.lit(False)
    if isotherm is not None:
        low, high = isotherm
        lit = F.col("temp_c") >= low
        lit = lit & (F.col("temp_c") <= high) if high is not None else lit
    rgb = {
        name: F.when(lit, fv.ISOTHERM_RGB[i]).otherwise(palette_channel(F.col("position"), key, i))
        for i, name in enumerate("rgb")
    }
    return toned.withColumns(rgb).select(*KEYS, "row_idx", "col_idx", "temp_c", "r", "g", "b")


def grayscale(sheets: DataFrame, limits: DataFrame) -> DataFrame:
    """the radiometric view truncates, previews round half to even."""
    toned = _with_limits(sheets, limits).withColumn("position", _scaled())
    return toned.select(
        *KEYS,
        "row_idx",
        "col_idx",
        F.floor(F.col("position") * 255.0).cast("int").alias("gray_truncated"),
        F.rint(F.col("position") * 255.0).cast("int").alias("gray_rounded"),
    )


def _resize(rgb: DataFrame, height: Column, width: Column) -> DataFrame:
    """Nearest resize towards smaller: a source pixel fills every target whose floor index hits it."""

    def targets(index: str, size: str, target: Column) -> Column:
        first = F.ceil(F.col(index) * target / F.col(size)).cast("int")
        last = F.ceil((F.col(index) + 1) * target / F.col(size)).cast("int") - 1
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return rgb.withColumn("t_row", F.explode(targets("row_idx", "height", height))).withColumn(
        "t_col", F.explode(targets("col_idx", "width", width))
    )


def align_pair(pairs: DataFrame, rgb: DataFrame) -> DataFrame:
    """Both images of ``(pair_id, left_id, right_id, h_l, w_l, h_r, w_r)`` on the smaller shape."""
    size = pairs.withColumns({"h": F.least("h_l", "h_r"), "w": F.least("w_l", "w_r")})
    channel = lambda s: [F.col(c).alias(f"{c}_{s}") for c in "rgb"]

    def side(s: str) -> DataFrame:
        image = rgb.withColumnRenamed("image_id", f"{s}_id").join(
            size.select("pair_id", f"{s}_id", "h", "w"), f"{s}_id"
        )
        return _resize(image, F.col("h"), F.col("w")).select("pair_id", "t_row", "t_col", "h", "w", *channel(s))

    return side("left").join(side("right").drop("h", "w"), ["pair_id", "t_row", "t_col"])


def blend(aligned: DataFrame, opacity: float = 0.5) -> DataFrame:
    if not 0.0 <= opacity <= 1.0:
        raise ValueError("opacity must be between 0 and 1")
    return aligned.select(
        "pair_id",
        "t_row",
        "t_col",
        *[F.rint(F.col(f"{c}_left") * (1.0 - opacity) + F.col(f"{c}_right") * opacity).cast("int").alias(c) for c in "rgb"],
    )


def swipe(aligned: DataFrame, fraction: float = 0.5) -> DataFrame:
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be between 0 and 1")
    split = F.rint(F.col("w") * fraction)
    return aligned.select(
        "pair_id",
        "t_row",
        "t_col",
        *[F.when(F.col("t_col") < split, F.col(f"{c}_left")).otherwise(F.col(f"{c}_right")).alias(c) for c in "rgb"],
    )


def side_by_side(aligned: DataFrame) -> DataFrame:
    """Left and right image next to each other on one canvas of double width."""
    half = lambda s, shift: aligned.select(
        "pair_id", "t_row", (F.col("t_col") + shift).alias("t_col"), *[F.col(f"{c}_{s}").alias(c) for c in "rgb"]
    )
    return half("left", F.lit(0)).unionByName(half("right", F.col("w")))
