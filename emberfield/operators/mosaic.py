"""Georeferenced mosaic of Celsius frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.functions.geo import frame_bounds, pixel_to_map
from emberfield.operators.radiometry import classify_sources


def mosaic_contract(frames: DataFrame, encodings: DataFrame) -> DataFrame:
    """One row: ``ok`` and the first broken rule. All checks are combinable aggregates over frames."""
    f = classify_sources(
        frames.withColumns({"pixel_count": F.col("width").cast("long") * F.col("height"), "configured": F.lit(False)})
    ).join(encodings, "frame_id", "left")
    gate = f.agg(
        F.count("*").alias("source_count"),
        F.count_if(~F.col("radiometric_candidate")).alias("non_radiometric"),
        F.count_if(F.col("band_count") != 1).alias("multi_band"),
        F.count_if(F.col("crs").isNull()).alias("no_crs"),
        F.count_if(F.col("error").isNotNull()).alias("bad_encoding"),
        F.count_distinct("crs").alias("crs_values"),
        F.count_distinct("scale", "offset", "resolved_unit").alias("encodings"),
        F.min("crs").alias("crs"),
        F.min("scale").alias("scale"),
        F.min("offset").alias("offset"),
        F.min("resolved_unit").alias("unit"),
    )
    error = (
        F.when(F.col("source_count") == 0, "no mosaic sources")
        .when(F.col("non_radiometric") > 0, "non-radiometric mosaic source")
        .when(F.col("multi_band") > 0, "mosaic requires one scalar band")
        .when(F.col("no_crs") > 0, "mosaic requires an explicit CRS")
        .when(F.col("bad_encoding") > 0, "mosaic source encoding could not be resolved")
        .when(F.col("crs_values") != 1, "mosaic requires sources in one CRS")
        .when(F.col("encodings") != 1, "mosaic requires one shared radiometric encoding")
    )
    return gate.withColumn("error", error).withColumn("ok", F.col("error").isNull())


def mosaic_grid(frames: DataFrame, resolution: float | None = None) -> dict:
    """Origin, resolution and size of the common grid: a one-row aggregate over the frame metadata."""
    b = frame_bounds(frames).join(frames.select("frame_id", "input_order"), "frame_id")
    g = b.agg(
        F.min("bound_left").alias("left"),
        F.max("bound_top").alias("top"),
        F.max("bound_right").alias("right"),
        F.min("bound_bottom").alias("bottom"),
        F.min_by("resolution_x", "input_order").alias("rx"),
        F.min_by("resolution_y", "input_order").alias("ry"),
    ).first().asDict()
    if resolution is not None:
        g["rx"] = g["ry"] = float(resolution)
    g["width"] = max(1, round((g["right"] - g["left"]) / g["rx"]))
    g["height"] = max(1, round((g["top"] - g["bottom"]) / g["ry"]))
    return g


def _covered(low: Column, high: Column) -> Column:
    """Numbers of the unit cells whose centres lie from ``low`` up to ``high``; empty where there is none."""
    first, last = F.ceil(F.round(low, 6) - 0.5), F.ceil(F.round(high, 6) - 0.5) - 1
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def mosaic_pixels(pixels: DataFrame, frames: DataFrame, resolution: float | None = None) -> DataFrame:
    """T4: dense Celsius cells ``row_idx, col_idx, temp_c`` on the common grid; cells without a source are NULL.

    Nearest resampling of north-up frames: a source pixel gives its value to the cells whose centres it covers, so coarse
    sources fill all their cells and fine ones hand over one pixel per cell. The grid is one row of frame metadata read
    first, so extents are literals in the plan. Overlaps resolve by a combinable minimum over the source
    order, so a cell covered by many frames never gathers its pixels in one place.
    """
    g = mosaic_grid(frames, resolution)
    placed = pixels.select("frame_id", "row_idx", "col_idx", "temp_c").where("temp_c IS NOT NULL").join(
        frames.select("frame_id", "transform", "input_order"), "frame_id"
    )
    # Corners of a pixel, from the centres of its neighbours half a step away.
    left, top = pixel_to_map(F.col("col_idx") - 0.5, F.col("row_idx") - 0.5, F.col("transform"))
    right, bottom = pixel_to_map(F.col("col_idx") + 0.5, F.col("row_idx") + 0.5, F.col("transform"))
    cells = (
        placed.withColumn("g_col", F.explode(_covered((left - g["left"]) / g["rx"], (right - g["left"]) / g["rx"])))
        .withColumn("g_row", F.explode(_covered((F.lit(g["top"]) - top) / g["ry"], (F.lit(g["top"]) - bottom) / g["ry"])))
        .where(F.col("g_row").between(0, g["height"] - 1) & F.col("g_col").between(0, g["width"] - 1))
        .groupBy((F.col("g_row") * g["width"] + F.col("g_col")).alias("id"))
        .agg(F.min(F.struct("input_order", "row_idx", "col_idx", "temp_c")).alias("pick"))
        .select("id", F.col("pick.temp_c").alias("temp_c"))
    )
    grid = pixels.sparkSession.range(g["height"] * g["width"])
    return grid.join(cells, "id", "left").select(
        F.lit(0).cast("long").alias("frame_id"),
        F.floor(F.col("id") / g["width"]).cast("int").alias("row_idx"),
        (F.col("id") % g["width"]).cast("int").alias("col_idx"),
        "temp_c",
        F.lit(g["height"]).alias("height"),
        F.lit(g["width"]).alias("width"),
    )


def should_stitch(sources: int, mode: str = "auto") -> bool:
    if mode not in ("off", "on", "auto"):
        raise ValueError("mode must be off, on or auto")
    return mode == "on" or (mode == "auto" and sources > 1)


def stitch_or_keep(
    pixels: DataFrame, frames: DataFrame, encodings: DataFrame, mode: str = "auto"
) -> tuple[DataFrame, bool, list[str]]:
    """T5: (pixels to analyse, stitched?, warnings). Reads the one-row contract, nothing else."""
    gate = mosaic_contract(frames, encodings).select("source_count", "ok", "error").first()
    if not should_stitch(gate["source_count"], mode):
        return pixels, False, []
    if gate["ok"]:
        return mosaic_pixels(pixels, frames), True, []
    if mode == "on":
        raise ValueError(gate["error"])
    return pixels, False, [
        "Automatic stitching was unavailable for these sources; processing continued against the original radiometric inputs"
    ]


def mosaic_report(contract: DataFrame, cells: DataFrame, resolution: float | None = None) -> DataFrame:
    """One row describing the mosaic; the contract is a single row of metadata."""
    c = contract.first()
    note = lambda name: F.lit(c[name]).alias(name)
    return cells.agg(
        F.max("width").alias("width"),
        F.max("height").alias("height"),
        F.count("*").alias("covered_cells"),
        F.count("temp_c").alias("valid_cells"),
    ).select(
        F.lit("dataframe-grid").alias("backend"),
        F.lit(True).alias("quantitative"),
        F.lit("celsius").alias("output_unit"),
        *[note(n) for n in ("source_count", "scale", "offset", "unit", "crs")],
        F.lit(resolution).cast("double").alias("resolution"),
        "width",
        "height",
        "covered_cells",
        "valid_cells",
    )
