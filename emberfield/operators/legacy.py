"""The older threshold workflow: tile units, 50 °C regions, histogram, report columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.functions.columns import fixed, text_lookup
from emberfield.functions.geo import box_area_m2, box_to_latlon, from_wgs84, to_wgs84, world_area_m2, world_file_to_map
from emberfield.operators.regions import label_regions, pixel_runs
from emberfield.operators.sheets import KEYS, int_div


def tile_units(pixels: DataFrame, size: int = fv.LEGACY_TILE, value: str = "raw") -> DataFrame:
    """per tile, the maximum decides the unit; a tile with a missing value is skipped.

    Tiles (no halo) become sheets: ``tile_id`` with tile-local rows and columns. The tile maximum is
    a combinable aggregate joined back on the tile, so a large frame is no hot key.
    """
    columns = int_div(F.col("width") - 1, size) + 1
    t = pixels.select(
        "frame_id",
        (int_div(F.col("row_idx"), size) * columns + int_div(F.col("col_idx"), size)).cast("int").alias("tile_id"),
        int_div(F.col("row_idx"), size).alias("tile_r"),
        int_div(F.col("col_idx"), size).alias("tile_c"),
        "row_idx",
        "col_idx",
        F.col(value).alias("raw"),
        "height",
        "width",
    )
    top = t.groupBy(*KEYS).agg(F.max("raw").alias("top"), F.count_if(F.expr("raw IS NULL")).alias("missing"))
    celsius = (
        F.when(F.col("top") > 1000, F.col("raw") - 273.15).when(F.col("top") < 100, F.col("raw")).otherwise(F.col("raw") / 10.0)
    )
    return (
        t.join(top.where("missing = 0").drop("missing"), KEYS)
        .withColumns(
            {
                "temp_c": celsius,
                "frame_row": F.col("row_idx"),
                "frame_col": F.col("col_idx"),
                "row_idx": F.col("row_idx") - F.col("tile_r") * size,
                "col_idx": F.col("col_idx") - F.col("tile_c") * size,
                "height": F.least(F.lit(size), F.col("height") - F.col("tile_r") * size),
                "width": F.least(F.lit(size), F.col("width") - F.col("tile_c") * size),
            }
        )
        .drop("top", "raw")
    )


def normal_mean(tiles: DataFrame) -> DataFrame:
    """Mean below the threshold per frame."""
    cool = F.when(F.col("temp_c") < fv.LEGACY_THRESHOLD_C, F.col("temp_c"))
    return tiles.groupBy("frame_id").agg(F.avg(cool).alias("normal_mean_c"), F.count(cool).alias("normal_pixels"))


def tiled_histogram(tiles: DataFrame, bins: int = fv.LEGACY_BINS) -> DataFrame:
    """A9 tiled: fixed 0–50 bins, per-tile densities weighted by the tile's count below 50 °C.

    Values below 0 miss the bins but still weigh. Density inside a tile divides by the binned count.
    """
    width = fv.LEGACY_THRESHOLD_C / bins
    cool = tiles.where(F.col("temp_c") < fv.LEGACY_THRESHOLD_C)
    sizes = cool.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(F.expr("temp_c >= 0")).alias("binned"))
    counts = (
        cool.where("temp_c >= 0")
        .withColumn("bin", F.least(F.floor(F.col("temp_c") / width).cast("int"), F.lit(bins - 1)))
        .groupBy(*KEYS, "bin")
        .agg(F.count("*").alias("c"))
    )
    totals = sizes.groupBy("frame_id").agg(F.sum("n").alias("total"))
    share = F.col("c") / (F.col("binned") * width) * F.col("n")
    weighted = counts.join(sizes, KEYS).groupBy("frame_id", "bin").agg(F.sum(share).alias("weight"), F.sum("c").alias("n"))
    return weighted.join(totals, "frame_id").select(
        "frame_id", "bin", (F.col("bin") * width).alias("bin_start"), "n", (F.col("weight") / F.col("total")).alias("density")
    )


def frame_histogram(pixels: DataFrame, bins: int = fv.LEGACY_BINS) -> DataFrame:
    """A9 full frame: bins over the data range below 50 °C, the last bin closed on the right."""
    cool = pixels.where(F.col("temp_c") < fv.LEGACY_THRESHOLD_C).select("frame_id", "temp_c")
    ends = cool.groupBy("frame_id").agg(
        F.min("temp_c").alias("low"), F.max("temp_c").alias("high"), F.count("*").alias("total")
    )
    # a single value gets a unit range around it
    flat = F.col("low") == F.col("high")
    ends = ends.withColumns(
        {"lo": F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")), "hi": F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))}
    ).withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    bin_no = F.least(F.floor((F.col("temp_c") - F.col("lo")) / F.col("step")).cast("int"), F.lit(bins - 1))
    counts = cool.join(ends, "frame_id").withColumn("bin", bin_no).groupBy("frame_id", "bin", "lo", "step", "total").agg(
        F.count("*").alias("n")
    )
    return counts.select(
        "frame_id",
        "bin",
        (F.col("lo") + F.col("bin") * F.col("step")).alias("bin_start"),
        "n",
        (F.col("n") / (F.col("total") * F.col("step"))).alias("density"),
    )


def legacy_class(maximum: Column, area: Column, delta: Column) -> dict[str, Column]:
    """type by maximum and area, severity by maximum, annotation text."""
    text = fixed(delta, 1)
    rules = [  # fixed values: (maximum above, area above, type, text before and after ΔT)
        (90, 1000, "Severe Hot Spot", "Critical defect likely in module or wiring", "Immediate inspection required."),
        (70, 500, "Hot Spot", "Overheating issue, possibly due to dirt, shading, or defect", "Monitor closely."),
        (50, 100, "Warm Spot", "Minor temperature elevation, may indicate early-stage issue", "Monitor periodically."),
    ]
    note = lambda before, after: F.concat(F.lit(before + " (ΔT: "), text, F.lit("°C). " + after))
    kind, words = F, F
    for high, size, name, before, after in rules:
        hit = (maximum > high) & (area > size)
        kind, words = kind.when(hit, name), words.when(hit, note(before, after))
    return {
        "type": kind.otherwise("Minor Anomaly"),
        "severity": F.when(maximum > 90, "Critical").when(maximum > 70, "Moderate").otherwise("Minor"),
        "annotation": words.otherwise(note("Small temperature rise, likely benign", "Monitor for changes.")),
    }


def threshold_regions(tiles: DataFrame, minimum_area: int = fv.LEGACY_MINIMUM_AREA) -> DataFrame:
    """8-connected regions above 50 °C and 50 px per tile, ΔT from the frame's normal mean."""
    hot = tiles.where(F.col("temp_c") > fv.LEGACY_THRESHOLD_C)
    runs = pixel_runs(
        hot,
        [
            F.count("*").alias("area"),
            F.sum(F.col("frame_col").cast("long")).alias("sum_col"),
            F.sum(F.col("frame_row").cast("long")).alias("sum_row"),
            F.max("temp_c").alias("top"),
        ],
    )
    regions = label_regions(runs, 8).groupBy(*KEYS, "label").agg(
        F.sum("area").alias("area"),
        F.floor(F.sum("sum_col") / F.sum("area")).cast("int").alias("center_x"),
        F.floor(F.sum("sum_row") / F.sum("area")).cast("int").alias("center_y"),
        F.max("top").alias("max_temp"),
    )
    found = regions.where(F.col("area") > minimum_area).join(normal_mean(tiles), "frame_id")
    found = found.withColumn("temp_delta", F.col("max_temp") - F.col("normal_mean_c"))
    return found.withColumns(legacy_class(F.col("max_temp"), F.col("area"), F.col("temp_delta"))).drop("normal_pixels")


def legacy_register(regions: DataFrame) -> DataFrame:
    """K5: priority, maintenance action and a per-frame number in tile and discovery order."""
    order = Window.partitionBy("frame_id").orderBy("tile_id", "label")
    return regions.withColumns(
        {
            "anomaly_id": F.row_number().over(order),
            "priority": F.when(F.col("severity") == "Critical", 1).when(F.col("severity") == "Moderate", 2).otherwise(3),
            "maintenance_action": text_lookup(
                F.col("type"), fv.LEGACY_ACTIONS, F.lit("Monitor and reassess during next inspection.")
            ),
            "display_x": F.floor(F.col("center_x") * 0.1).cast("int"),
            "display_y": F.floor(F.col("center_y") * 0.1).cast("int"),
        }
    )


def legacy_coordinates(register: DataFrame, places: DataFrame) -> DataFrame:
    """K5: map and geographic coordinates and square metres of the numbered regions.

    ``places``: frame_id, width, height, crs, ``box`` (a KML box) and ``world`` (a world file), either of them NULL. A box
    decides where there is one; else the world file, whose map units are US survey feet. Without either all stay NULL.
    """
    r = register.join(places, "frame_id", "left")
    x, y, box, world = F.col("center_x"), F.col("center_y"), F.col("box"), F.col("world")
    lat, lon = box_to_latlon(x, y, box, F.col("width"), F.col("height"))
    map_x, map_y = world_file_to_map(x, y, world)
    r = r.withColumns({"_lat": lat, "_lon": lon, "_x": map_x, "_y": map_y})
    box_x, box_y = from_wgs84(F.col("_lon"), F.col("_lat"), F.col("crs"))
    world_lon, world_lat = to_wgs84(F.col("_x"), F.col("_y"), F.col("crs"))
    boxed = box.isNotNull()
    either = lambda a, b: F.when(boxed, a).otherwise(b)
    by_box = box_area_m2(F.col("area"), F.col("_lat"), box, F.col("width"), F.col("height"))
    return r.withColumns(
        {
            "coord_x": either(box_x, F.col("_x")),
            "coord_y": either(box_y, F.col("_y")),
            "latitude": either(F.col("_lat"), world_lat),
            "longitude": either(F.col("_lon"), world_lon),
            "area_m2": either(by_box, world_area_m2(F.col("area"), world)),
        }
    ).drop("_lat", "_lon", "_x", "_y", *[c for c in places.columns if c != "frame_id"])


def batch_register(regions: DataFrame) -> DataFrame:
    """The batch variant: no priority or action columns."""
    return legacy_register(regions).drop("priority", "maintenance_action", "display_x", "display_y")
