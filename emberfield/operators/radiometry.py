"""Source classification, encoding and unit resolution, Celsius normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.functions.columns import clean_number, first_of, flag, present, text_lookup


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """``(frame_id, values ARRAY, width[, row_off, col_off])`` to dense pixels with their extent."""
    offset = lambda n: F.coalesce(F.col(n), F.lit(0)) if n in tiles.columns else F.lit(0)
    height = "height" if "height" in tiles.columns else F.ceil(F.size("values") / F.col("width")).cast("int")
    return tiles.select(
        "frame_id",
        F.col("width").cast("int").alias("width"),
        (F.col(height) if isinstance(height, str) else height).alias("height"),
        offset("row_off").alias("row_off"),
        offset("col_off").alias("col_off"),
        F.posexplode("values").alias("pos", "v"),
    ).select(
        "frame_id",
        (F.col("row_off") + F.floor(F.col("pos") / F.col("width"))).cast("int").alias("row_idx"),
        (F.col("col_off") + F.col("pos") % F.col("width")).cast("int").alias("col_idx"),
        clean_number(F.col("v").cast("double")).alias("temp_c"),
        "height",
        "width",
    )


def upper_tags(tags: Column) -> Column:
    return F.transform_keys(tags, lambda k, _: F.upper(k))


def tag_value(tags: Column, keys: list[str]) -> Column:
    """First non-blank tag in key order. ``tags`` has upper-case keys."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(tags, F.lit(k))), F.lit("")) for k in keys])


def parse_bool(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return first_of((word.isin(fv.TRUE_WORDS), True), (word.isin(fv.FALSE_WORDS), False))


def classify_sources(sources: DataFrame) -> DataFrame:
    """S2 over ``(tags, band_count, dtype, pixel_count, configured)``."""
    tags = upper_tags(F.col("tags"))
    out = sources.withColumns(
        {
            "is_calibrated": parse_bool(F.try_element_at(tags, F.lit("ISCALIBRATED"))),
            "explicit": F.col("configured")
            | tag_value(tags, fv.UNIT_KEYS).isNotNull()
            | tag_value(tags, fv.SCALE_KEYS).isNotNull()
            | tag_value(tags, fv.OFFSET_KEYS).isNotNull(),
            "byte_like": F.lower("dtype").isin("uint8", "int8"),
        }
    )
    ambiguous = F.col("byte_like") & ~F.col("explicit")
    reasons = present(
        (F.col("is_calibrated") == F.lit(False), fv.REASON_UNCALIBRATED),
        (ambiguous & (F.col("band_count") >= 3), fv.REASON_RENDERED),
        (ambiguous & (F.col("band_count") < 3), fv.REASON_AMBIGUOUS),
    )
    out = out.withColumn("radiometric_reasons", reasons)
    return out.withColumns(
        {
            "radiometric_candidate": F.size("radiometric_reasons") == 0,
            "requires_tiled_processing": F.col("pixel_count") > fv.FULL_FRAME_PIXEL_LIMIT,
            "minimum_float32_band_gib": F.bround(F.col("pixel_count") * 4 / float(1024**3), 3),
        }
    ).drop("explicit", "byte_like")


def resolve_encoding(
    sources: DataFrame, scale: float = 1.0, offset: float = 0.0, unit: str = "auto"
) -> DataFrame:
    """S3: tags win over dataset values (where 0 means missing), which win over the configured default."""
    tags = upper_tags(F.col("tags"))

    def number(keys: list[str], dataset: str, default: float) -> Column:
        return F.coalesce(
            tag_value(tags, keys).cast("double"), F.nullif(F.col(dataset), F.lit(0.0)), F.lit(float(default))
        )

    return sources.withColumns(
        {
            "scale": number(fv.SCALE_KEYS, "dataset_scale", scale),
            "offset": number(fv.OFFSET_KEYS, "dataset_offset", offset),
            "unit": F.coalesce(tag_value(tags, fv.UNIT_KEYS), F.lit(unit)),
        }
    )


def canonical_unit(unit: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(unit)), "[° ]", "")
    return text_lookup(plain, fv.UNIT_ALIASES, plain)


def inferred_unit(median: Column) -> Column:
    return first_of(*[(median.between(low, high), unit) for low, high, unit in fv.UNIT_RANGES])


def to_celsius(value: Column, unit: Column) -> Column:
    """S6 for a canonical unit; an unsupported unit gives NULL (it is reported by the frame check)."""
    return (
        F.when(unit == "celsius", value)
        .when(unit == "kelvin", value - 273.15)
        .when(unit == "fahrenheit", (value - 32.0) * (5.0 / 9.0))
        .when(unit == "decicelsius", value / 10.0)
        .when(unit == "decikelvin", value / 10.0 - 273.15)
        .when(unit == "centikelvin", value / 100.0 - 273.15)
    )


SUPPORTED_UNITS = ["celsius", "kelvin", "fahrenheit", "decicelsius", "decikelvin", "centikelvin"]


def frame_encodings(raw: DataFrame, frames: DataFrame, giant: int | None = None) -> DataFrame:
    """S3+S5 per frame: ``frame_id, scale, offset, resolved_unit, error``.

    Only frames whose unit is ``auto`` have their pixels read, all of them. Frames of more than ``giant`` pixels
    find their median by binned counts; which those are is read from ``frames``.
    """
    from emberfield.operators.statistics import GIANT_GROUP, binned_quantiles, is_giant

    large = is_giant(giant or GIANT_GROUP)
    encoded = resolve_encoding(frames).withColumn("canonical", canonical_unit(F.col("unit")))
    unknown = encoded.where("canonical = 'auto'").select("frame_id", "scale", "offset", large.alias("large"))
    scaled = clean_number(F.col("raw")) * F.col("scale") + F.col("offset")
    values = raw.join(unknown, "frame_id").select("frame_id", "large", scaled.alias("scaled"))
    medians = values.where("NOT large").groupBy("frame_id").agg(F.median("scaled").alias("median_scaled"))
    if unknown.where("large").limit(1).count():
        binned = binned_quantiles(values.where("large"), ["frame_id"], "scaled", [0.5])
        medians = medians.unionByName(binned.select("frame_id", F.col("q")[0].alias("median_scaled")))
    out = encoded.join(medians, "frame_id", "left").withColumn(
        "resolved_unit",
        F.when(F.col("canonical") == "auto", inferred_unit(F.col("median_scaled"))).otherwise(F.col("canonical")),
    )
    error = (
        F.when((F.col("canonical") == "auto") & F.col("median_scaled").isNull(), "no finite thermal samples")
        .when(F.col("resolved_unit").isNull(), fv.UNIT_ERROR)
        .when(~F.col("resolved_unit").isin(SUPPORTED_UNITS), F.concat(F.lit("unsupported thermal unit: "), F.col("unit")))
    )
    return out.select("frame_id", "scale", "offset", "resolved_unit", error.alias("error"))


def normalise(raw: DataFrame, encodings: DataFrame) -> DataFrame:
    """S4+S6: raw counts to Celsius; frames with an encoding error are left out (see ``source_failures``)."""
    good = encodings.where("error IS NULL").select("frame_id", "scale", "offset", "resolved_unit")
    scaled = clean_number(F.col("raw")) * F.col("scale") + F.col("offset")
    return (
        raw.join(good, "frame_id")
        .withColumn("temp_c", to_celsius(scaled, F.col("resolved_unit")))
        .drop("raw", "scale", "offset", "resolved_unit")
    )


def source_failures(encodings: DataFrame) -> DataFrame:
    """L3: a bad source becomes a row; the other sources go on."""
    return encodings.where("error IS NOT NULL").select("frame_id", F.lit("ValueError").alias("error_type"), "error")


def decimate(pixels: DataFrame, edge: int, value: str = "temp_c") -> DataFrame:
    """Nearest decimation to at most ``edge`` pixels per side (first source pixel of each cell)."""
    small_h, small_w = F.least(F.col("height"), F.lit(edge)), F.least(F.col("width"), F.lit(edge))
    cell_r = F.floor(F.col("row_idx") * small_h / F.col("height")).cast("int")
    cell_c = F.floor(F.col("col_idx") * small_w / F.col("width")).cast("int")
    first = (F.col("row_idx") == F.ceil(cell_r * F.col("height") / small_h)) & (
        F.col("col_idx") == F.ceil(cell_c * F.col("width") / small_w)
    )
    return pixels.where(first).withColumns({"row_idx": cell_r, "col_idx": cell_c})


def probe_sources(pixels: DataFrame) -> DataFrame:
    """Extremes, median and masked count over all pixels of a frame; the median is exact at any size."""
    from emberfield.operators.statistics import giant_route, summarize

    counts = pixels.groupBy("frame_id").agg(F.count_if(F.col("temp_c").isNull()).alias("sample_masked"), F.count("*").alias("sample_pixels"))
    figures = summarize(pixels, ["frame_id"], giant=giant_route(pixels)).select(
        "frame_id",
        F.col("minimum_c").alias("sample_min"),
        F.col("maximum_c").alias("sample_max"),
        F.col("median_c").alias("sample_median"),
    )
    return counts.join(figures, "frame_id", "left")


def preview_shape(frames: DataFrame, edge: int = fv.PREVIEW_EDGE) -> DataFrame:
    scale = F.least(F.lit(1.0), edge / F.greatest("width", "height"))
    side = lambda n: F.greatest(F.lit(1), F.rint(F.col(n) * scale).cast("int"))
    return frames.withColumns({"preview_height": side("height"), "preview_width": side("width")})


def probe_points(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Temperature at ``(frame_id, x, y)``, NULL outside or on nodata. Equi-join on the full pixel key."""
    at = pixels.select("frame_id", F.col("row_idx").alias("y"), F.col("col_idx").alias("x"), "temp_c")
    return points.join(at, ["frame_id", "x", "y"], "left")


CALIBRATION_LIMITS = [
    # fixed values: (column, low, low_inclusive, high, text)
    ("emissivity", 0.1, True, 1.0, "emissivity must be between 0.1 and 1.0"),
    ("distance_m", 0.0, False, 10000.0, "distance_m must be greater than 0"),
    ("relative_humidity", 0.0, True, 1.0, "relative_humidity must be between 0.0 and 1.0"),
    ("reflected_temperature_c", -100.0, True, 1000.0, "reflected_temperature_c is outside supported bounds"),
    ("ambient_temperature_c", -100.0, True, 1000.0, "ambient_temperature_c is outside supported bounds"),
]
VENDOR_LIMITS = [
    # fixed values: (column, low, high, text)
    ("distance_m", 1.0, 25.0, "distance must be between 1 and 25 meters"),
    ("relative_humidity", 0.2, 1.0, "humidity must be between 20% and 100%"),
    ("reflected_temperature_c", -40.0, 500.0, "reflected temperature must be between -40 and 500 °C"),
]


def validate_calibration(calibrations: DataFrame) -> DataFrame:
    """``violations`` and ``vendor_violations`` per calibration row; an empty array is valid."""

    def outside(name: str, low: float, inclusive: bool, high: float) -> Column:
        below = F.col(name) < low if inclusive else F.col(name) <= low
        return flag(below | (F.col(name) > high))

    general = present(*[(outside(n, lo, inc, hi), text) for n, lo, inc, hi, text in CALIBRATION_LIMITS])
    vendor = present(*[(outside(n, lo, True, hi), text) for n, lo, hi, text in VENDOR_LIMITS])
    return calibrations.withColumns({"violations": general, "vendor_violations": vendor})
