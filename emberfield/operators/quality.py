"""Radiometric quality gate (A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.functions.columns import flag, present
from emberfield.operators.blocks import metrics_of
from emberfield.operators.radiometry import upper_tags


def _percent(value: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(value * 100.0, 1))


def pixel_metrics(pixels: DataFrame) -> DataFrame:
    """Per-frame counts of values, wherever they stand: only ``frame_id``, ``temp_c``, ``height`` and ``width`` are read.

    Equal values of a frame are counted first, so the extremes' ties need no second look at the pixels and no frame is one task's.
    """
    low, high = fv.PLAUSIBLE_RANGE_C
    n, t, valid = F.col("n"), F.col("temp_c"), F.col("temp_c").isNotNull()
    values = pixels.select("frame_id", F.col("temp_c").cast("double").alias("temp_c"), F.col("height").cast("int"), F.col("width").cast("int"))
    counted = values.groupBy("frame_id", "temp_c").agg(F.count(F.lit(1)).alias("n"), F.max("height").alias("height"), F.max("width").alias("width"))
    of = lambda rows: F.coalesce(F.sum(F.when(rows, n)), F.lit(0).cast("bigint"))
    return metrics_of(
        counted.groupBy("frame_id").agg(
            F.sum("n").alias("n_cells"),
            of(valid).alias("valid_pixels"),
            F.min(t).alias("minimum_c"),
            F.max(t).alias("maximum_c"),
            of((t < low) | (t > high)).alias("implausible"),
            F.max("height").alias("height"),
            F.max("width").alias("width"),
            F.coalesce(F.min_by(F.when(valid, n), t), F.lit(0).cast("bigint")).alias("at_min"),
            F.coalesce(F.max_by(F.when(valid, n), t), F.lit(0).cast("bigint")).alias("at_max"),
        )
    )


def quality_gate(
    metrics: DataFrame,
    frames: DataFrame,
    emissivity: float | None = 0.95,
    minimum_fraction: float = fv.MINIMUM_VALID_FRACTION,
) -> DataFrame:
    """A4: status, reasons and warnings. ``emissivity`` None means no calibration was supplied."""
    m = metrics.drop("height", "width").join(frames, "frame_id")
    tags = upper_tags(F.col("tags"))
    declared = F.lower(F.trim(F.coalesce(F.try_element_at(tags, F.lit("ISCALIBRATED")), F.lit(""))))
    display_only = F.col("radiometric_candidate") == F.lit(False) if "radiometric_candidate" in m.columns else F.lit(False)
    none = F.col("valid_pixels") == 0
    coverage = F.concat(
        F.lit("valid temperature coverage "),
        _percent(F.col("valid_fraction")),
        F.lit(f" is below required {minimum_fraction:.0%}"),
    )
    reasons = present(
        (none, fv.Q_NO_SAMPLES),
        (~none & (F.col("valid_fraction") < minimum_fraction), coverage),
        (declared == "false", fv.Q_UNCALIBRATED),
        (display_only, fv.Q_NON_RADIOMETRIC),
        (F.col("implausible") > 0, F.concat(F.col("implausible").cast("string"), F.lit(" " + fv.Q_IMPLAUSIBLE))),
    )
    no_place = flag(F.col("crs").isNull() | (F.col("crs") == "") | F.col("transform").isNull())
    no_time = flag(F.col("capture_time").isNull() | (F.col("capture_time") == ""))
    warnings = present(
        (~none & (F.col("extreme_fraction") > 0.20), fv.Q_CLIPPED),
        (~none & (F.col("dynamic_range_c") < 0.05), fv.Q_FLAT),
        (F.lit(emissivity is None), fv.Q_NO_CALIBRATION),
        (F.lit(emissivity == 0.95), fv.Q_DEFAULT_EMISSIVITY),
        (no_place, fv.Q_NOT_GEOREFERENCED),
        (no_time, fv.Q_NO_TIMESTAMP),
    )
    out = m.withColumns({"reasons": reasons, "warnings": warnings})
    status = (
        F.when(F.size("reasons") > 0, "rejected")
        .when(F.size("warnings") > 0, "pass_with_warnings")
        .otherwise("pass")
    )
    return out.select(
        "frame_id",
        status.alias("status"),
        "reasons",
        "warnings",
        "width",
        "height",
        "total_pixels",
        "valid_pixels",
        F.bround("valid_fraction", 6).alias("valid_fraction"),
        "minimum_c",
        "maximum_c",
        "dynamic_range_c",
        F.bround("extreme_fraction", 6).alias("extreme_value_fraction"),
    )


def tiled_quality_gate(stats: DataFrame, frames: DataFrame, emissivity: float = 0.95) -> DataFrame:
    """The oversized-raster variant: coverage alone rejects, and statistics marked as sampled warn."""
    total = F.col("width").cast("long") * F.col("height")
    s = stats.join(frames, "frame_id").withColumn("valid_fraction", F.col("valid_pixels") / total)
    time_keys = ["CAPTURE_TIME", "TIMESTAMP", "DATETIME", "DATETIMEORIGINAL"]  # fixed values
    has_time = F.arrays_overlap(F.map_keys(upper_tags(F.col("tags"))), F.array(*[F.lit(k) for k in time_keys]))
    reasons = present(
        (
            F.col("valid_fraction") < fv.MINIMUM_VALID_FRACTION,
            F.concat(F.lit("valid temperature coverage "), _percent(F.col("valid_fraction")), F.lit(" is below required 70%")),
        )
    )
    warnings = present(
        (F.lit(emissivity == 0.95), fv.Q_DEFAULT_EMISSIVITY),
        (flag(F.col("crs").isNull() | (F.col("crs") == "")), fv.Q_NOT_GEOREFERENCED),
        (~flag(has_time), fv.Q_NO_TIMESTAMP),
        (F.col("percentiles_sampled"), fv.Q_SAMPLED),
    )
    out = s.withColumns({"reasons": reasons, "warnings": warnings})
    return out.select(
        "frame_id",
        F.when(F.size("reasons") > 0, "rejected").otherwise("pass_with_warnings").alias("status"),
        "reasons",
        "warnings",
        F.bround("valid_fraction", 6).alias("valid_fraction"),
    )
