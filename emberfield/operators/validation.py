"""Mask metrics, residual ablation and synthetic validation frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.operators.statistics import binned_quantiles, giant_route, summarize


def mask_metrics(masks: DataFrame, keys: list[str], predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """A11 over boolean columns; every pixel of the frame must be present."""
    p, t = F.col(predicted), F.col(truth)
    counts = masks.groupBy(*keys).agg(
        F.count_if(p & t).alias("true_positive_px"),
        F.count_if(p & ~t).alias("false_positive_px"),
        F.count_if(~p & t).alias("false_negative_px"),
    )
    tp, fp, fn = (F.col(f"{n}_px") for n in ("true_positive", "false_positive", "false_negative"))
    return counts.withColumns(
        {
            "precision": F.when(tp + fp > 0, tp / (tp + fp)).when(tp + fn == 0, 1.0).otherwise(0.0),
            "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0),
            "iou": F.when(tp + fp + fn > 0, tp / (tp + fp + fn)).otherwise(1.0),
        }
    )


def delta_error(pixels: DataFrame, findings: DataFrame, truth: str = "truth") -> DataFrame:
    """|estimated ΔT − expected ΔT| per frame; NULL without truth or without a finding."""
    t = F.col(truth)
    top = pixels.groupBy("frame_id").agg(F.max(F.when(t, F.col("temp_c"))).alias("top_c"))
    others = summarize(pixels.where(~t), ["frame_id"], giant=giant_route(pixels)).select("frame_id", "median_c")
    expected = top.join(others, "frame_id", "left").select("frame_id", (F.col("top_c") - F.col("median_c")).alias("expected_delta_c"))
    estimated = findings.groupBy("frame_id").agg(F.max("delta_temperature_c").alias("estimated_delta_c"))
    return expected.join(estimated, "frame_id", "left").withColumn(
        "delta_t_error_c", F.abs(F.col("estimated_delta_c") - F.col("expected_delta_c"))
    )


def residual_ablation(
    evidence: DataFrame, quantile: float = 0.5, truth: str = "truth", giant: Column | None = None
) -> DataFrame:
    """Per frame, metrics of the candidates and of the candidates gated by their residual quantile.

    ``giant`` marks frames whose quantile takes the binned route; by default those of very many pixels.
    """
    if giant is None:
        giant = giant_route(evidence)
    if not 0.0 <= quantile <= 1.0:
        raise ValueError("quantile must be between 0 and 1")
    residual = F.abs("structural_residual_c")
    candidates = evidence.where("candidate_mask").withColumn("residual", residual)
    small = candidates if giant is None else candidates.where(~giant)
    thresholds = small.groupBy("frame_id").agg(F.percentile("residual", F.lit(quantile)).alias("residual_threshold_c"))
    if giant is not None:
        binned = binned_quantiles(candidates.where(giant), ["frame_id"], "residual", [quantile])
        thresholds = thresholds.unionByName(binned.select("frame_id", F.col("q")[0].alias("residual_threshold_c")))
    gated = evidence.join(thresholds, "frame_id", "left").withColumn(
        "residual_threshold_c", F.coalesce("residual_threshold_c", F.lit(float("inf")))
    )
    gated = gated.withColumn(
        "gated", F.col("candidate_mask") & F.coalesce(residual >= F.col("residual_threshold_c"), F.lit(False))
    )
    variants = F.array(
        F.struct(F.lit("baseline").alias("variant"), F.col("candidate_mask").alias("predicted")),
        F.struct(F.lit("residual_gated").alias("variant"), F.col("gated").alias("predicted")),
    )
    long = gated.select("frame_id", "residual_threshold_c", F.col(truth).alias("truth"), F.explode(variants).alias("v"))
    long = long.select("frame_id", "residual_threshold_c", "truth", "v.variant", "v.predicted")
    return mask_metrics(long, ["frame_id", "variant", "residual_threshold_c"])


# The nine synthetic validation frames: side, base, and boxes
# (row_start, row_stop, col_start, col_stop, value, mode, is_truth); mode set | add | nodata.
SYNTHETIC_FRAMES = [
    ("uniform_hotspot", 48, 25.0, [(18, 28, 19, 29, 45.0, "set", True)]),
    ("gradient_hotspot", 64, None, [(24, 34, 28, 38, 16.0, "add", True)]),
    ("globally_warm_scene", 48, 55.0, [(16, 26, 16, 26, 68.0, "set", True)]),
    ("single_pixel_spike", 32, 25.0, [(15, 16, 15, 16, 90.0, "set", False)]),
    ("edge_artifact", 40, 25.0, [(0, 2, 8, 28, 36.0, "set", False)]),
    ("nodata_boundary", 48, 25.0, [(0, 6, 0, 48, None, "nodata", False), (20, 30, 20, 30, 45.0, "set", True)]),
    ("two_anomalies", 64, 24.0, [(10, 18, 12, 20, 43.0, "set", True), (40, 50, 42, 54, 50.0, "set", True)]),
    ("weak_anomaly", 48, 25.0, [(18, 28, 18, 28, 29.0, "set", False)]),
    ("broad_warm_component", 80, 25.0, [(20, 55, 22, 58, 42.0, "set", True)]),
]
GRADIENT_LOW, GRADIENT_HIGH = 20.0, 38.0  # fixed values: the gradient frame's left and right columns


def _in_box(box: tuple) -> Column:
    return F.col("row_idx").between(box[0], box[1] - 1) & F.col("col_idx").between(box[2], box[3] - 1)


def synthetic_frames(spark: SparkSession) -> DataFrame:
    """G1: pixels with truth, one frame per named case, generated by ``spark.range``."""
    frames = None
    for number, (name, side, base, boxes) in enumerate(SYNTHETIC_FRAMES):
        grid = spark.range(side * side).select(
            F.lit(number).cast("long").alias("frame_id"),
            F.lit(name).alias("name"),
            F.floor(F.col("id") / side).cast("int").alias("row_idx"),
            (F.col("id") % side).cast("int").alias("col_idx"),
            F.lit(side).alias("height"),
            F.lit(side).alias("width"),
        )
        slope = (GRADIENT_HIGH - GRADIENT_LOW) / (side - 1)
        value = F.lit(base) if base is not None else F.lit(GRADIENT_LOW) + F.col("col_idx") * slope
        truth = F.lit(False)
        for box in boxes:
            change = {"set": F.lit(box[4]), "add": value + F.lit(box[4] or 0.0), "nodata": F.lit(None)}[box[5]]
            value = F.when(_in_box(box), change).otherwise(value)
            truth = truth | (_in_box(box) if box[6] else F.lit(False))
        frame = grid.withColumns({"temp_c": value.cast("double"), "truth": truth})
        frames = frame if frames is None else frames.unionByName(frame)
    return frames


# The 2×2 solar mission of 48 px tiles: (tile_row, tile_col, box, change).
MISSION_TILE, MISSION_PIXEL_M, MISSION_ORIGIN = 48, 0.5, (500_000.0, 3_100_000.0)
MISSION_BOXES = [
    (0, 0, (16, 26, 16, 26), 8.0),
    (0, 1, (14, 24, 16, 26), 14.0),
    (1, 0, (16, 26, 18, 28), 26.0),
    (1, 1, (12, 22, 12, 22), 3.5),
    (1, 1, (35, 36, 35, 36), 30.0),
    (1, 1, (2, 4, 2, 4), None),
]


def solar_mission(spark: SparkSession, noise: float = 0.025) -> DataFrame:
    """Four tiles with seeded findings and deliberate non-findings.

    The noise is a hash of the pixel position (sum of four uniform terms), so it is reproducible on
    any number of executors.
    """
    n = MISSION_TILE
    grid = spark.range(4 * n * n).select(
        F.floor(F.col("id") / (n * n)).cast("long").alias("frame_id"),
        F.floor((F.col("id") % (n * n)) / n).cast("int").alias("row_idx"),
        (F.col("id") % n).cast("int").alias("col_idx"),
        F.lit(n).alias("height"),
        F.lit(n).alias("width"),
    )
    wave = sum(
        ((F.pmod(F.hash("frame_id", "row_idx", "col_idx", F.lit(k)), F.lit(1000)) / 999.0 - 0.5) for k in range(4)),
        start=F.lit(0.0),
    )
    value = 33.0 + 0.25 * (F.col("col_idx") / (n - 1)) + 0.15 * (F.col("row_idx") / (n - 1)) + wave * noise * 1.7
    for tile_r, tile_c, box, change in MISSION_BOXES:
        here = (F.col("frame_id") == tile_r * 2 + tile_c) & _in_box(box)
        value = F.when(here, F.lit(None) if change is None else value + change).otherwise(value)
    return grid.withColumn("temp_c", value.cast("double"))
