"""Multi-scale thermal evidence per pixel and the candidate gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.functions.columns import flag, greatest_of
from emberfield.operators.sheets import BLOCK, BLOCK_KEYS, KEYS, box_blocks, over_blocks, with_blocks
from emberfield.operators.statistics import GIANT_GROUP, scene_statistics
from emberfield.operators.stencil import annular_reference, box_mean, box_sums, texture_curvature


@dataclass(frozen=True)
class DetectionSettings:
    """Thresholds of one detector run; ``from_profile`` reads them from the profile catalogue."""

    profile_id: str = "generic-thermal"
    profile_version: str = "1.0"
    label: str = "Thermal anomaly"
    minimum_delta_c: float = 8.0
    minimum_area_px: int = 25
    moderate_delta_c: float = 15.0
    critical_delta_c: float = 30.0
    absolute_threshold_c: float | None = None
    radii: tuple[int, ...] = fv.LOCAL_RADII
    inner_radius: int = fv.INNER_RADIUS
    minimum_scale_support: int = fv.MINIMUM_SCALE_SUPPORT
    robust_z_threshold: float = fv.ROBUST_Z_THRESHOLD
    edge_suppression: bool = True
    edge_margin_px: int = fv.EDGE_MARGIN_PX
    minimum_fill_ratio: float = fv.MINIMUM_FILL_RATIO
    connectivity: int = 8
    block: int = BLOCK
    giant_sheet: int = GIANT_GROUP

    def __post_init__(self) -> None:
        if self.minimum_area_px <= 0 or self.minimum_delta_c <= 0:
            raise ValueError("minimum_area_px and minimum_delta_c must be positive")
        if not self.radii:
            raise ValueError("radii must not be empty")
        if self.connectivity not in (4, 8):
            raise ValueError("connectivity must be 4 or 8")

    @classmethod
    def from_profile(cls, profile_id: str | None = None, **overrides) -> DetectionSettings:
        key = (profile_id or "generic-thermal").strip().lower()
        for row in fv.PROFILE_ROWS:
            if row[0] == key:
                pid, _, version, delta, area, moderate, critical, label = row
                picked = dict(
                    profile_id=pid, profile_version=version, label=label, minimum_delta_c=delta,
                    minimum_area_px=area, moderate_delta_c=moderate, critical_delta_c=critical,
                )
                return cls(**{**picked, **overrides})
        raise KeyError(f"unknown inspection profile: {profile_id!r}")


def local_contrast(boxed: DataFrame, radii: tuple[int, ...], inner: int, minimum_delta: float) -> DataFrame:
    """N3–N6 from box sums: reference and ΔT per radius, peak, best reference, scale support."""
    refs = {f"ref{q}": annular_reference(inner, q) for q in radii}
    deltas = {f"d{q}": F.col("temp_c") - F.col(f"ref{q}") for q in radii}
    out = boxed.withColumns(refs).withColumns(deltas)
    out = out.withColumn("local_delta_c", greatest_of([F.col(f"d{q}") for q in radii]))
    best = F.coalesce(*[F.when(F.col(f"d{q}") == F.col("local_delta_c"), F.col(f"ref{q}")) for q in radii])
    support = sum(
        (flag(F.col(f"d{q}") >= minimum_delta * 0.75).cast("int") for q in radii), start=F.lit(0)
    )
    return out.withColumns({"local_reference_c": best, "scale_support": support})


def candidate_gate(s: DetectionSettings) -> Column:
    """N9 over ``local_delta_c``, ``scale_support``, ``robust_scene_deviation`` and the scene p90."""
    gate = (
        (F.col("local_delta_c") >= s.minimum_delta_c)
        & (F.col("scale_support") >= s.minimum_scale_support)
        & (
            (F.col("robust_scene_deviation") >= 1.0)
            | (F.col("temp_c") >= F.col("scene_p90_c"))
            | (F.col("local_delta_c") >= s.minimum_delta_c * 1.5)
        )
    )
    if s.absolute_threshold_c is not None:
        gate = gate & (F.col("temp_c") >= s.absolute_threshold_c)
    return flag(F.col("temp_c").isNotNull() & gate)


def evidence_layers(
    sheets: DataFrame,
    settings: DetectionSettings = DetectionSettings(),
    scene: DataFrame | None = None,
    experimental: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """N11 without the finding mask: one shuffle of the pixels, all radii in the same two windows."""
    s = settings
    radii = sorted({*s.radii, s.inner_radius})
    boxed = box_sums(sheets, radii, block=s.block, neighbours=experimental, tasks=tasks)
    scene = scene_statistics(sheets, s.giant_sheet) if scene is None else scene
    spread = over_blocks(scene.drop("valid_pixels", "scene_mad_c"), s.block).drop("height", "width")
    out = boxed.join(spread, BLOCK_KEYS, "left")
    out = local_contrast(out, s.radii, s.inner_radius, s.minimum_delta_c)
    out = out.withColumn("robust_scene_deviation", (F.col("temp_c") - F.col("scene_median_c")) / F.col("scene_scale_c"))
    out = out.withColumn("candidate_mask", candidate_gate(s))
    layers = ["local_reference_c", "local_delta_c", "robust_scene_deviation", "scale_support", "candidate_mask"]
    if experimental:
        out = out.withColumns(
            {
                "structural_residual_c": F.col("temp_c") - box_mean(max(s.radii)),
                "texture_curvature_c": texture_curvature(F.coalesce(F.col("scene_median_c"), F.lit(0.0))),
            }
        )
        layers += ["structural_residual_c", "texture_curvature_c"]
    return out.select(
        *BLOCK_KEYS, "row_idx", "col_idx", "temp_c", "height", "width", "scene_median_c", *layers
    )


def finding_mask(pixels: DataFrame, findings: DataFrame, block: int = BLOCK) -> DataFrame:
    """``finding_mask`` on pixels of global coordinates. A finding without bbox marks its centre.

    The boxes go to the blocks they touch; a block's boxes are one array, so one left join on
    (sheet, block) marks every pixel and the pixels' plan runs once.
    """
    located = pixels if "blk_r" in pixels.columns else with_blocks(pixels, block)
    box = findings.select(
        *KEYS,
        F.coalesce("bbox_left", "center_x").alias("m_left"),
        F.coalesce("bbox_top", "center_y").alias("m_top"),
        F.coalesce("bbox_right", "center_x").alias("m_right"),
        F.coalesce("bbox_bottom", "center_y").alias("m_bottom"),
    )
    zero = F.lit(0)
    box = box_blocks(
        box, F.greatest(F.col("m_left"), zero), F.greatest(F.col("m_top"), zero), F.col("m_right"), F.col("m_bottom"), block
    )
    # Regions of a sheet are apart, so a block's boxes are at most as many as its pixels.
    corners = F.struct("m_left", "m_top", "m_right", "m_bottom")
    per_block = box.groupBy(*BLOCK_KEYS).agg(F.collect_set(corners).alias("boxes"))
    covered = F.exists(
        "boxes",
        lambda b: F.col("col_idx").between(b["m_left"], b["m_right"]) & F.col("row_idx").between(b["m_top"], b["m_bottom"]),
    )
    joined = located.join(per_block, BLOCK_KEYS, "left")
    return joined.select(*located.columns, F.coalesce(covered, F.lit(False)).alias("finding_mask"))
