"""Facade: one call from raw counts and frame metadata to canonical findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.functions.geo import georeference
from emberfield.operators import registers
from emberfield.operators.blocks import block_pixels, block_table, extents, metrics_of, scene_of, sheet_sketch, statistics_of
from emberfield.operators.detection import detect
from emberfield.operators.evidence import DetectionSettings
from emberfield.operators.matching import assign_clusters, canonical_findings
from emberfield.operators.mosaic import stitch_or_keep
from emberfield.operators.quality import quality_gate
from emberfield.operators.radiometry import frame_encodings, normalise
from emberfield.operators.regions import GROUP
from emberfield.operators.sheets import KEYS, frame_sheets
from emberfield.operators.tiling import detect_tiled
from emberfield.session import cut_lineage


@dataclass(frozen=True)
class Inspection:
    quality: DataFrame
    failures: DataFrame
    statistics: DataFrame
    observations: DataFrame
    suppressions: DataFrame
    assigned: DataFrame
    canonical: DataFrame
    summary: DataFrame
    warnings: list[str]


def gather_failures(encodings: DataFrame, quality: DataFrame) -> DataFrame:
    """L3: one row per rejected source with the first thing that went wrong."""
    gate = quality.where("status = 'rejected'").select(
        "frame_id",
        F.lit("RadiometricRejection").alias("error_type"),
        F.concat(F.lit("Radiometric quality gate rejected source: "), F.concat_ws("; ", "reasons")).alias("error"),
    )
    unit = encodings.where("error IS NOT NULL").select("frame_id", F.lit("ValueError").alias("error_type"), "error")
    return unit.unionByName(gate.join(unit, "frame_id", "left_anti"))


def run_inspection(
    raw: DataFrame,
    frames: DataFrame,
    profile_id: str = "generic-thermal",
    project: dict[str, str] | None = None,
    emissivity: float = 0.95,
    mosaic: str = "off",
    tiles: bool = False,
) -> Inspection:
    """Normalise, gate, detect, georeference, stamp, deduplicate and summarise one mission.

    ``mosaic``: off, on or auto. When a mosaic is built, only the mosaic is analysed. Frames of any size take the
    same whole-frame route; ``tiles`` asks for tile-scope detection instead, with statistics per tile.
    """
    project = project or {}
    settings = DetectionSettings.from_profile(profile_id)
    frames = cut_lineage(frames)  # a row per source, met by six joins below
    encodings = cut_lineage(frame_encodings(raw, frames))
    pixels = normalise(raw, encodings)
    pixels, stitched, warnings = stitch_or_keep(pixels, frames, encodings, mosaic) if mosaic != "off" else (pixels, False, [])
    if stitched:
        frames = mosaic_frame(frames)
    blocks = cut_lineage(block_table(frame_sheets(pixels), settings.block))
    edge, area = extents(blocks)
    sketch = cut_lineage(sheet_sketch(blocks, settings.giant_sheet, area))
    quality = cut_lineage(quality_gate(metrics_of(sketch), frames, emissivity))
    accepted = quality.where("status <> 'rejected'").select("frame_id")
    good, good_sketch = (df.join(accepted, "frame_id", "left_semi") for df in (blocks, sketch))
    if tiles:
        findings, suppressions, _ = detect_tiled(block_pixels(good, settings.block), frames, settings)
    else:
        d = detect(None, settings, stitch=edge > GROUP, blocks=good, scene=scene_of(good_sketch))
        findings, suppressions = d.findings, d.suppressions
    failures = gather_failures(encodings, quality)
    stamped = registers.stamp_provenance(georeference(findings, frames), frames, quality, project)
    observations = cut_lineage(registers.observation_ids(stamped, frames))
    assigned = cut_lineage(assign_clusters(observations))
    canonical = cut_lineage(canonical_findings(assigned))
    return Inspection(
        quality,
        failures,
        statistics_of(good_sketch),
        observations,
        suppressions,
        assigned,
        canonical,
        registers.inspection_summary(quality, observations, canonical, frames, failures),
        warnings,
    )


def mosaic_frame(frames: DataFrame) -> DataFrame:
    """Metadata row of the mosaic that replaces its source frames."""
    from emberfield.operators.mosaic import mosaic_grid

    g = mosaic_grid(frames)
    first = frames.agg(F.min("crs").alias("crs"), F.min("capture_time").alias("capture_time")).first()
    spark = frames.sparkSession
    row = {
        "frame_id": 0,
        "source_path": "mosaic/thermal_mosaic",
        "width": g["width"],
        "height": g["height"],
        "band_count": 1,
        "dtype": "float32",
        "crs": first["crs"],
        "transform": [g["rx"], 0.0, g["left"], 0.0, -g["ry"], g["top"]],
        "tags": {"THERMAL_UNIT": "celsius", "isCalibrated": "true"},
        "capture_time": first["capture_time"],
        "dataset_scale": None,
        "dataset_offset": None,
        "input_order": 0,
    }
    return spark.createDataFrame([row], frames.select(*row).schema)


__all__ = ["Inspection", "run_inspection", "gather_failures", "mosaic_frame", "KEYS"]
