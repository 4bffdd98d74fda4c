"""Region characterisation, suppression cascade and ranked findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.functions.columns import confidence, fixed, severity
from emberfield.operators.blocks import block_pixels, block_table, extents, ring_reference, scene_of, sheet_sketch
from emberfield.operators.evidence import DetectionSettings, evidence_layers
from emberfield.operators.ordering import CHAIN_SPAN, rank_in_groups
from emberfield.operators.regions import GROUP, label_regions, pixel_runs
from emberfield.operators.sheets import KEYS
from emberfield.operators.stencil import halo_tasks
from emberfield.session import cut_lineage


@dataclass(frozen=True)
class Detection:
    scene: DataFrame
    evidence: DataFrame
    components: DataFrame
    findings: DataFrame
    suppressions: DataFrame


def _run_aggregates() -> list:
    hottest = F.max(F.struct("temp_c", (-F.col("col_idx")).alias("neg_col")))
    return [
        F.count("*").alias("area"),
        F.sum(F.col("col_idx").cast("long")).alias("sum_col"),
        F.sum("temp_c").alias("sum_temp"),
        F.min("temp_c").alias("min_temp"),
        F.max("temp_c").alias("max_temp"),
        (-hottest["neg_col"]).alias("hot_col"),
        F.max("scale_support").alias("support"),
        F.max("robust_scene_deviation").alias("robust"),
        F.max("scene_median_c").alias("scene_median_c"),
    ]


def component_measures(labelled_runs: DataFrame, edge_margin: int, keys: list[str] = KEYS) -> DataFrame:
    """C2 from run partials: map-side combinable, so a region spanning many runs is no hot group."""
    hottest = F.max(F.struct("max_temp", (-F.col("row_idx")).alias("neg_row"), (-F.col("hot_col")).alias("neg_col")))
    measured = labelled_runs.groupBy(*keys, "label").agg(
        F.sum("area").alias("area_px"),
        F.min("row_idx").alias("bbox_top"),
        F.max("row_idx").alias("bbox_bottom"),
        F.min("c0").alias("bbox_left"),
        F.max("c1").alias("bbox_right"),
        (F.sum("sum_col") / F.sum("area")).alias("mean_col"),
        (F.sum(F.col("row_idx").cast("long") * F.col("area")) / F.sum("area")).alias("mean_row"),
        (F.sum("sum_temp") / F.sum("area")).alias("mean_temperature_c"),
        F.min("min_temp").alias("min_temperature_c"),
        hottest.alias("hot"),
        F.max("support").alias("component_support"),
        F.max("robust").alias("component_robust"),
        F.max("scene_median_c").alias("scene_median_c"),
        F.max("height").alias("height"),
        F.max("width").alias("width"),
    )
    top, bottom, left, right = (F.col(f"bbox_{side}") for side in ("top", "bottom", "left", "right"))
    return measured.withColumns(
        {
            "center_x": F.rint("mean_col").cast("int"),
            "center_y": F.rint("mean_row").cast("int"),
            "max_temperature_c": F.col("hot.max_temp"),
            "hotspot_y": -F.col("hot.neg_row"),
            "hotspot_x": -F.col("hot.neg_col"),
            "width_px": right - left + 1,
            "height_px": bottom - top + 1,
            "touches_edge": (top <= edge_margin)
            | (left <= edge_margin)
            | (bottom >= F.col("height") - 1 - edge_margin)
            | (right >= F.col("width") - 1 - edge_margin),
        }
    ).withColumn(
        "fill_ratio", F.col("area_px") / (F.col("width_px").cast("long") * F.col("height_px"))
    ).drop("hot", "mean_col", "mean_row")


def classify_components(components: DataFrame, blocks: DataFrame, s: DetectionSettings) -> DataFrame:
    """C3+C4: reference, ΔT and the first matching suppression reason (NULL = accepted). ``components`` is a written table."""
    small = F.col("area_px") < s.minimum_area_px
    sparse = F.col("fill_ratio") < s.minimum_fill_ratio
    ring = ring_reference(components.where(~small & ~sparse), blocks, max(s.radii), s.block, s.giant_sheet)
    out = components.join(ring, [*KEYS, "label"], "left")
    out = out.withColumn("reference_sample_count", F.coalesce("ring_count", F.lit(0)))
    enough = F.col("reference_sample_count") >= fv.MINIMUM_REFERENCE_SAMPLES
    out = out.withColumns(
        {
            "reference_temperature_c": F.when(enough, F.col("ring_median")).otherwise(F.col("scene_median_c")),
            "reference_method": F.when(enough, "surrounding-ring-median").otherwise("scene-median-fallback"),
        }
    ).withColumn("delta_temperature_c", F.col("max_temperature_c") - F.col("reference_temperature_c"))
    weak = F.col("delta_temperature_c") < s.minimum_delta_c
    edge = F.lit(s.edge_suppression) & F.col("touches_edge") & (F.col("delta_temperature_c") < s.minimum_delta_c * 2.0)
    reason = (
        F.when(small & (F.col("area_px") == 1), "SINGLE_PIXEL_SPIKE")
        .when(small, "MINIMUM_REGION_SUPPORT")
        .when(sparse, "LOW_SPATIAL_COHERENCE")
        .when(weak, "WEAK_LOCAL_CONTRAST")
        .when(edge, "EDGE_ARTIFACT")
    )
    return out.withColumn("reason", reason).drop("ring_median", "ring_count", "scene_median_c")


def assemble_findings(classified: DataFrame, s: DetectionSettings) -> DataFrame:
    """Severity, confidence, evidence texts and morphology of the accepted regions."""
    c = classified.where("reason IS NULL")
    scales = len(s.radii)
    level, parts = confidence(
        F.col("delta_temperature_c"),
        F.col("area_px"),
        F.col("component_support"),
        scales,
        F.col("fill_ratio"),
        F.col("component_robust"),
        F.col("touches_edge"),
        s.minimum_delta_c,
        s.minimum_area_px,
    )
    delta_text = fixed(F.col("delta_temperature_c"), 1)
    strong = F.when(F.col("component_robust") >= s.robust_z_threshold, F.lit("strong robust scene deviation"))
    evidence = F.array_compact(
        F.array(
            F.concat(F.lit("local reference established by "), F.col("reference_method")),
            F.concat(F.lit("maximum local ΔT "), delta_text, F.lit(" °C")),
            F.format_string("spatially coherent connected region (%d pixels)", F.col("area_px")),
            F.format_string(f"supported at %d/{scales} analysis scales", F.col("component_support")),
            strong,
        )
    )
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    polygon = F.array(
        corner("bbox_left", "bbox_top"),
        corner("bbox_right", "bbox_top"),
        corner("bbox_right", "bbox_bottom"),
        corner("bbox_left", "bbox_bottom"),
    )
    morphology = F.struct(
        "width_px",
        "height_px",
        F.bround("fill_ratio", 4).alias("fill_ratio"),
        "touches_edge",
        F.col("component_support").alias("scale_support"),
        "reference_sample_count",
    )
    return c.select(
        *KEYS,
        "label",
        "center_x",
        "center_y",
        "hotspot_x",
        "hotspot_y",
        "bbox_left",
        "bbox_top",
        "bbox_right",
        "bbox_bottom",
        "area_px",
        "min_temperature_c",
        "mean_temperature_c",
        "max_temperature_c",
        "reference_temperature_c",
        F.col("reference_temperature_c").alias("baseline_temperature_c"),
        "reference_method",
        "delta_temperature_c",
        severity(F.col("delta_temperature_c"), s.moderate_delta_c, s.critical_delta_c).alias("severity"),
        level.alias("confidence"),
        parts.alias("confidence_components"),
        F.lit(s.label).alias("finding_type"),
        F.lit(s.label).alias("classification"),
        F.lit("Contextual thermal contrast with coherent spatial support.").alias("classification_rationale"),
        F.concat(F.lit("Local ΔT "), delta_text, F.lit(" °C classified by the active inspection profile.")).alias(
            "severity_rationale"
        ),
        polygon.alias("polygon"),
        morphology.alias("morphology"),
        evidence.alias("evidence"),
        F.array(*[F.lit(t) for t in ("minimum_area", "local_contrast", "spatial_coherence", "edge_check")]).alias(
            "suppression_checks"
        ),
        F.lit(s.profile_id).alias("profile_id"),
        F.lit(s.profile_version).alias("profile_version"),
        F.lit("new").alias("lifecycle_status"),
    )


def rank_findings(findings: DataFrame, keys: list[str] = ["frame_id"], rows: int | None = None) -> DataFrame:
    """ΔT descending, ties in discovery order (sheet, then label) → ``A-001`` per frame.

    A mosaic is one frame for a whole mission, so beyond a span of ``rows`` the findings of a frame are ranked by spans of ΔT and
    label and counts of earlier spans, not in one window. ``rows`` unknown takes that route too.
    """
    delta = -F.col("delta_temperature_c")
    levels = [[F.floor(delta * 16)], [delta, F.col("tile_id"), F.floor(F.col("label") / CHAIN_SPAN)]]
    order = [F.desc("delta_temperature_c"), F.col("tile_id"), F.col("label")]
    return rank_in_groups(findings, keys, levels, order, "rank", rows).withColumn(
        "finding_id", F.format_string("A-%03d", F.col("rank"))
    ).withColumn("canonical_finding_id", F.col("finding_id"))


def suppression_records(classified: DataFrame) -> DataFrame:
    """Rejected regions with their reason and, where the cascade records one, the measured value."""
    delta = F.bround("delta_temperature_c", 3).cast("string")
    details = (
        F.when(
            F.col("reason") == "LOW_SPATIAL_COHERENCE",
            F.create_map(F.lit("fill_ratio"), F.bround("fill_ratio", 4).cast("string")),
        )
        .when(
            F.col("reason") == "WEAK_LOCAL_CONTRAST",
            F.create_map(F.lit("delta_c"), delta, F.lit("reference_method"), F.col("reference_method")),
        )
        .when(F.col("reason") == "EDGE_ARTIFACT", F.create_map(F.lit("delta_c"), delta))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return classified.where("reason IS NOT NULL").select(
        *KEYS, "label", "reason", "area_px", "center_x", "center_y", details.alias("details")
    )


def detect(
    sheets: DataFrame | None,
    settings: DetectionSettings = DetectionSettings(),
    experimental: bool = False,
    group: int = GROUP,
    stitch: bool | None = None,
    blocks: DataFrame | None = None,
    scene: DataFrame | None = None,
) -> Detection:
    """Scene → evidence → regions → cascade → findings.

    The sheets' pixels are read once, into a table of blocks; a caller that has one written already gives ``blocks`` (of
    ``settings.block``) instead, and their ``scene`` where it is known. Scene, stencils and ring references start from the blocks. The
    pixel-heavy half runs once and is kept as the component table, a tiny fraction of the pixels.
    """
    s = settings
    blocks = cut_lineage(block_table(sheets, s.block)) if blocks is None else blocks
    if scene is None or stitch is None:
        edge, area = extents(blocks)
        stitch = edge > group if stitch is None else stitch
        scene = scene_of(sheet_sketch(blocks, s.giant_sheet, area)) if scene is None else scene
    tasks = halo_tasks(blocks, max(*s.radii, s.inner_radius, 1), s.block, F.col("n_cells"))
    evidence = evidence_layers(block_pixels(blocks, s.block), s, scene, experimental, tasks)
    runs = pixel_runs(evidence.where("candidate_mask"), _run_aggregates(), group=group)
    labelled = label_regions(runs, s.connectivity, group=group, stitch=stitch)
    components = cut_lineage(component_measures(labelled, s.edge_margin_px))
    classified = cut_lineage(classify_components(components, blocks, s))
    findings = rank_findings(assemble_findings(classified, s), rows=classified.count())
    return Detection(scene, evidence, classified, findings, suppression_records(classified))


def diagnostics(d: Detection) -> DataFrame:
    """Per-frame run figures. Candidate pixels are the summed region areas, so no pixel is read again."""
    per_sheet = d.components.groupBy(*KEYS).agg(
        F.sum("area_px").alias("candidate_pixels"),
        F.count_if(F.expr("reason IS NULL")).alias("accepted_findings"),
        F.count_if(F.expr("reason IS NOT NULL")).alias("suppressed_candidates"),
    )
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    return d.scene.join(per_sheet, KEYS, "left").select(
        *KEYS,
        "valid_pixels",
        F.bround("scene_median_c", 4).alias("scene_median_c"),
        F.bround("scene_scale_c", 4).alias("scene_robust_scale_c"),
        F.bround("scene_p90_c", 4).alias("scene_p90_c"),
        zero("candidate_pixels"),
        zero("accepted_findings"),
        zero("suppressed_candidates"),
    )
