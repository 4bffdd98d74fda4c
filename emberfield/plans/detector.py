"""Queries over the pixel stream: statistics, stencils, regions, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.operators import detection, legacy, statistics, stencil, tiling, validation
from emberfield.operators.evidence import DetectionSettings, evidence_layers, finding_mask
from emberfield.operators.sheets import frame_sheets
from emberfield.plans.catalog import query, tidy
from emberfield.plans.sql import r, with_tables
from emberfield.sources import derived

GENERIC = DetectionSettings()


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    return frame_sheets(derived.pixels(spark, sf))


@query("pixel_scan", with_tables(["pixels"], f"SELECT frame_id, row_idx, col_idx, {r('temp_c', 'temp_c')} FROM pixels"))
def pixel_scan(spark, sf):
    return tidy(derived.pixels(spark, sf).drop("height", "width"))


@query(
    "frame_statistics",
    with_tables(
        ["pixels"],
        f"""SELECT frame_id, {r('min(temp_c)', 'minimum_c')}, {r('max(temp_c)', 'maximum_c')}, {r('avg(temp_c)', 'mean_c')},
        {r('median(temp_c)', 'median_c')}, {r('stddev_pop(temp_c)', 'stddev_c')}, {r('quantile_cont(temp_c, 0.95)', 'p95_c')},
        count(temp_c) AS valid_pixels FROM pixels GROUP BY frame_id""",
    ),
)
def frame_statistics(spark, sf):
    return tidy(statistics.frame_statistics(sheets(spark, sf)).drop("tile_id"))


@query(
    "streaming_raster_statistics",
    with_tables(
        ["pixels"],
        f"""SELECT frame_id, {r('min(temp_c)', 'minimum_c')}, {r('max(temp_c)', 'maximum_c')}, {r('avg(temp_c)', 'mean_c')},
        {r('median(temp_c)', 'median_c')}, {r('stddev_pop(temp_c)', 'stddev_c')}, {r('quantile_cont(temp_c, 0.95)', 'p95_c')},
        count(temp_c) AS valid_pixels, count(temp_c) AS sample_size, false AS percentiles_sampled FROM pixels WHERE temp_c IS NOT NULL GROUP BY frame_id""",
    ),
)
def streaming_raster_statistics(spark, sf):
    """The binned route on every frame."""
    return tidy(statistics.raster_statistics(derived.pixels(spark, sf), limit=100))


SCENE_SQL = f"""SELECT frame_id, valid_pixels, {r('med', 'scene_median_c')}, {r('mad', 'scene_mad_c')}, {r('scale', 'scene_scale_c')},
  {r('p90', 'scene_p90_c')} FROM scene"""


@query("scene_robust_statistics", with_tables(["scene"], SCENE_SQL))
def scene_robust_statistics(spark, sf):
    return tidy(statistics.scene_statistics(sheets(spark, sf)).drop("tile_id", "height", "width"))


@query("scene_robust_statistics_binned", with_tables(["scene"], SCENE_SQL))
def scene_robust_statistics_binned(spark, sf):
    """The route for giant sheets, forced onto every frame."""
    return tidy(statistics.scene_statistics(sheets(spark, sf), limit=100).drop("tile_id", "height", "width"))


@query(
    "inspection_statistics",
    with_tables(
        ["pixels"],
        f"""SELECT {r('min(mn)', 'minimum_c')}, {r('max(mx)', 'maximum_c')}, {r('sum(av * n) / sum(n)', 'weighted_mean_c')},
        {r('sum(md * n) / sum(n)', 'weighted_median_c')}, {r('sum(sd * n) / sum(n)', 'weighted_stddev_c')},
        {r('sum(p95 * n) / sum(n)', 'weighted_p95_c')}, CAST(sum(n) AS BIGINT) AS valid_pixels FROM
        (SELECT frame_id, min(temp_c) AS mn, max(temp_c) AS mx, avg(temp_c) AS av, median(temp_c) AS md, stddev_pop(temp_c) AS sd,
         quantile_cont(temp_c, 0.95) AS p95, count(temp_c) AS n FROM pixels GROUP BY frame_id) f""",
    ),
)
def inspection_statistics(spark, sf):
    return tidy(statistics.inspection_statistics(statistics.frame_statistics(sheets(spark, sf))))


@query(
    "fahrenheit_projection",
    with_tables(["pixels"], f"SELECT frame_id, row_idx, col_idx, {r('temp_c * 9 / 5 + 32', 'temp_f')} FROM pixels"),
)
def fahrenheit_projection(spark, sf):
    from emberfield.functions.columns import fahrenheit

    return tidy(derived.pixels(spark, sf).select("frame_id", "row_idx", "col_idx", fahrenheit(F.col("temp_c")).alias("temp_f")))


@query(
    "reflect_padding",
    with_tables(
        ["box"],
        f"SELECT frame_id, r AS p_row, c AS p_col, {r('temp_c', 'temp_c')} FROM padded",
    ),
)
def reflect_padding(spark, sf):
    halo = stencil.with_halo(sheets(spark, sf), 7)
    return tidy(halo.select("frame_id", "p_row", "p_col", "temp_c"))


@query(
    "box_sums",
    with_tables(
        ["box"],
        f"SELECT frame_id, row_idx, col_idx, {r('s1', 's1', 9)}, n1, {r('s3', 's3', 9)}, n3, {r('s7', 's7', 9)}, n7 FROM box",
    ),
)
def box_sums(spark, sf):
    return tidy(stencil.box_sums(sheets(spark, sf), [1, 3, 7]).drop("tile_id", "blk_r", "blk_c", "temp_c", "height", "width"), 9)


@query(
    "box_sums_small_blocks",
    with_tables(["box"], f"SELECT frame_id, row_idx, col_idx, {r('s3', 's3', 9)}, n3 FROM box"),
)
def box_sums_small_blocks(spark, sf):
    """Blocks of 8 pixels: every value crosses block halos."""
    out = stencil.box_sums(sheets(spark, sf), [3], block=8)
    return tidy(out.drop("tile_id", "blk_r", "blk_c", "temp_c", "height", "width"), 9)


@query(
    "annular_reference",
    with_tables(
        ["layers"],
        f"SELECT frame_id, row_idx, col_idx, {r('ref3', 'ref3')}, {r('ref7', 'ref7')} FROM layers",
    ),
)
def annular_reference(spark, sf):
    boxed = stencil.box_sums(sheets(spark, sf), [1, 3, 7])
    refs = {f"ref{q}": stencil.annular_reference(1, q) for q in (3, 7)}
    return tidy(boxed.withColumns(refs).select("frame_id", "row_idx", "col_idx", *refs))


LAYER_SQL = f"""SELECT l.frame_id, l.row_idx, l.col_idx, {r('l.temp_c', 'temperature_c')}, {r('best_ref', 'local_reference_c')},
  {r('peak', 'local_delta_c')}, {r('robust', 'robust_scene_deviation')}, support AS scale_support, candidate AS candidate_mask,
  {r('residual', 'structural_residual_c')}, {r('''abs(4 * l.temp_c
    - coalesce(CASE WHEN l.col_idx = 0 THEN l.temp_c ELSE lf.temp_c END, l.med) - coalesce(CASE WHEN l.col_idx = 24 THEN l.temp_c ELSE rt.temp_c END, l.med)
    - coalesce(CASE WHEN l.row_idx = 0 THEN l.temp_c ELSE up.temp_c END, l.med) - coalesce(CASE WHEN l.row_idx = 19 THEN l.temp_c ELSE dn.temp_c END, l.med))''', 'texture_curvature_c')}
  FROM layers l LEFT JOIN pixels lf ON lf.frame_id = l.frame_id AND lf.row_idx = l.row_idx AND lf.col_idx = l.col_idx - 1
  LEFT JOIN pixels rt ON rt.frame_id = l.frame_id AND rt.row_idx = l.row_idx AND rt.col_idx = l.col_idx + 1
  LEFT JOIN pixels up ON up.frame_id = l.frame_id AND up.row_idx = l.row_idx - 1 AND up.col_idx = l.col_idx
  LEFT JOIN pixels dn ON dn.frame_id = l.frame_id AND dn.row_idx = l.row_idx + 1 AND dn.col_idx = l.col_idx"""


@query("evidence_layers", with_tables(["layers"], LAYER_SQL))
def evidence(spark, sf):
    e = evidence_layers(sheets(spark, sf)).withColumnRenamed("temp_c", "temperature_c")
    return tidy(e.drop("tile_id", "blk_r", "blk_c", "height", "width", "scene_median_c"))


@query(
    "candidate_pixels",
    with_tables(["layers"], "SELECT frame_id, count(*) FILTER (candidate) AS candidates, count(*) AS pixels FROM layers GROUP BY frame_id"),
)
def candidate_pixels(spark, sf):
    e = evidence_layers(sheets(spark, sf), experimental=False)
    return tidy(e.groupBy("frame_id").agg(F.count_if("candidate_mask").alias("candidates"), F.count("*").alias("pixels")))


def run(spark: SparkSession, sf: str, profile: str = "generic-thermal") -> detection.Detection:
    return detection.detect(sheets(spark, sf), DetectionSettings.from_profile(profile))


@query(
    "connected_regions",
    with_tables(
        ["regions"],
        f"""SELECT frame_id, label, area AS area_px, lft AS bbox_left, top AS bbox_top, rgt AS bbox_right, bottom AS bbox_bottom,
        CAST(cx AS BIGINT) AS center_x, CAST(cy AS BIGINT) AS center_y, {r('fill', 'fill_ratio')}, hot % 25 AS hotspot_x, hot // 25 AS hotspot_y,
        {r('tmin', 'min_temperature_c')}, {r('tmean', 'mean_temperature_c')}, {r('tmax', 'max_temperature_c')}, edge AS touches_edge FROM judged""",
    ),
)
def connected_regions(spark, sf):
    c = run(spark, sf).components
    return tidy(
        c.select(
            "frame_id", "label", "area_px", "bbox_left", "bbox_top", "bbox_right", "bbox_bottom", "center_x", "center_y",
            "fill_ratio", "hotspot_x", "hotspot_y", "min_temperature_c", "mean_temperature_c", "max_temperature_c", "touches_edge",
        )
    )


@query(
    "region_reference",
    with_tables(
        ["regions"],
        f"""SELECT frame_id, label, {r('ref', 'reference_temperature_c')}, method AS reference_method, rn AS reference_sample_count
        FROM judged WHERE area >= 25 AND fill >= 0.2""",
    ),
)
def region_reference(spark, sf):
    c = run(spark, sf).components.where("area_px >= 25 AND fill_ratio >= 0.2")
    return tidy(c.select("frame_id", "label", "reference_temperature_c", "reference_method", "reference_sample_count"))


@query(
    "suppressed_candidates",
    with_tables(
        ["regions"],
        """SELECT frame_id, label, reason, area AS area_px, CAST(cx AS BIGINT) AS center_x, CAST(cy AS BIGINT) AS center_y
        FROM judged WHERE reason IS NOT NULL""",
    ),
)
def suppressed_candidates(spark, sf):
    return tidy(run(spark, sf).suppressions.drop("tile_id", "details"))


FINDING_SQL = f"""SELECT frame_id, finding_id, severity, confidence, {r('delta', 'delta_temperature_c')}, {r('tmax', 'max_temperature_c')},
  {r('tmean', 'mean_temperature_c')}, {r('ref', 'reference_temperature_c')}, area AS area_px, CAST(cx AS BIGINT) AS center_x,
  CAST(cy AS BIGINT) AS center_y, lft AS bbox_left, top AS bbox_top, rgt AS bbox_right, bottom AS bbox_bottom, round_even(score, 4) + 0.0 AS score FROM findings"""


def finding_rows(d: detection.Detection) -> DataFrame:
    return tidy(
        d.findings.select(
            "frame_id", "finding_id", "severity", "confidence", "delta_temperature_c", "max_temperature_c", "mean_temperature_c",
            "reference_temperature_c", "area_px", "center_x", "center_y", "bbox_left", "bbox_top", "bbox_right", "bbox_bottom",
            F.col("confidence_components.internal_score").alias("score"),
        )
    )


@query("finding_register", with_tables(["regions"], FINDING_SQL))
def finding_register(spark, sf):
    """Flagship: thermal findings of every frame with ΔT, severity and confidence."""
    return finding_rows(run(spark, sf))


@query("finding_register_photovoltaic", with_tables(["regions"], FINDING_SQL, "photovoltaic"))
def finding_register_photovoltaic(spark, sf):
    return finding_rows(run(spark, sf, "photovoltaic"))


@query("finding_register_small_blocks", with_tables(["regions"], FINDING_SQL))
def finding_register_small_blocks(spark, sf):
    """Frames cut into 16 px blocks and 8 px label groups: halos and border stitching at work."""
    s = DetectionSettings(block=16)
    return finding_rows(detection.detect(sheets(spark, sf), s, group=8))


@query(
    "finding_evidence_texts",
    with_tables(
        ["regions"],
        """SELECT frame_id, finding_id, 'local reference established by ' || method || '|' || 'maximum local ΔT ' || printf('%.1f', delta)
        || ' °C|' || 'spatially coherent connected region (' || area || ' pixels)|' || 'supported at ' || support || '/2 analysis scales'
        || CASE WHEN robust >= 3.5 THEN '|strong robust scene deviation' ELSE '' END AS evidence FROM findings""",
    ),
)
def finding_evidence_texts(spark, sf):
    return tidy(run(spark, sf).findings.select("frame_id", "finding_id", "evidence"))


@query(
    "detector_diagnostics",
    with_tables(
        ["regions"],
        f"""SELECT s.frame_id, any_value(valid_pixels) AS valid_pixels, {r('any_value(s.med)', 'scene_median_c')},
        {r('any_value(scale)', 'scene_robust_scale_c')}, {r('any_value(p90)', 'scene_p90_c')},
        CAST(coalesce(sum(area), 0) AS BIGINT) AS candidate_pixels, count(label) FILTER (reason IS NULL) AS accepted_findings,
        count(label) FILTER (reason IS NOT NULL) AS suppressed_candidates FROM scene s LEFT JOIN judged j USING (frame_id) GROUP BY s.frame_id""",
    ),
)
def detector_diagnostics(spark, sf):
    return tidy(detection.diagnostics(run(spark, sf)).drop("tile_id"))


@query(
    "finding_mask",
    with_tables(
        ["regions"],
        """SELECT p.frame_id, p.row_idx, p.col_idx, coalesce(bool_or(p.row_idx BETWEEN top AND bottom AND p.col_idx BETWEEN lft AND rgt), false) AS finding_mask
        FROM pixels p LEFT JOIN findings f USING (frame_id) GROUP BY p.frame_id, p.row_idx, p.col_idx""",
    ),
)
def finding_mask_query(spark, sf):
    s = sheets(spark, sf)
    masked = finding_mask(s, detection.detect(s).findings)
    return tidy(masked.select("frame_id", "row_idx", "col_idx", "finding_mask"))


TRUTH = """((frame_id % 6 = 0 AND ((row_idx BETWEEN 4 AND 8 AND col_idx BETWEEN 4 AND 8) OR (row_idx BETWEEN 11 AND 15 AND col_idx BETWEEN 16 AND 20)))
  OR (frame_id % 6 IN (1, 4, 5) AND row_idx BETWEEN 7 AND 12 AND col_idx BETWEEN 9 AND 14))"""

METRIC_SQL = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END"""


def _metric_select(keys: str, source: str) -> str:
    return f"""SELECT {keys}, CAST(tp AS BIGINT) AS true_positive_px, CAST(fp AS BIGINT) AS false_positive_px, CAST(fn AS BIGINT) AS false_negative_px,
      {r(METRIC_SQL, 'precision')}, {r('CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1.0 END', 'recall')},
      {r('CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE ELSE 1.0 END', 'iou')} FROM ({source}) m"""


@query(
    "mask_metrics",
    with_tables(
        ["regions"],
        _metric_select(
            "frame_id",
            f"""SELECT frame_id, count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp, count(*) FILTER (NOT pred AND truth) AS fn
            FROM (SELECT p.frame_id, p.row_idx, p.col_idx, any_value({TRUTH.replace('frame_id', 'p.frame_id').replace('row_idx', 'p.row_idx').replace('col_idx', 'p.col_idx')}) AS truth,
              coalesce(bool_or(p.row_idx BETWEEN top AND bottom AND p.col_idx BETWEEN lft AND rgt), false) AS pred
              FROM pixels p LEFT JOIN findings f USING (frame_id) GROUP BY p.frame_id, p.row_idx, p.col_idx) q GROUP BY frame_id""",
        ),
    ),
)
def mask_metrics(spark, sf):
    s = sheets(spark, sf)
    masked = finding_mask(s, detection.detect(s).findings).withColumn("truth", F.expr(TRUTH))
    return tidy(validation.mask_metrics(masked, ["frame_id"], "finding_mask"))


@query(
    "delta_t_error",
    with_tables(
        ["regions"],
        f"""SELECT e.frame_id, {r('expected', 'expected_delta_c')}, {r('est', 'estimated_delta_c')}, {r('abs(est - expected)', 'delta_t_error_c')}
        FROM (SELECT frame_id, max(temp_c) FILTER ({TRUTH}) - median(temp_c) FILTER (NOT {TRUTH}) AS expected FROM pixels GROUP BY frame_id) e
        LEFT JOIN (SELECT frame_id, max(delta) AS est FROM findings GROUP BY frame_id) f USING (frame_id)""",
    ),
)
def delta_t_error(spark, sf):
    s = sheets(spark, sf)
    return tidy(validation.delta_error(s.withColumn("truth", F.expr(TRUTH)), detection.detect(s).findings))


@query(
    "residual_ablation",
    with_tables(
        ["layers"],
        _metric_select(
            "frame_id, variant, thr AS residual_threshold_c",
            f"""SELECT frame_id, variant, thr, count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp, count(*) FILTER (NOT pred AND truth) AS fn
            FROM (SELECT frame_id, round(coalesce(t, 'inf'::DOUBLE), 4) AS thr, {TRUTH} AS truth, variant,
                CASE variant WHEN 'baseline' THEN candidate ELSE candidate AND coalesce(abs(residual) >= coalesce(t, 'inf'::DOUBLE), false) END AS pred
              FROM layers LEFT JOIN (SELECT frame_id, quantile_cont(abs(residual), 0.5) AS t FROM layers WHERE candidate GROUP BY frame_id) q USING (frame_id),
              (VALUES ('baseline'), ('residual_gated')) v(variant)) z GROUP BY frame_id, variant, thr""",
        ),
    ),
)
def residual_ablation(spark, sf):
    e = evidence_layers(sheets(spark, sf)).withColumn("truth", F.expr(TRUTH))
    return tidy(validation.residual_ablation(e))


# ---- tiles -------------------------------------------------------------------------------------


@query(
    "tile_grid",
    with_tables(
        ["frames"],
        """SELECT frame_id, tr * 3 + tc AS tile_id, tr * 10 AS core_row_off, least(10, 20 - tr * 10) AS core_height, greatest(0, tr * 10 - 4) AS read_row_off,
        least(20, tr * 10 + 10 + 4) - greatest(0, tr * 10 - 4) AS read_height, tc * 10 AS core_col_off, least(10, 25 - tc * 10) AS core_width,
        greatest(0, tc * 10 - 4) AS read_col_off, least(25, least(25, tc * 10 + 10) + 4) - greatest(0, tc * 10 - 4) AS read_width
        FROM frames, range(0, 2) a(tr), range(0, 3) b(tc)""",
    ),
)
def tile_grid(spark, sf):
    return tidy(tiling.tile_grid(derived.frames(spark, sf), 10, 4).drop("height", "width", "tile_r", "tile_c"))


@query(
    "tile_halo_replication",
    with_tables(
        ["pixels"],
        f"""SELECT frame_id, tr * 3 + tc AS tile_id, row_idx - greatest(0, tr * 10 - 4) AS row_idx, col_idx - greatest(0, tc * 10 - 4) AS col_idx,
        {r('temp_c', 'temp_c')} FROM pixels, range(0, 2) a(tr), range(0, 3) b(tc)
        WHERE row_idx BETWEEN tr * 10 - 4 AND tr * 10 + 13 AND col_idx BETWEEN tc * 10 - 4 AND tc * 10 + 13""",
    ),
)
def tile_halo_replication(spark, sf):
    return tidy(tiling.tile_sheets(derived.pixels(spark, sf), 10, 4).drop("height", "width"))


@query(
    "tile_core_ownership",
    with_tables(["pixels"], f"SELECT frame_id, row_idx, col_idx, (row_idx // 10) * 3 + col_idx // 10 AS tile_id, {r('temp_c', 'temp_c')} FROM pixels"),
)
def tile_core_ownership(spark, sf):
    grid = tiling.tile_grid(derived.frames(spark, sf), 10, 4)
    owned = tiling.core_pixels(tiling.tile_sheets(derived.pixels(spark, sf), 10, 4), grid)
    return tidy(owned.select("frame_id", "row_idx", "col_idx", "tile_id", "temp_c"))


@query("tiled_findings")
def tiled_findings(spark, sf):
    """Tile-scope detection: scene statistics and regions per tile with its halo, then ownership."""
    found, _, _ = tiling.detect_tiled(derived.pixels(spark, sf), derived.frames(spark, sf), GENERIC, size=16, overlap=14)
    return tidy(
        found.select("frame_id", "tile_id", "finding_id", "severity", "area_px", "center_x", "center_y", "delta_temperature_c")
    )


@query("tiled_suppressions")
def tiled_suppressions(spark, sf):
    _, dropped, _ = tiling.detect_tiled(derived.pixels(spark, sf), derived.frames(spark, sf), GENERIC, size=16, overlap=14)
    return tidy(dropped.drop("details"))


# ---- the older threshold workflow --------------------------------------------------------------

# Fixed-size 10 px tiles stand in for 1024 px ones so that frames span several of them.
LEGACY_SQL = """raw AS (SELECT frame_id, row_idx, col_idx, CASE WHEN frame_id % 3 = 1 THEN temp_c * 10 ELSE temp_c END AS raw,
  (row_idx // 13) * 2 + col_idx // 13 AS tile_id FROM pixels),
tops AS (SELECT frame_id, tile_id, max(raw) AS top, count(*) FILTER (raw IS NULL) AS missing FROM raw GROUP BY frame_id, tile_id),
lt AS (SELECT frame_id, tile_id, row_idx, col_idx, CASE WHEN top > 1000 THEN raw - 273.15 WHEN top < 100 THEN raw ELSE raw / 10 END AS temp_c
  FROM raw JOIN tops USING (frame_id, tile_id) WHERE missing = 0)"""


def legacy_tiles(spark, sf):
    raw = F.when(F.col("frame_id") % 3 == 1, F.col("temp_c") * 10).otherwise(F.col("temp_c"))
    return legacy.tile_units(derived.pixels(spark, sf).withColumn("raw", raw), size=13)


@query(
    "legacy_tile_units",
    with_tables(["pixels"], "").rstrip() + ",\n" + LEGACY_SQL + f" SELECT frame_id, tile_id, row_idx AS frame_row, col_idx AS frame_col, {r('temp_c', 'temp_c')} FROM lt",
)
def legacy_tile_units(spark, sf):
    return tidy(legacy_tiles(spark, sf).select("frame_id", "tile_id", "frame_row", "frame_col", "temp_c"))


@query(
    "legacy_normal_mean",
    with_tables(["pixels"], "").rstrip() + ",\n" + LEGACY_SQL
    + f" SELECT frame_id, {r('avg(temp_c) FILTER (temp_c < 50)', 'normal_mean_c')}, count(*) FILTER (temp_c < 50) AS normal_pixels FROM lt GROUP BY frame_id",
)
def legacy_normal_mean(spark, sf):
    return tidy(legacy.normal_mean(legacy_tiles(spark, sf)))


@query(
    "legacy_tiled_histogram",
    with_tables(["pixels"], "").rstrip() + ",\n" + LEGACY_SQL
    + f""", sz AS (SELECT frame_id, tile_id, count(*) AS n, count(*) FILTER (temp_c >= 0) AS binned FROM lt WHERE temp_c < 50 GROUP BY frame_id, tile_id),
    ct AS (SELECT frame_id, tile_id, least(floor(temp_c), 49) AS bin, count(*) AS c FROM lt WHERE temp_c < 50 AND temp_c >= 0 GROUP BY ALL)
    SELECT frame_id, CAST(bin AS BIGINT) AS bin, bin * 1.0 AS bin_start, CAST(sum(c) AS BIGINT) AS n,
      {r('sum(c / binned::DOUBLE * n) / any_value(total)', 'density')}
    FROM ct JOIN sz USING (frame_id, tile_id) JOIN (SELECT frame_id, sum(n) AS total FROM sz GROUP BY frame_id) t USING (frame_id) GROUP BY frame_id, bin""",
)
def legacy_tiled_histogram(spark, sf):
    return tidy(legacy.tiled_histogram(legacy_tiles(spark, sf)))


@query(
    "legacy_frame_histogram",
    with_tables(
        ["pixels"],
        f"""SELECT frame_id, CAST(bin AS BIGINT) AS bin, {r('lo + bin * step', 'bin_start')}, count(*) AS n, {r('count(*) / (total * step)', 'density')}
        FROM (SELECT frame_id, lo, step, total, least(floor((temp_c - lo) / step), 49) AS bin FROM pixels JOIN
          (SELECT frame_id, min(temp_c) AS lo, (max(temp_c) - min(temp_c)) / 50 AS step, count(*) AS total FROM pixels WHERE temp_c < 50 GROUP BY frame_id) e
          USING (frame_id) WHERE temp_c < 50) b GROUP BY frame_id, bin, lo, step, total""",
    ),
)
def legacy_frame_histogram(spark, sf):
    return tidy(legacy.frame_histogram(derived.pixels(spark, sf)))


LEGACY_HOT = """, hotpx AS (SELECT frame_id, tile_id, row_idx, col_idx, temp_c FROM lt WHERE temp_c > 50),
fl AS (SELECT frame_id, tile_id, row_idx, col_idx, row_idx * 25 + col_idx AS root FROM hotpx UNION
  SELECT h.frame_id, h.tile_id, h.row_idx, h.col_idx, f.root FROM fl f JOIN hotpx h ON h.frame_id = f.frame_id AND h.tile_id = f.tile_id
    AND abs(h.row_idx - f.row_idx) <= 1 AND abs(h.col_idx - f.col_idx) <= 1),
lb AS (SELECT frame_id, tile_id, row_idx, col_idx, min(root) AS label FROM fl GROUP BY ALL),
rg AS (SELECT frame_id, tile_id, label, count(*) AS area, CAST(floor(avg(col_idx)) AS BIGINT) AS center_x, CAST(floor(avg(row_idx)) AS BIGINT) AS center_y,
  max(temp_c) AS max_temp FROM lb JOIN hotpx USING (frame_id, tile_id, row_idx, col_idx) GROUP BY frame_id, tile_id, label HAVING count(*) > 15),
nm AS (SELECT frame_id, avg(temp_c) FILTER (temp_c < 50) AS m FROM lt GROUP BY frame_id),
cls AS (SELECT rg.*, max_temp - m AS temp_delta,
  CASE WHEN max_temp > 90 AND area > 1000 THEN 'Severe Hot Spot' WHEN max_temp > 70 AND area > 500 THEN 'Hot Spot' WHEN max_temp > 50 AND area > 100 THEN 'Warm Spot' ELSE 'Minor Anomaly' END AS type,
  CASE WHEN max_temp > 90 THEN 'Critical' WHEN max_temp > 70 THEN 'Moderate' ELSE 'Minor' END AS severity FROM rg JOIN nm USING (frame_id))"""


def legacy_regions(spark, sf):
    return legacy.threshold_regions(legacy_tiles(spark, sf), minimum_area=15)


@query(
    "legacy_threshold_regions",
    with_tables(["pixels"], "").rstrip() + ",\n" + LEGACY_SQL + LEGACY_HOT
    + f" SELECT frame_id, tile_id, area, center_x, center_y, {r('max_temp', 'max_temp')}, {r('temp_delta', 'temp_delta')}, type, severity FROM cls",
)
def legacy_threshold_regions(spark, sf):
    return tidy(legacy_regions(spark, sf).drop("label", "normal_mean_c", "annotation"))


@query(
    "legacy_csv",
    with_tables(["pixels"], "").rstrip() + ",\n" + LEGACY_SQL + LEGACY_HOT
    + f""", reg AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY tile_id, label) AS anomaly_id FROM cls),
    geo AS (SELECT *, CASE WHEN frame_id % 3 = 0 THEN 28.002::DOUBLE - center_y / 20.0::DOUBLE * 0.002 WHEN frame_id % 3 = 1 THEN 28.0::DOUBLE - center_y * 0.00001::DOUBLE END AS lat,
      CASE WHEN frame_id % 3 = 0 THEN -82.0::DOUBLE + center_x / 25.0::DOUBLE * 0.003 WHEN frame_id % 3 = 1 THEN -82.0::DOUBLE + center_x * 0.00001::DOUBLE END AS lon FROM reg)
    SELECT frame_id, anomaly_id, {r('lon', 'coord_x', 6)}, {r('lat', 'coord_y', 6)}, {r('lat', 'latitude', 6)}, {r('lon', 'longitude', 6)},
    {r('''CASE WHEN frame_id % 3 = 0 THEN area * (0.003 / 25 * 111139 * cos(radians(lat))) * (0.002 / 20 * 111139)
      WHEN frame_id % 3 = 1 THEN area * pow(0.3048006096, 2) END''', 'area', 3)} FROM geo""",
)
def legacy_csv(spark, sf):
    """The older register with places: a third of the frames with a KML box, a third with a world file, a third with neither."""
    kind = F.col("frame_id") % 3
    box = F.expr("named_struct('north', 28.002D, 'south', 28.0D, 'west', -82.0D, 'east', -81.997D)")
    world = F.expr(
        "named_struct('x_pixel_size', 0.00001D, 'y_rotation', 0D, 'x_rotation', 0D, 'y_pixel_size', -0.00001D, 'x_center', -82.0D, 'y_center', 28.0D)"
    )
    places = derived.frames(spark, sf).select(
        "frame_id", "width", "height", "crs", F.when(kind == 0, box).alias("box"), F.when(kind == 1, world).alias("world")
    )
    reg = legacy.legacy_coordinates(legacy.legacy_register(legacy_regions(spark, sf)), places)
    # The map unit of these world files is a degree: in pixels of one square unit the areas are large enough to compare.
    area = F.when(kind == 1, F.col("area_m2") * 1e10).otherwise(F.col("area_m2"))
    out = reg.select("frame_id", "anomaly_id", "coord_x", "coord_y", "latitude", "longitude", F.round(area, 3).alias("area"))
    return tidy(out, 6)


@query(
    "legacy_register",
    with_tables(["pixels"], "").rstrip() + ",\n" + LEGACY_SQL + LEGACY_HOT
    + """ SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY tile_id, label) AS anomaly_id,
    CASE severity WHEN 'Critical' THEN 1 WHEN 'Moderate' THEN 2 ELSE 3 END AS priority, type, severity, center_x, center_y,
    CASE type WHEN 'Severe Hot Spot' THEN 'Inspect and replace faulty module or wiring immediately.'
      WHEN 'Hot Spot' THEN 'Clean panel surface, check for shading or defects, schedule repair.'
      WHEN 'Warm Spot' THEN 'Monitor panel performance, schedule cleaning if needed.'
      ELSE 'Log for future monitoring, no immediate action required.' END AS maintenance_action,
    'Small temperature rise, likely benign (ΔT: ' || printf('%.1f', temp_delta) || '°C). Monitor for changes.' AS annotation FROM cls""",
)
def legacy_register(spark, sf):
    reg = legacy.legacy_register(legacy_regions(spark, sf))
    return tidy(
        reg.select("frame_id", "anomaly_id", "priority", "type", "severity", "center_x", "center_y", "maintenance_action", "annotation")
    )

