import math

import numpy as np
import pytest
from helpers import box, flood, frame_table
from pyspark.sql import functions as F

from emberfield.operators import detection, regions, stencil, validation
from emberfield.operators.evidence import DetectionSettings, evidence_layers, finding_mask
from emberfield.operators.sheets import frame_sheets


def findings_of(d, *columns):
    return d.findings.orderBy("frame_id", "rank").select("frame_id", *columns).collect()


def test_hot_block_and_small_region(spark):
    hot = np.full((20, 20), 25.0)
    hot[5:10, 6:11] = 45.0
    tiny = np.full((10, 10), 20.0)
    tiny[4:6, 4:6] = 50.0
    d = detection.detect(frame_sheets(frame_table(spark, {0: hot, 1: tiny})), DetectionSettings(minimum_area_px=10))
    rows = findings_of(d, "area_px", "severity", "center_x", "center_y", "hotspot_x", "hotspot_y", "finding_id")
    assert [(r.frame_id, r.area_px, r.severity, r.center_x, r.center_y, r.hotspot_x, r.hotspot_y, r.finding_id) for r in rows] == [
        (0, 25, "moderate", 8, 7, 6, 5, "A-001")
    ]
    assert [r.reason for r in d.suppressions.collect()] == ["MINIMUM_REGION_SUPPORT"]


def test_synthetic_frames(spark):
    frames = validation.synthetic_frames(spark)
    d = detection.detect(frame_sheets(frames))
    names = {r.frame_id: r.name for r in frames.select("frame_id", "name").distinct().collect()}
    found = {}
    for r in findings_of(d, "finding_id", "reference_temperature_c", "severity"):
        found.setdefault(names[r.frame_id], []).append(r)
    assert len(found["uniform_hotspot"]) == 1
    assert len(found["gradient_hotspot"]) == 1
    assert found["globally_warm_scene"][0].reference_temperature_c == pytest.approx(55.0)
    assert [r.finding_id for r in found["two_anomalies"]] == ["A-001", "A-002"]
    assert len(found["nodata_boundary"]) == 1
    for quiet in ("single_pixel_spike", "edge_artifact", "weak_anomaly"):
        assert quiet not in found
    reasons = {(names[r.frame_id], r.reason) for r in d.suppressions.collect()}
    assert ("single_pixel_spike", "SINGLE_PIXEL_SPIKE") in reasons
    masked = finding_mask(frame_sheets(frames), d.findings).join(
        frames.select("frame_id", "row_idx", "col_idx", "name", "truth"), ["frame_id", "row_idx", "col_idx"]
    )
    m = {r.name: r for r in validation.mask_metrics(masked, ["name"], "finding_mask").collect()}
    assert m["uniform_hotspot"].iou == 1.0
    assert m["weak_anomaly"].precision == 1.0 and m["weak_anomaly"].recall == 1.0


def test_solar_mission_has_three_findings(spark):
    d = detection.detect(frame_sheets(validation.solar_mission(spark)), DetectionSettings.from_profile("photovoltaic"))
    assert sorted(r.severity for r in d.findings.collect()) == ["critical", "minor", "moderate"]


def test_box_sums_match_numpy_for_every_block_size(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(20, 4, (23, 31))
    a[rng.random(a.shape) < 0.1] = np.nan
    sheets = frame_sheets(frame_table(spark, {0: a}))
    for block in (16, 128):
        got = stencil.box_sums(sheets, [0, 1, 3, 7], block=block).toPandas().sort_values(["row_idx", "col_idx"])
        for q in (1, 3, 7):
            s, n = box(a, q)
            assert np.allclose(got[f"s{q}"].to_numpy().reshape(a.shape), s)
            assert np.array_equal(got[f"n{q}"].to_numpy().reshape(a.shape), n.astype(int))
        assert np.array_equal(got["n0"].to_numpy().reshape(a.shape), np.isfinite(a).astype(int))


@pytest.mark.parametrize("shape", [(1, 9), (3, 4), (2, 2), (1, 1), (8, 8)])
def test_reflection_on_frames_smaller_than_the_radius(spark, shape):
    a = np.arange(shape[0] * shape[1], dtype=float).reshape(shape)
    got = stencil.box_sums(frame_sheets(frame_table(spark, {0: a})), [7]).toPandas().sort_values(["row_idx", "col_idx"])
    s, n = box(a, 7)
    assert np.allclose(got["s7"].to_numpy().reshape(shape), s)
    assert np.array_equal(got["n7"].to_numpy().reshape(shape), n.astype(int))


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("group", [5, 64])
def test_regions_match_flood_fill(spark, connectivity, group):
    rng = np.random.default_rng(connectivity)
    masks = {i: rng.random((17, 26)) < p for i, p in enumerate((0.2, 0.45, 0.6, 0.95))}
    rows = [(i, 0, r, c, 17, 26) for i, m in masks.items() for r, c in zip(*map(lambda x: x.tolist(), np.nonzero(m)))]
    mask = spark.createDataFrame(rows, "frame_id long, tile_id int, row_idx int, col_idx int, height int, width int")
    runs = regions.pixel_runs(mask, [F.count("*").alias("area")], group=group)
    got = regions.label_regions(runs, connectivity, group=group, stitch=group < 26).groupBy("frame_id", "label").agg(F.sum("area").alias("n"))
    want = set()
    for i, m in masks.items():
        labels, counts = np.unique(flood(m, connectivity == 8)[m], return_counts=True)
        want |= {(i, int(label), int(n)) for label, n in zip(labels, counts)}
    assert {(r.frame_id, r.label, r.n) for r in got.collect()} == want


def test_evidence_frame(spark):
    a = np.full((64, 64), 24.0)
    a[22:34, 24:36] = 48.0
    sheets = frame_sheets(frame_table(spark, {0: a}))
    d = detection.detect(sheets, experimental=True)
    assert d.evidence.where("candidate_mask").count() == 144
    assert finding_mask(d.evidence, d.findings).where("finding_mask").count() == 144
    row = d.findings.first()
    assert (row.bbox_left, row.bbox_top, row.bbox_right, row.bbox_bottom) == (24, 22, 35, 33)


def test_components_partition_the_candidates(spark):
    rng = np.random.default_rng(9)
    a = 25 + rng.normal(0, 1, (40, 40))
    a[5:12, 5:12] += 15
    a[20:22, 30:39] += 12
    a[33, 3] += 30
    sheets = frame_sheets(frame_table(spark, {0: a}))
    d = detection.detect(sheets)
    candidates = evidence_layers(sheets).where("candidate_mask").count()
    assert d.components.agg(F.sum("area_px")).first()[0] == candidates
    assert d.findings.count() + d.suppressions.count() == d.components.count()


def test_empty_frame_and_bad_settings(spark):
    d = detection.detect(frame_sheets(frame_table(spark, {0: np.full((6, 6), math.nan)})))
    assert d.findings.count() == 0 and d.suppressions.count() == 0
    with pytest.raises(ValueError):
        DetectionSettings(minimum_delta_c=0)
    with pytest.raises(ValueError):
        DetectionSettings(connectivity=6)
    with pytest.raises(KeyError):
        DetectionSettings.from_profile("unheard-of")


def test_one_shuffle_serves_all_stencil_windows(spark):
    a = np.full((12, 12), 20.0)
    plan = stencil.box_sums(frame_sheets(frame_table(spark, {0: a})), [1, 3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window [") == 2


def test_residual_ablation_routes_agree(spark):
    a = np.full((30, 30), 24.0)
    a[8:16, 8:16] = np.linspace(44, 52, 64).reshape(8, 8)
    e = evidence_layers(frame_sheets(frame_table(spark, {0: a}))).withColumn(
        "truth", F.col("row_idx").between(8, 15) & F.col("col_idx").between(8, 15)
    )
    plain = validation.residual_ablation(e).orderBy("variant").collect()
    binned = validation.residual_ablation(e, giant=F.col("height") > 0).orderBy("variant").collect()
    assert plain == binned
    assert plain[0].precision == plain[0].recall == 1.0
