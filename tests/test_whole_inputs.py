"""Nothing is cut off: routes for large inputs equal the small ones, and failed or missing parts are counted."""

from pyspark.sql import functions as F

from emberfield.operators import lifecycle, matching, quality, radiometry, registers, statistics
from emberfield.sources import files
from tests.helpers import frame_table


def test_binned_route_equals_the_built_in(spark):
    rows = [(f, r, c, None if (r + c) % 7 == 0 else float((r * 31 + c * 17 + f) % 50) / 3, 12, 9) for f in range(3) for r in range(12) for c in range(9)]
    pixels = spark.createDataFrame(rows, "frame_id long, row_idx int, col_idx int, temp_c double, height int, width int")
    key = lambda df: sorted((r["frame_id"], round(r["median_c"], 9), round(r["p95_c"], 9), r["sample_size"], r["percentiles_sampled"]) for r in df.collect())
    assert key(statistics.raster_statistics(pixels, limit=10)) == key(statistics.raster_statistics(pixels))
    frames = spark.createDataFrame(
        [(f, 12, 9, "float32", {"THERMAL_UNIT": "auto"}, None, None) for f in range(3)],
        "frame_id long, height int, width int, dtype string, tags map<string,string>, dataset_scale double, dataset_offset double",
    )
    raw = pixels.select("frame_id", "row_idx", "col_idx", F.col("temp_c").alias("raw"))
    units = lambda limit: {r["frame_id"]: (r["resolved_unit"], r["error"]) for r in radiometry.frame_encodings(raw, frames, limit).collect()}
    assert units(10) == units(None) and len(units(10)) == 3


def test_gap_in_a_mosaic_lowers_coverage(spark):
    pixels = frame_table(spark, {1: __import__("numpy").full((6, 8), 20.0)}).where("row_idx < 3 AND col_idx < 7")
    row = quality.pixel_metrics(pixels).first()
    assert (row["total_pixels"], row["valid_pixels"]) == (48, 21)


def test_failed_sources_count_as_discovered_and_rejected(spark):
    gate = spark.createDataFrame([(1, "pass", []), (2, "rejected", [])], "frame_id long, status string, warnings array<string>")
    frames = spark.createDataFrame([(1,), (2,), (3,)], "frame_id long")
    failures = spark.createDataFrame([(2, "x"), (3, "y")], "frame_id long, error string")
    found = spark.createDataFrame([], "severity string, max_temperature_c double, delta_temperature_c double")
    row = registers.inspection_summary(gate, found, found, frames, failures).first()
    assert (row["images_discovered"], row["images_accepted"], row["images_rejected"]) == (3, 1, 2)


def test_canceled_runs_keep_what_they_have(spark):
    ids = lambda *x: spark.createDataFrame([(i, "e") for i in x], "frame_id long, error string")
    outcome = lambda *a: tuple(lifecycle.run_outcome(*a).first())
    assert outcome(ids(1, 2, 3), ids(2), ids(1, 2)) == (3, 1, 1, "canceled")
    assert outcome(ids(1, 2), ids(2)) == (2, 1, 1, "complete")
    assert outcome(ids(1, 2), ids(1, 2), ids(1, 2)) == (2, 0, 2, "failed")


def test_ids_of_large_sources_do_not_meet(spark):
    findings = spark.createDataFrame([(1, 1_000_001), (2, 1)], "frame_id long, rank int")
    frames = spark.createDataFrame([(1, 0), (2, 1)], "frame_id long, input_order int")
    got = registers.observation_ids(findings, frames)
    assert got.select("obs_ord").distinct().count() == 2


def test_every_name_is_a_hint_and_all_evidence_stays(spark):
    names = [(1, f"/m/{i:04d}.tif", "", True, True, 1) for i in range(300)] + [(1, "/m/zz-solar.tif", "", True, True, 1)]
    listed = spark.createDataFrame(names, "mission_id long, path string, ext string, is_image boolean, is_analysis_source boolean, size_bytes long")
    roots = spark.createDataFrame([(1, "mission")], "mission_id long, folder string")
    with_hint = files.mission_intake(listed, roots).first()["profile_id"]
    without = files.mission_intake(listed.where("path NOT LIKE '%solar%'"), roots).first()["profile_id"]
    assert without == "generic-thermal" and with_hint != without


def test_last_limits_of_a_kml_file_win(spark, tmp_path):
    box = lambda n: f"<LatLonAltBox><north>{n}</north><south>1</south><east>2</east><west>1</west></LatLonAltBox>"
    (tmp_path / "a.kml").write_text(f"<kml><Document>{box(9)}<x>{box(5)}</x></Document></kml>")
    assert files.read_boxes(spark, str(tmp_path)).first()["north"] == 5.0


def test_blank_ids_give_way_to_the_image(spark):
    rows = [(1, 1, "A-1", "i.tif"), (1, 2, " ".strip(), "j.tif"), (1, 3, None, None)]
    assigned = spark.createDataFrame(rows, "founder long, obs_ord long, finding_id string, source_image_id string")
    assert sorted(r["finding_id"] for r in matching.supporting_observations(assigned).collect()) == ["A-1", "j.tif"]
