import json
import math

import pytest
from pyspark.sql import functions as F

from emberfield.functions import columns, geo
from emberfield.operators import legacy, radiometry, registers, roi
from emberfield.sources import derived, files, sinks
from emberfield.api import run_inspection

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_utm_fixed_points(spark):
    x, y = geo.wgs84_to_utm(F.lit(-81.0), F.lit(0.0), F.lit("EPSG:32617"))
    lon, lat = geo.utm_to_wgs84(F.lit(500000.0), F.lit(10000000.0), F.lit("EPSG:32717"))
    r = one(spark, x.alias("x"), y.alias("y"), lon.alias("lon"), lat.alias("lat"))
    assert r.x == pytest.approx(500000.0, abs=1e-6) and r.y == pytest.approx(0.0, abs=1e-6)
    assert r.lon == pytest.approx(-81.0) and r.lat == pytest.approx(0.0, abs=1e-9)
    # published example: 43°38'33.24"N 79°23'13.7"W is 17T 630084 m E 4833438 m N
    x, y = geo.wgs84_to_utm(F.lit(-(79 + 23 / 60 + 13.7 / 3600)), F.lit(43 + 38 / 60 + 33.24 / 3600), F.lit("EPSG:32617"))
    r = one(spark, x.alias("x"), y.alias("y"))
    assert r.x == pytest.approx(630084, abs=1) and r.y == pytest.approx(4833438, abs=1)


def test_blocked_or_unknown_crs_gives_no_coordinates(spark):
    for crs in ('LOCAL_CS["x"]', "EPSG:6447"):
        lon, _ = geo.to_wgs84(F.lit(500000.0), F.lit(3100000.0), F.lit(crs))
        assert one(spark, lon.alias("lon")).lon is None


def test_affine_inverse(spark):
    t = F.array(*[F.lit(v) for v in (2.0, 0.5, 100.0, 0.25, -3.0, 200.0)])
    mx, my = geo.pixel_to_map(F.lit(10.0), F.lit(10.0), t, center=False)
    px, py = geo.map_to_pixel(mx, my, t)
    r = one(spark, px.alias("x"), py.alias("y"))
    assert (r.x, r.y) == pytest.approx((10.0, 10.0))


def test_nodata_never_enters_temperatures(spark):
    tiles = spark.createDataFrame([(0, [1.0, float("nan"), float("inf"), float("-inf")], 2)], "frame_id long, values array<float>, width int")
    assert [r.temp_c for r in radiometry.tile_pixels(tiles).orderBy("row_idx", "col_idx").collect()] == [1.0, None, None, None]


def test_ambiguous_median_is_celsius_first(spark):
    r = one(spark, *[radiometry.inferred_unit(F.lit(v)).alias(f"m{i}") for i, v in enumerate((180.0, 300.0, 450.0, 2950.0, 29500.0, 8500.0))])
    assert list(r) == ["celsius", "kelvin", None, "decikelvin", "centikelvin", None]


def test_half_even_text(spark):
    assert one(spark, columns.fixed(F.lit(20.25), 1).alias("t")).t == "20.2"
    assert one(spark, columns.signed(F.lit(3.0), 1).alias("t")).t == "+3.0"


def test_world_file_with_five_lines_is_an_error_row(spark, tmp_path):
    (tmp_path / "a.tfw").write_text("1\n0\n0\n-1\n10\n20\n")
    (tmp_path / "b.tfw").write_text("1\n0\n0\n-1\n10\n")
    (tmp_path / "c.tfw").write_text("1\n\n0\n0\n-1\n10\nx\n")
    got = {r.file[-5:]: r for r in files.read_world_files(spark, str(tmp_path)).collect()}
    assert got["a.tfw"].world.x_center == 10.0 and got["a.tfw"].error is None
    assert got["b.tfw"].world is None and got["b.tfw"].error
    assert got["c.tfw"].world is None


def test_kml_box_wins_over_placemarks(spark, tmp_path):
    mark = "<Placemark><name>p{0}</name><Point><coordinates>{0},{1},0</coordinates></Point></Placemark>"
    box = "<GroundOverlay><LatLonBox><north>5</north><south>1</south><east>4</east><west>2</west></LatLonBox></GroundOverlay>"
    (tmp_path / "a.kml").write_text("<kml><Document>" + mark.format(1, 2) + mark.format(3, 4) + box + "</Document></kml>")
    (tmp_path / "b.kml").write_text("<kml><Document>" + mark.format(1, 2) + mark.format(3, 4) + mark.format("x", "y") + "</Document></kml>")
    path = f"{tmp_path}/*.kml"
    got = {r.file[-5:]: r for r in files.kml_bounds(files.read_placemarks(spark, path), files.read_boxes(spark, path)).collect()}
    assert (got["a.kml"].north, got["a.kml"].origin) == (5.0, "box")
    assert got["b.kml"].north == pytest.approx(4.001) and got["b.kml"].west == pytest.approx(0.999)


def test_folder_scan_reads_no_contents(spark, tmp_path):
    for name in ("solar/t1.TIF", "solar/v.jpg", "solar/deep/area.kml", "solar/readme.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"12345")
    scan = files.scan_folder(spark, str(tmp_path), "m")
    assert "content" not in scan._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert scan.count() == 3 and scan.where("is_analysis_source").count() == 1
    roots = spark.createDataFrame([("m", "Solar_Farm")], "mission_id string, folder string")
    r = files.mission_intake(scan, roots).first()
    assert (r.profile_id, r.project_name, r.total_bytes, r.ready) == ("photovoltaic", "Solar Farm", 15, True)


def test_no_geojson_without_coordinates(spark, tmp_path):
    rows = spark.createDataFrame([("A-001", None, None)], "finding_id string, latitude double, longitude double")
    assert sinks.write_geojson(rows, str(tmp_path / "g")) is False
    assert not (tmp_path / "g").exists()


def test_manifest_detects_change(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    before = spark.createDataFrame(sinks.file_manifest(spark, str(tmp_path)).collect())
    assert {r.path for r in before.collect()} == {"x/a.txt", "b.txt"}
    (tmp_path / "b.txt").write_text("changed")
    (tmp_path / "c.txt").write_text("new")
    state = {r.path: r.state for r in sinks.verify_manifest(before, sinks.file_manifest(spark, str(tmp_path))).collect()}
    assert state == {"x/a.txt": "ok", "b.txt": "changed", "c.txt": "unexpected"}


def test_narrative_cannot_replace_numbers(spark):
    f = spark.createDataFrame([("A-001", 20.0, "minor")], "finding_id string, delta_temperature_c double, severity string")
    with pytest.raises(ValueError):
        registers.attach_narrative(f, f)
    notes = spark.createDataFrame([("A-001", "text")], "finding_id string, summary string")
    joined = registers.attach_narrative(f, notes)
    assert joined.first().summary == "text" and joined.first().narratives == 1
    two = registers.attach_narrative(f, notes.union(notes.selectExpr("finding_id", "'other'")))
    assert [(r.summary, r.narratives, r.severity) for r in two.collect()] == [("other", 2, "minor")]
    state = lambda df: {r.finding_id: r.state for r in registers.authority_check(f, df, "finding_id").collect()}
    assert state(joined) == {"A-001": "kept"} and state(joined.where("false")) == {"A-001": "lost"}
    assert state(joined.withColumn("severity", F.lit("critical"))) == {"A-001": "changed"}
    assert state(joined.withColumn("finding_id", F.lit("B"))) == {"A-001": "lost", "B": "added"}


def test_lists_in_narrator_texts_are_quoted(spark):
    texts = ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", ""]
    df = spark.createDataFrame([(texts,), ([],)], "v array<string>")
    assert [r[0] for r in df.select(registers.listed_text(F.col("v"))).collect()] == [repr(texts), "[]"]


def test_nested_keys_are_sorted(spark):
    df = spark.sql("SELECT 1 AS b, named_struct('z', array(named_struct('y', 1, 'x', map('q', 1, 'p', 2))), 'a', CAST(NULL AS STRING)) AS a, CAST(NULL AS STRUCT<d: INT, c: INT>) AS n")
    text = df.select(sinks.sorted_json(df)).first()[0]
    assert text == '{"a":{"a":null,"z":[{"x":{"p":2,"q":1},"y":1}]},"b":1,"n":null}'


def test_documents_of_sources_without_findings_are_whole(spark):
    frames = spark.sql("SELECT id AS frame_id, concat('m/\"', id, '.tif') AS source_path, CAST(NULL AS MAP<STRING, STRING>) AS tags FROM range(2)")
    quality = spark.sql("SELECT 0L AS frame_id, 'pass' AS status")
    findings = spark.sql("SELECT 0L AS frame_id, 0 AS tile_id, id AS label, CAST(id + 1 AS INT) AS rank, concat('A-', id) AS finding_id FROM range(3)")
    gone = spark.sql("SELECT 1L AS frame_id, 0 AS tile_id, id AS label, 'EDGE_ARTIFACT' AS reason FROM range(2)")
    lines = sinks.inspection_documents(frames, quality, quality, quality, findings, gone, {"site": "é"}, "p")
    texts = {}
    for r in lines.orderBy("frame_id", "section", "seq").collect():
        texts[r.frame_id] = texts.get(r.frame_id, "") + r.value
    one, two = (json.loads(texts[i]) for i in (0, 1))
    assert [f["finding_id"] for f in one["findings"]] == ["A-0", "A-1", "A-2"] and one["suppressions"] == [] and one["quality"] == {"status": "pass"}
    assert two["findings"] == [] and len(two["suppressions"]) == 2 and two["quality"] is None and two["source"] == 'm/"1.tif'
    assert list(one) == sorted(one) and one["project"] == {"site": "é"}


def test_legacy_areas_and_places(spark):
    reg = spark.sql("SELECT id AS frame_id, 10 AS center_x, 5 AS center_y, 7L AS area FROM range(3)")
    places = spark.sql(
        """SELECT id AS frame_id, 100 AS width, 50 AS height, 'EPSG:4326' AS crs,
        IF(id = 0, named_struct('north', 10.1D, 'south', 10.0D, 'west', 20.0D, 'east', 20.2D), NULL) AS box,
        IF(id = 1, named_struct('x_pixel_size', 0.5D, 'y_rotation', 0D, 'x_rotation', 0D, 'y_pixel_size', -0.25D, 'x_center', 3.0D, 'y_center', 8.0D), NULL) AS world FROM range(3)"""
    )
    got = {r.frame_id: r for r in legacy.legacy_coordinates(reg, places).collect()}
    assert (got[0].latitude, got[0].longitude) == pytest.approx((10.09, 20.02)) and got[0].coord_x == pytest.approx(20.02)
    assert got[0].area_m2 == pytest.approx(7 * 0.002 * 111139 * math.cos(math.radians(10.09)) * 0.002 * 111139)
    assert (got[1].coord_x, got[1].coord_y, got[1].longitude, got[1].latitude) == pytest.approx((8.0, 6.75, 8.0, 6.75))
    assert got[1].area_m2 == pytest.approx(7 * 0.5 * 0.25 * 0.3048006096**2)
    assert got[2].coord_x is None and got[2].latitude is None and got[2].area_m2 is None


def test_roi_shapes_outside_and_flat_line(spark):
    rows = [
        (1, 0, "spot", 99.0, 0.0, None, None, None, None, None, None, None, 4, None, 10, 10),
        (2, 0, "line", 3.0, 3.0, 3.0, 3.0, None, None, None, None, 1.5, None, None, 10, 10),
        (3, 0, "rectangle", 20.0, 20.0, 30.0, 30.0, None, None, None, None, None, None, None, 10, 10),
        (4, 0, "polygon", None, None, None, None, None, None, None, None, None, None, [(0.0, 0.0), (1.0, 1.0)], 10, 10),
        (5, 0, "spot", 0.0, 0.0, None, None, None, None, None, None, None, 4, None, 10, 10),
    ]
    schema = (
        "roi_id int, frame_id long, kind string, x0 double, y0 double, x1 double, y1 double, cx double, cy double, rx double, ry double, "
        "width_px double, kernel int, points array<struct<x:double,y:double>>, height int, width int"
    )
    rois = spark.createDataFrame(rows, schema)
    pixels = spark.range(100).selectExpr("0L AS frame_id", "CAST(id div 10 AS INT) AS row_idx", "CAST(id % 10 AS INT) AS col_idx", "CAST(id AS DOUBLE) AS temp_c", "10 AS height", "10 AS width")
    stats = roi.roi_statistics(pixels, rois)
    got = {r.roi_id: r for r in stats.collect()}
    assert got[2].mean_c == 33.0 and got[2].valid_pixels == 1
    assert got[3].mean_c == 99.0  # clamped onto the corner
    assert got[5].valid_pixels == 9
    assert {r.roi_id for r in roi.roi_failures(rois, stats).collect()} == {1, 4}
    binned = {r.roi_id: r.median_c for r in roi.roi_statistics(pixels, rois, limit=1).collect()}
    assert binned == {k: v.median_c for k, v in got.items()}


def test_run_inspection_isolates_failures(spark):
    run = run_inspection(derived.raw_pixels(spark, SF), derived.frames(spark, SF).withColumn(
        "tags", F.expr("IF(frame_id = 2, map('isCalibrated', 'false', 'UNIT', 'c'), tags)")
    ), project={"project_id": "p", "inspection_id": "i"})
    s = run.summary.first()
    assert (s.images_discovered, s.images_accepted, s.images_rejected, s.canonical_findings) == (3, 2, 1, 2)
    assert (s.critical, s.moderate, s.minor) == (1, 1, 0)
    assert [r.frame_id for r in run.failures.collect()] == [2]
    ids = sorted(r.finding_id for r in run.observations.collect())
    assert ids == ["OBS-00001-001", "OBS-00002-001"]


def test_mosaic_run_analyses_only_the_mosaic(spark):
    frames = derived.frames(spark, SF).withColumn("tags", F.expr("map('THERMAL_UNIT', 'celsius')"))
    raw = derived.pixels(spark, SF).withColumnRenamed("temp_c", "raw")
    run = run_inspection(raw, frames, mosaic="on")
    assert run.summary.first().images_discovered == 1
    assert {r.frame_id for r in run.observations.collect()} == {0}
