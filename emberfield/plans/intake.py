"""Queries on sources: classification, encoding, units, quality, probes, mission files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.operators import quality, radiometry
from emberfield.plans.catalog import query, tidy
from emberfield.plans.sql import r, with_tables
from emberfield.session import checkpoint_folder
from emberfield.sources import derived, files


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, i.e. on storage every executor sees."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "tile_array_ingest",
    f"""SELECT vec_id AS frame_id, (i - 1) // 8 AS row_idx, (i - 1) % 8 AS col_idx, {r('CAST(embedding[i] AS DOUBLE)', 'temp_c', 6)}
    FROM embeddings, range(1, 65) t(i)""",
)
def tile_array_ingest(spark, sf):
    tiles = derived.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("values"), F.lit(8).alias("width"))
    return tidy(radiometry.tile_pixels(tiles).drop("height", "width"), 6)


@query(
    "tile_array_statistics",
    f"""SELECT label AS frame_id, {r('min(v)', 'minimum_c', 6)}, {r('max(v)', 'maximum_c', 6)}, {r('avg(v)', 'mean_c', 6)}, {r('median(v)', 'median_c', 6)},
    {r('stddev_pop(v)', 'stddev_c', 6)}, {r('quantile_cont(v, 0.95)', 'p95_c', 6)}, count(v) AS valid_pixels
    FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) e GROUP BY label""",
)
def tile_array_statistics(spark, sf):
    from emberfield.operators.statistics import summarize

    tiles = derived.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("frame_id"), F.col("embedding").alias("values"), F.lit(8).alias("width"))
    # a handful of labels, each with its share of the whole table: all take the binned route
    return tidy(summarize(radiometry.tile_pixels(tiles), ["frame_id"], giant=F.lit(True)), 6)


DESCRIPTOR_SPARK = [
    "p_partkey AS source_id",
    """CASE p_partkey % 6 WHEN 0 THEN map('thermal_unit', 'Kelvin') WHEN 1 THEN map('isCalibrated', 'No')
       WHEN 2 THEN map('TEMP_SCALE', '0.1', 'Temp_Offset', '-10', 'UNIT', ' ') WHEN 3 THEN map('isCalibrated', 'true', 'UNITS', '0.01 K')
       WHEN 4 THEN map('THERMAL_SCALE', '  ') ELSE map('isCalibrated', 'maybe') END AS tags""",
    "CAST(1 + p_partkey % 4 AS INT) AS band_count",
    "element_at(array('uint8', 'UInt8', 'float32', 'uint16', 'int8'), CAST(1 + p_partkey % 5 AS INT)) AS dtype",
    "p_size * 2500000L AS pixel_count",
    "p_partkey % 7 = 0 AS configured",
    "CASE p_partkey % 3 WHEN 0 THEN 0.0D WHEN 1 THEN 0.04D END AS dataset_scale",
    "CASE p_partkey % 4 WHEN 0 THEN 0.0D WHEN 1 THEN -273.15D END AS dataset_offset",
]


def descriptors(spark: SparkSession, sf: str) -> DataFrame:
    return derived.table(spark, sf, "part").selectExpr(*DESCRIPTOR_SPARK)


DESCRIPTOR_SQL = """d AS (SELECT p_partkey AS source_id, p_partkey % 6 AS t, 1 + p_partkey % 4 AS band_count,
  ['uint8', 'UInt8', 'float32', 'uint16', 'int8'][1 + p_partkey % 5] AS dtype, p_size * 2500000::BIGINT AS pixel_count, p_partkey % 7 = 0 AS configured,
  CASE p_partkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.04 END::DOUBLE AS dataset_scale,
  CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN -273.15 END::DOUBLE AS dataset_offset FROM part)"""


@query(
    "source_classification",
    f"""WITH {DESCRIPTOR_SQL}, e AS (SELECT *, lower(dtype) IN ('uint8', 'int8') AND NOT (configured OR t IN (0, 2, 3)) AS ambiguous FROM d),
    w AS (SELECT *, list_filter([CASE WHEN t = 1 THEN '{fv.REASON_UNCALIBRATED}' END, CASE WHEN ambiguous AND band_count >= 3 THEN '{fv.REASON_RENDERED}' END,
      CASE WHEN ambiguous AND band_count < 3 THEN '{fv.REASON_AMBIGUOUS}' END], lambda x: x IS NOT NULL) AS reasons FROM e)
    SELECT source_id, CASE t WHEN 1 THEN false WHEN 3 THEN true END AS is_calibrated, array_to_string(reasons, '|') AS radiometric_reasons,
      len(reasons) = 0 AS radiometric_candidate, pixel_count > 50000000 AS requires_tiled_processing,
      {r('pixel_count * 4 / 1073741824.0', 'minimum_float32_band_gib', 3)} FROM w""",
)
def source_classification(spark, sf):
    c = radiometry.classify_sources(descriptors(spark, sf))
    return tidy(
        c.select("source_id", "is_calibrated", "radiometric_reasons", "radiometric_candidate", "requires_tiled_processing", "minimum_float32_band_gib")
    )


@query(
    "encoding_resolution",
    f"""WITH {DESCRIPTOR_SQL} SELECT source_id, coalesce(CASE t WHEN 2 THEN 0.1::DOUBLE END, nullif(dataset_scale, 0), 1.0::DOUBLE) AS scale,
    coalesce(CASE t WHEN 2 THEN -10.0::DOUBLE END, nullif(dataset_offset, 0), 0.0::DOUBLE) AS "offset",
    CASE t WHEN 0 THEN 'Kelvin' WHEN 3 THEN '0.01 K' ELSE 'auto' END AS unit FROM d""",
)
def encoding_resolution(spark, sf):
    return tidy(radiometry.resolve_encoding(descriptors(spark, sf)).select("source_id", "scale", "offset", "unit"))


UNITS = ["c", "DegC", " °C", "K", "kelvin", "F", "degF", "0.1 C", "deci C", "0.1 K", "decikelvin", "0.01K", "centi k", "rankine"]


@query(
    "unit_conversion",
    f"""WITH u AS (SELECT o_orderkey, o_totalprice, [{', '.join("'" + u + "'" for u in UNITS)}][1 + o_orderkey % {len(UNITS)}] AS unit FROM orders),
    c AS (SELECT *, replace(replace(lower(trim(unit)), '°', ''), ' ', '') AS k FROM u)
    SELECT o_orderkey, {r('''CASE WHEN k IN ('c', 'degc', 'celsius') THEN o_totalprice WHEN k IN ('k', 'kelvin') THEN o_totalprice - 273.15
      WHEN k IN ('f', 'degf', 'fahrenheit') THEN (o_totalprice - 32) * (5.0::DOUBLE / 9.0) WHEN k IN ('decic', 'decicelsius', '0.1c') THEN o_totalprice / 10.0
      WHEN k IN ('decik', 'decikelvin', '0.1k') THEN o_totalprice / 10.0 - 273.15 WHEN k IN ('centik', 'centikelvin', '0.01k') THEN o_totalprice / 100.0 - 273.15 END''', 'temp_c', 6)} FROM c""",
)
def unit_conversion(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("o_orderkey") % len(UNITS) + 1).cast("int"))
    o = derived.table(spark, sf, "orders").withColumn("unit", radiometry.canonical_unit(unit))
    return tidy(o.select("o_orderkey", radiometry.to_celsius(F.col("o_totalprice"), F.col("unit")).alias("temp_c")), 6)


@query(
    "scale_offset",
    f"SELECT o_orderkey, {r('o_totalprice * 0.04 + -273.15', 'scaled', 6)} FROM orders",
)
def scale_offset(spark, sf):
    o = derived.table(spark, sf, "orders")
    return tidy(o.select("o_orderkey", (F.col("o_totalprice") * 0.04 + -273.15).alias("scaled")), 6)


def encodings(spark, sf):
    return radiometry.frame_encodings(derived.raw_pixels(spark, sf), derived.frames(spark, sf))


@query(
    "unit_inference",
    with_tables(
        ["frames"],
        "SELECT frame_id, 1.0::DOUBLE AS scale, 0.0::DOUBLE AS \"offset\", CASE WHEN raw_counts THEN 'decikelvin' ELSE 'celsius' END AS resolved_unit, CAST(NULL AS VARCHAR) AS error FROM frames",
    ),
)
def unit_inference(spark, sf):
    return tidy(encodings(spark, sf))


@query(
    "celsius_normalisation",
    with_tables(["pixels"], f"SELECT frame_id, row_idx, col_idx, {r('temp_c', 'temp_c', 9)} FROM pixels"),
)
def celsius_normalisation(spark, sf):
    out = radiometry.normalise(derived.raw_pixels(spark, sf), encodings(spark, sf))
    return tidy(out.select("frame_id", "row_idx", "col_idx", "temp_c"), 9)


@query(
    "unit_failures",
    f"""WITH m AS (SELECT o_custkey AS frame_id, median(o_totalprice / 20.0) AS med FROM orders GROUP BY o_custkey)
    SELECT frame_id, 'ValueError' AS error_type, '{fv.UNIT_ERROR}' AS error FROM m
    WHERE NOT (med BETWEEN -100 AND 200 OR med BETWEEN 170 AND 400 OR med BETWEEN 1500 AND 4000 OR med BETWEEN 20000 AND 40000)""",
)
def unit_failures(spark, sf):
    """Customers as frames and prices as counts: many medians fall between the unit ranges."""
    o = derived.table(spark, sf, "orders")
    raw = o.select(
        F.col("o_custkey").alias("frame_id"), F.lit(0).alias("row_idx"), F.col("o_orderkey").alias("col_idx"), (F.col("o_totalprice") / 20.0).alias("raw")
    )
    frames = o.select(F.col("o_custkey").alias("frame_id")).distinct().selectExpr(
        "frame_id", "map('note', 'raw') AS tags", "CAST(NULL AS DOUBLE) AS dataset_scale", "CAST(NULL AS DOUBLE) AS dataset_offset", "1 AS height", "1 AS width"
    )
    return tidy(radiometry.source_failures(radiometry.frame_encodings(raw, frames)))


@query(
    "calibration_validation",
    """WITH c AS (SELECT c_custkey AS calibration_id, c_acctbal / 9000 AS emissivity, c_acctbal / 100 AS distance_m, (c_custkey % 13) / 10.0::DOUBLE AS relative_humidity,
      c_acctbal / 8 AS reflected_temperature_c, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 7 END AS ambient_temperature_c FROM customer)
    SELECT calibration_id, array_to_string(list_filter([
      CASE WHEN emissivity < 0.1 OR emissivity > 1 THEN 'emissivity must be between 0.1 and 1.0' END,
      CASE WHEN distance_m <= 0 OR distance_m > 10000 THEN 'distance_m must be greater than 0' END,
      CASE WHEN relative_humidity < 0 OR relative_humidity > 1 THEN 'relative_humidity must be between 0.0 and 1.0' END,
      CASE WHEN reflected_temperature_c < -100 OR reflected_temperature_c > 1000 THEN 'reflected_temperature_c is outside supported bounds' END,
      CASE WHEN ambient_temperature_c < -100 OR ambient_temperature_c > 1000 THEN 'ambient_temperature_c is outside supported bounds' END], lambda x: x IS NOT NULL), '|') AS violations,
      array_to_string(list_filter([CASE WHEN distance_m < 1 OR distance_m > 25 THEN 'distance must be between 1 and 25 meters' END,
      CASE WHEN relative_humidity < 0.2 OR relative_humidity > 1 THEN 'humidity must be between 20% and 100%' END,
      CASE WHEN reflected_temperature_c < -40 OR reflected_temperature_c > 500 THEN 'reflected temperature must be between -40 and 500 °C' END], lambda x: x IS NOT NULL), '|') AS vendor_violations FROM c""",
)
def calibration_validation(spark, sf):
    c = derived.table(spark, sf, "customer").selectExpr(
        "c_custkey AS calibration_id",
        "c_acctbal / 9000 AS emissivity",
        "c_acctbal / 100 AS distance_m",
        "(c_custkey % 13) / 10.0D AS relative_humidity",
        "c_acctbal / 8 AS reflected_temperature_c",
        "IF(c_custkey % 3 = 0, c_acctbal / 7, NULL) AS ambient_temperature_c",
    )
    return tidy(radiometry.validate_calibration(c).select("calibration_id", "violations", "vendor_violations"))


def gate(spark, sf):
    return quality.quality_gate(quality.pixel_metrics(derived.pixels(spark, sf)), derived.frames(spark, sf))


GATE_SQL = f"""q0 AS (SELECT frame_id, count(*) AS total_pixels, count(temp_c) AS valid_pixels, min(temp_c) AS mn, max(temp_c) AS mx FROM pixels GROUP BY frame_id),
q1 AS (SELECT q0.*, (SELECT count(*) FROM pixels p WHERE p.frame_id = q0.frame_id AND temp_c = mn) AS at_min,
  (SELECT count(*) FROM pixels p WHERE p.frame_id = q0.frame_id AND temp_c = mx) AS at_max FROM q0),
gate AS (SELECT q1.*, greatest(at_min, at_max) / valid_pixels::DOUBLE AS ext, f.uncalibrated, f.capture_time,
  CASE WHEN f.uncalibrated THEN '{fv.Q_UNCALIBRATED}' ELSE '' END AS reasons,
  '{fv.Q_DEFAULT_EMISSIVITY}' || CASE WHEN f.capture_time IS NULL THEN '|{fv.Q_NO_TIMESTAMP}' ELSE '' END AS warnings
  FROM q1 JOIN frames f USING (frame_id))"""


@query(
    "quality_gate",
    with_tables(["pixels", "frames"], "").rstrip() + ",\n" + GATE_SQL
    + f""" SELECT frame_id, CASE WHEN reasons <> '' THEN 'rejected' ELSE 'pass_with_warnings' END AS status, reasons, warnings, 25 AS width, 20 AS height,
    total_pixels, valid_pixels, {r('valid_pixels / total_pixels::DOUBLE', 'valid_fraction', 6)}, {r('mn', 'minimum_c', 6)}, {r('mx', 'maximum_c', 6)},
    {r('mx - mn', 'dynamic_range_c', 6)}, {r('ext', 'extreme_value_fraction', 6)} FROM gate""",
)
def quality_gate(spark, sf):
    return tidy(gate(spark, sf), 6)


@query(
    "quality_gate_coverage",
    f"""WITH p AS (SELECT o_custkey AS frame_id, CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderkey % 50 = 0 THEN 5000 ELSE o_totalprice / 10000 END AS temp_c FROM orders),
    m AS (SELECT frame_id, count(*) AS total, count(temp_c) AS valid, min(temp_c) AS mn, max(temp_c) AS mx, count(*) FILTER (temp_c < -80 OR temp_c > 1000) AS bad FROM p GROUP BY frame_id),
    n AS (SELECT m.*, (SELECT greatest(count(*) FILTER (temp_c = mn), count(*) FILTER (temp_c = mx)) FROM p WHERE p.frame_id = m.frame_id) / nullif(valid, 0)::DOUBLE AS ext FROM m),
    o AS (SELECT *, array_to_string(list_filter([CASE WHEN valid = 0 THEN '{fv.Q_NO_SAMPLES}' END,
      CASE WHEN valid > 0 AND valid / total::DOUBLE < 0.7 THEN 'valid temperature coverage ' || printf('%.1f', round_even(valid * 100 / total::DOUBLE, 1)) || '% is below required 70%' END,
      CASE WHEN bad > 0 THEN bad || ' {fv.Q_IMPLAUSIBLE}' END], lambda x: x IS NOT NULL), '|') AS reasons,
      array_to_string(list_filter([CASE WHEN valid > 0 AND ext > 0.2 THEN '{fv.Q_CLIPPED}' END, CASE WHEN valid > 0 AND mx - mn < 0.05 THEN '{fv.Q_FLAT}' END,
      '{fv.Q_NO_CALIBRATION}', '{fv.Q_NOT_GEOREFERENCED}', '{fv.Q_NO_TIMESTAMP}'], lambda x: x IS NOT NULL), '|') AS warnings FROM n)
    SELECT frame_id, CASE WHEN reasons <> '' THEN 'rejected' ELSE 'pass_with_warnings' END AS status, reasons, warnings FROM o""",
)
def quality_gate_coverage(spark, sf):
    """Customers as frames: missing, implausible and clipped samples, no calibration, no place or time."""
    p = derived.table(spark, sf, "orders").selectExpr(
        "o_custkey AS frame_id",
        "CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderkey % 50 = 0 THEN 5000D ELSE o_totalprice / 10000 END AS temp_c",
        "1 AS height",
        "1 AS width",
    )
    frames = p.select("frame_id").distinct().selectExpr(
        "frame_id", "1 AS width", "1 AS height", "map('note', 'x') AS tags", "CAST(NULL AS STRING) AS crs",
        "CAST(NULL AS ARRAY<DOUBLE>) AS transform", "CAST(NULL AS STRING) AS capture_time",
    )
    return tidy(quality.quality_gate(quality.pixel_metrics(p), frames, None).select("frame_id", "status", "reasons", "warnings"))


@query(
    "tiled_quality_gate",
    with_tables(
        ["frames", "pixels"],
        f"""SELECT frame_id, 'pass_with_warnings' AS status, '' AS reasons, '{fv.Q_DEFAULT_EMISSIVITY}|{fv.Q_NO_TIMESTAMP}' AS warnings,
        {r('count(temp_c) / 500.0', 'valid_fraction', 6)} FROM frames JOIN pixels USING (frame_id) GROUP BY frame_id""",
    ),
)
def tiled_quality_gate(spark, sf):
    from emberfield.operators import statistics

    stats = statistics.raster_statistics(derived.pixels(spark, sf))
    return tidy(quality.tiled_quality_gate(stats, derived.frames(spark, sf)), 6)


@query(
    "source_probe",
    with_tables(
        ["pixels"],
        f"""SELECT frame_id, {r('min(temp_c)', 'sample_min')}, {r('max(temp_c)', 'sample_max')}, {r('median(temp_c)', 'sample_median')},
        count(*) FILTER (temp_c IS NULL) AS sample_masked, count(*) AS sample_pixels FROM pixels GROUP BY frame_id""",
    ),
)
def source_probe(spark, sf):
    return tidy(radiometry.probe_sources(derived.pixels(spark, sf)))


@query(
    "preview_shape",
    "SELECT p_partkey AS source_id, CAST(greatest(1, round_even(p_size * 70 * least(1.0, 1600 / greatest(p_size * 70, 900)::DOUBLE), 0)) AS BIGINT) AS preview_width, "
    "CAST(greatest(1, round_even(900 * least(1.0, 1600 / greatest(p_size * 70, 900)::DOUBLE), 0)) AS BIGINT) AS preview_height FROM part",
)
def preview_shape(spark, sf):
    p = derived.table(spark, sf, "part").selectExpr("p_partkey AS source_id", "p_size * 70 AS width", "900 AS height")
    return tidy(radiometry.preview_shape(p).select("source_id", "preview_width", "preview_height"))


@query(
    "point_probe",
    with_tables(
        ["pixels"],
        f"""SELECT c_custkey AS point_id, c.frame_id, x, y, {r('temp_c', 'temp_c')} FROM
        (SELECT c_custkey, c_custkey % 40 AS frame_id, c_nationkey + 2 AS x, c_custkey % 23 AS y FROM customer) c
        LEFT JOIN pixels p ON p.frame_id = c.frame_id AND p.col_idx = x AND p.row_idx = y""",
    ),
)
def point_probe(spark, sf):
    points = derived.table(spark, sf, "customer").selectExpr(
        "c_custkey AS point_id", "c_custkey % 40 AS frame_id", "c_nationkey + 2 AS x", "CAST(c_custkey % 23 AS INT) AS y"
    )
    return tidy(radiometry.probe_points(points, derived.pixels(spark, sf)).select("point_id", "frame_id", "x", "y", "temp_c"))


# ---- mission files -----------------------------------------------------------------------------

SUFFIXES = [".tif", ".TIFF", ".jpg", ".kml", ".txt", ".tfw", ".prj", ".tif", ".wld", ".csv"]
FOLDERS = ["solar_farm-A", "Roof__survey", "plain", "substation 4", "pump-house", "north orchard", "SITE", "wetland", "old--mill__race"]


def mission_paths(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("page_id") % len(SUFFIXES) + 1).cast("int"))
    p = derived.table(spark, sf, "pages")
    return p.select(
        (F.col("page_id") % len(FOLDERS)).alias("mission_id"),
        F.concat(
            F.lit("root/"), (F.col("page_id") % len(FOLDERS)).cast("string"), F.lit("/img_"),
            F.floor(F.col("page_id") / 30).cast("string"), ext,
        ).alias("path"),
        F.length("url").cast("long").alias("size_bytes"),
    )


PATHS_SQL = f"""paths AS (SELECT page_id % {len(FOLDERS)} AS mission_id, 'root/' || page_id % {len(FOLDERS)} || '/img_' || page_id // 30 ||
  [{', '.join("'" + s + "'" for s in SUFFIXES)}][1 + page_id % {len(SUFFIXES)}] AS path, length(url) AS size_bytes FROM pages),
mf AS (SELECT DISTINCT ON (mission_id, path) mission_id, path, size_bytes, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM paths ORDER BY mission_id, path, size_bytes),
ok AS (SELECT *, ext IN ('.tif', '.tiff', '.jpg', '.jpeg', '.png') AS is_image, ext IN ('.tif', '.tiff') AS is_analysis_source FROM mf
  WHERE ext IN ('.tif', '.tiff', '.jpg', '.jpeg', '.png', '.kml', '.kmz', '.geojson', '.json', '.csv', '.tfw', '.prj', '.srt'))"""


def mission_files(spark: SparkSession, sf: str) -> DataFrame:
    return files.classify_files(files.distinct_files(mission_paths(spark, sf)))


@query("mission_files", f"WITH {PATHS_SQL} SELECT mission_id, path, ext, is_image, is_analysis_source FROM ok")
def mission_files_query(spark, sf):
    return tidy(mission_files(spark, sf).drop("size_bytes"))


@query("distinct_mission_paths", "WITH " + PATHS_SQL + " SELECT mission_id, count(*) AS paths FROM mf GROUP BY mission_id")
def distinct_mission_paths(spark, sf):
    return tidy(files.distinct_files(mission_paths(spark, sf)).groupBy("mission_id").agg(F.count("*").alias("paths")))


@query("context_files", f"WITH {PATHS_SQL} SELECT mission_id, path FROM ok WHERE NOT is_analysis_source")
def context_files(spark, sf):
    f = mission_files(spark, sf)
    return tidy(files.context_files(f, f.where("is_analysis_source")).select("mission_id", "path"))


@query(
    "sidecar_resolution",
    f"""WITH {PATHS_SQL}, b AS (SELECT mission_id, path, regexp_replace(path, '\\.[^./]+$', '') AS base, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM paths GROUP BY ALL)
    SELECT a.mission_id, a.path, kind, arg_min(s.path, pr) AS sidecar FROM b a JOIN b s ON a.mission_id = s.mission_id AND a.base = s.base
    JOIN (VALUES ('world_file', '.tfw', 0), ('world_file', '.tifw', 1), ('world_file', '.wld', 2), ('projection', '.prj', 0), ('kml', '.kml', 0)) k(kind, kext, pr) ON s.ext = kext
    WHERE a.ext IN ('.tif', '.tiff') GROUP BY a.mission_id, a.path, kind""",
)
def sidecar_resolution(spark, sf):
    every = files.distinct_files(mission_paths(spark, sf)).withColumn("ext", files.suffix(F.col("path")))
    every = every.withColumn("is_analysis_source", F.col("ext").isin(fv.RASTER_SUFFIXES))
    return tidy(files.resolve_sidecars(every))


def _hint_sql() -> str:
    cases = []
    for profile, words in fv.PROFILE_HINTS:
        cases.append("WHEN " + " OR ".join(f"contains(hay, '{w}')" for w in words) + f" THEN '{profile}'")
    return "CASE " + " ".join(cases) + " ELSE 'generic-thermal' END"


@query(
    "profile_inference",
    f"""WITH {PATHS_SQL}, folders(mission_id, folder) AS (VALUES {', '.join(f"({i}, '{f}')" for i, f in enumerate(FOLDERS))}),
    nm AS (SELECT mission_id, string_agg(regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^./]+$', ''), '|') AS names FROM ok GROUP BY mission_id),
    h AS (SELECT f.*, ' ' || replace(replace(lower(concat_ws(' ', folder, names)), '_', ' '), '-', ' ') || ' ' AS hay FROM folders f LEFT JOIN nm USING (mission_id))
    SELECT mission_id, trim(regexp_replace(regexp_replace(folder, '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS project_name, {_hint_sql()} AS profile_id,
      (SELECT count(*) FROM ok WHERE ok.mission_id = h.mission_id) AS files, (SELECT count(*) FROM ok WHERE ok.mission_id = h.mission_id AND is_image) AS images,
      (SELECT count(*) FROM ok WHERE ok.mission_id = h.mission_id AND is_analysis_source) AS analysis_sources,
      EXISTS (SELECT 1 FROM ok WHERE ok.mission_id = h.mission_id AND is_analysis_source) AS ready FROM h""",
)
def profile_inference(spark, sf):
    roots = spark.createDataFrame(list(enumerate(FOLDERS)), "mission_id long, folder string")
    return tidy(files.mission_intake(mission_files(spark, sf), roots).drop("total_bytes"))


@query(
    "world_files",
    with_tables(
        ["frames"],
        f"""SELECT frame_id, frame_id % 5 <> 4 AS valid, {r('CASE WHEN frame_id % 5 <> 4 THEN 0.00001 END', 'x_pixel_size', 8)},
        {r('CASE WHEN frame_id % 5 <> 4 THEN origin_x END', 'x_center', 8)}, {r('CASE WHEN frame_id % 5 <> 4 THEN 28.0::DOUBLE END', 'y_center', 8)},
        {r('CASE WHEN frame_id % 5 <> 4 THEN origin_x + 3 * 0.00001::DOUBLE END', 'map_x', 8)} FROM frames""",
    ),
)
def world_files(spark, sf):
    """World files are written from the frame table, one per frame, and read back as text."""
    from emberfield.functions.geo import world_file_to_map
    from emberfield.sources import sinks

    root = scratch(spark, "world")
    t = F.col("transform")
    lines = F.array(t[0], t[3], t[1], t[4], t[2], t[5])
    text = F.array_join(F.transform(F.slice(lines, 1, F.when(F.col("frame_id") % 5 == 4, 5).otherwise(6)), lambda x: F.format_string("%.8f", x)), "\n")
    sinks.write_files(derived.frames(spark, sf).select(sinks.source_file("world", "frame_id", ".tfw").alias("file"), text.alias("value")), root)
    got = files.read_world_files(spark, f"{root}/world/*")
    mx, _ = world_file_to_map(F.lit(3.0), F.lit(2.0), F.col("world"))
    return tidy(
        got.select(
            F.regexp_extract("file", r"frame_id=(\d+)", 1).cast("long").alias("frame_id"),
            F.col("error").isNull().alias("valid"),
            F.col("world.x_pixel_size"),
            F.col("world.x_center"),
            F.col("world.y_center"),
            mx.alias("map_x"),
        ),
        8,
    )


@query(
    "kml_bounds",
    with_tables(
        ["observations"],
        f"""SELECT obs_ord % 13 AS bucket, count(*) AS placemarks, {r('max(latitude) + 0.001', 'north', 6)}, {r('min(latitude) - 0.001', 'south', 6)},
        {r('max(longitude) + 0.001', 'east', 6)}, {r('min(longitude) - 0.001', 'west', 6)} FROM observations WHERE latitude IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""",
    ),
)
def kml_bounds(spark, sf):
    """Placemarks of the observations are written as KML and their bounds inferred from the files."""
    from emberfield.sources import sinks

    root = scratch(spark, "kml")
    o = derived.observations(spark, sf).withColumns({"finding_id": F.col("obs_ord").cast("string"), "severity": F.lit("minor")})
    marks = sinks.placemarks(o.withColumn("bucket", F.col("obs_ord") % 13))
    marks = marks.withColumn("bucket", F.col("name").cast("long") % 13)
    sinks.write_kml(marks.repartition("bucket"), root, "bucket")
    bounds = files.placemark_bounds(files.read_placemarks(spark, root + "/bucket=*/*.xml"))
    return tidy(
        bounds.withColumn("bucket", F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long")).drop("file"), 6
    )


@query(
    "findings_document_read",
    """SELECT event_type AS finding_id, 'Thermal anomaly' AS classification, CASE WHEN event_id % 4 = 0 THEN 'minor' ELSE 'critical' END AS severity,
    'medium' AS confidence, 'pass' AS quality_status, 'new' AS lifecycle_status, event_id AS area_px FROM events""",
)
def findings_document_read(spark, sf):
    """Documents with a ``findings`` list, written one per event with missing states, then read back."""
    root = scratch(spark, "documents")
    e = derived.table(spark, sf, "events")
    one = F.struct(
        F.col("event_type").alias("finding_id"),
        F.when(F.col("event_id") % 4 != 0, "critical").alias("severity"),
        F.col("event_id").alias("area_px"),
    )
    e.select(F.array(one).alias("findings")).write.json(root)
    got = files.read_findings(spark, root, multi_line=False)
    return tidy(got.select("finding_id", "classification", "severity", "confidence", "quality_status", "lifecycle_status", "area_px"))
