"""Queries on coordinates: affine, CRS, UTM, KML boxes, distances, display projection, mosaic."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.functions import columns, geo
from emberfield.operators import mosaic, radiometry
from emberfield.plans.catalog import query, tidy
from emberfield.plans.detector import run
from emberfield.plans.sql import r, with_tables
from emberfield.sources import derived


@query(
    "frame_bounds",
    with_tables(
        ["frames"],
        f"""SELECT frame_id, width, height, 1 AS band_count, 'EPSG:4326' AS crs, {r('0.00001', 'resolution_x', 8)}, {r('0.00001', 'resolution_y', 8)},
        {r('origin_x', 'bound_left', 8)}, {r('28.0 - 20 * 0.00001', 'bound_bottom', 8)}, {r('origin_x + 25 * 0.00001', 'bound_right', 8)}, {r('28.0::DOUBLE', 'bound_top', 8)} FROM frames""",
    ),
)
def frame_bounds(spark, sf):
    return tidy(geo.frame_bounds(derived.frames(spark, sf)), 8)


@query(
    "affine_round_trip",
    with_tables(
        ["pixels", "frames"],
        f"""SELECT frame_id, row_idx, col_idx, {r('origin_x + (col_idx + 0.5) * 0.00001', 'map_x', 8)}, {r('28.0 - (row_idx + 0.5) * 0.00001', 'map_y', 8)},
        {r('col_idx + 0.5', 'back_x')}, {r('row_idx + 0.5', 'back_y')} FROM pixels JOIN frames USING (frame_id)""",
    ),
)
def affine_round_trip(spark, sf):
    p = derived.pixels(spark, sf).drop("height", "width").join(derived.frames(spark, sf).select("frame_id", "transform"), "frame_id")
    mx, my = geo.pixel_to_map(F.col("col_idx"), F.col("row_idx"), F.col("transform"))
    p = p.withColumns({"map_x": mx, "map_y": my})
    bx, by = geo.map_to_pixel(F.col("map_x"), F.col("map_y"), F.col("transform"))
    out = p.withColumns({"map_x": F.round("map_x", 8), "map_y": F.round("map_y", 8), "back_x": F.round(bx, 4), "back_y": F.round(by, 4)})
    return tidy(out.select("frame_id", "row_idx", "col_idx", "map_x", "map_y", "back_x", "back_y"), 8)


CRS_TEXTS = [
    "EPSG:4326",
    "wgs 84",
    'PROJCS["x ftUS",UNIT["metre",1]]',
    'LOCAL_CS["grid",UNIT["metre",1]]',
    "EPSG:32617",
    'LOCALCRS["a"]',
    'PROJCS["US survey foot",UNIT["US survey foot",0.3048]]',
]


@query(
    "crs_warnings",
    f"""WITH c AS (SELECT p_partkey AS source_id, [{', '.join("'" + t + "'" for t in CRS_TEXTS)}][1 + p_partkey % {len(CRS_TEXTS)}] AS crs FROM part),
    n AS (SELECT *, replace(upper(crs), ' ', '') AS u FROM c)
    SELECT source_id, crs, CASE WHEN (u LIKE '%FTUS%' OR u LIKE '%USFOOT%' OR u LIKE '%FOOT\\_US%' ESCAPE '\\') AND u LIKE '%UNIT["METRE",1%' THEN '{fv.CRS_FOOT_WARNING}'
      WHEN u LIKE '%LOCAL\\_CS%' ESCAPE '\\' OR u LIKE '%LOCALCRS%' THEN '{fv.CRS_LOCAL_WARNING}' END AS warning FROM n""",
)
def crs_warnings(spark, sf):
    crs = F.element_at(F.array(*[F.lit(t) for t in CRS_TEXTS]), (F.col("p_partkey") % len(CRS_TEXTS) + 1).cast("int"))
    p = derived.table(spark, sf, "part").select(F.col("p_partkey").alias("source_id"), crs.alias("crs"))
    return tidy(p.withColumn("warning", geo.crs_warning(F.col("crs"))))


@query(
    "utm_round_trip",
    with_tables(
        ["observations"],
        f"SELECT obs_ord, {r('latitude', 'latitude', 7)}, {r('longitude', 'longitude', 7)}, true AS in_zone FROM observations WHERE latitude IS NOT NULL",
    ),
)
def utm_round_trip(spark, sf):
    """WGS84 → UTM 17N → WGS84 returns every coordinate."""
    o = derived.observations(spark, sf).where("latitude IS NOT NULL")
    crs = F.lit("EPSG:32617")
    x, y = geo.from_wgs84(F.col("longitude"), F.col("latitude"), crs)
    o = o.withColumns({"x": x, "y": y})
    lon, lat = geo.to_wgs84(F.col("x"), F.col("y"), crs)
    inside = F.col("x").between(100_000, 900_000) & F.col("y").between(3_000_000, 3_300_000)
    return tidy(o.select("obs_ord", lat.alias("latitude"), lon.alias("longitude"), inside.alias("in_zone")), 7)


@query(
    "haversine_distance",
    with_tables(
        ["observations"],
        f"""SELECT a.obs_ord, {r('''2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2)
          + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))''', 'distance_m', 3)}
        FROM observations a JOIN observations b ON b.obs_ord = a.obs_ord + 1""",
    ),
)
def haversine_distance(spark, sf):
    o = derived.observations(spark, sf).select("obs_ord", "latitude", "longitude")
    b = o.select((F.col("obs_ord") - 1).alias("obs_ord"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    d = columns.haversine_m(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2"))
    return tidy(o.join(b, "obs_ord").select("obs_ord", d.alias("distance_m")), 3)


@query(
    "time_difference",
    f"""SELECT event_id, {r('CASE WHEN event_id % 9 > 1 THEN (epoch_us(ts) - 1704067200000000) / 1e6 END', 'seconds', 6)} FROM events""",
)
def time_difference(spark, sf):
    """ISO texts with and without a zone mark, some blank or broken."""
    e = derived.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 9 == 0, "").when(F.col("event_id") % 9 == 1, "not a time").otherwise(
        F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    )
    return tidy(e.select("event_id", columns.seconds_apart(text, F.lit("2024-01-01T00:00:00Z")).alias("seconds")), 6)


BOX_SQL = """b AS (SELECT p_partkey AS source_id, p_size AS x, p_size % 17 AS y, 28.0 + p_size * 0.001::DOUBLE AS north, 28.0::DOUBLE AS south, -82.0::DOUBLE AS west,
  CASE WHEN p_partkey % 10 = 0 THEN -82.0 ELSE -82.0 + p_size * 0.002::DOUBLE END AS east, 40 AS width, 30 AS height FROM part)"""


@query(
    "kml_box_mapping",
    f"""WITH {BOX_SQL} SELECT source_id, {r('CASE WHEN east > west THEN north - y / 30.0 * (north - south) END', 'latitude', 8)}, {r('CASE WHEN east > west THEN west + x / 40.0 * (east - west) END', 'longitude', 8)},
    {r('CASE WHEN east > west AND north > south THEN greatest(0, least(39.0, (-81.99 - west) / (east - west) * 40)) END', 'pixel_x', 6)},
    {r('CASE WHEN east > west AND north > south THEN greatest(0, least(29.0, (north - 28.005) / (north - south) * 30)) END', 'pixel_y', 6)},
    {r('12 * ((east - west) / 40 * 111139 * cos(radians(28.01))) * ((north - south) / 30 * 111139)', 'area_m2', 4)} FROM b""",
)
def kml_box_mapping(spark, sf):
    p = derived.table(spark, sf, "part").selectExpr(
        "p_partkey AS source_id", "p_size AS x", "p_size % 17 AS y", "40 AS width", "30 AS height",
        "named_struct('north', 28.0D + p_size * 0.001D, 'south', 28.0D, 'west', -82.0D, 'east', IF(p_partkey % 10 = 0, -82.0D, -82.0D + p_size * 0.002D)) AS box",
    )
    b, w, h = F.col("box"), F.col("width"), F.col("height")
    lat, lon = geo.box_to_latlon(F.col("x"), F.col("y"), b, w, h)
    px, py = geo.box_to_pixel(F.lit(28.005), F.lit(-81.99), b, w, h)
    area = geo.box_area_m2(F.lit(12), F.lit(28.01), b, w, h)
    out = p.select(
        "source_id",
        lat.alias("latitude"),
        lon.alias("longitude"),
        F.round(px, 6).alias("pixel_x"),
        F.round(py, 6).alias("pixel_y"),
        F.round(area, 4).alias("area_m2"),
    )
    return tidy(out, 8)


@query(
    "georeferenced_findings",
    with_tables(
        ["regions", "frames"],
        f"""SELECT frame_id, finding_id, {r('origin_x + (cx + 0.5) * 0.00001', 'longitude', 8)}, {r('28.0 - (cy + 0.5) * 0.00001', 'latitude', 8)},
        'assigned' AS georeferencing_status FROM findings JOIN frames USING (frame_id)""",
    ),
)
def georeferenced_findings(spark, sf):
    g = geo.georeference(run(spark, sf).findings, derived.frames(spark, sf))
    return tidy(g.select("frame_id", "finding_id", "longitude", "latitude", "georeferencing_status"), 8)


@query(
    "display_points",
    with_tables(
        ["regions"],
        f"SELECT frame_id, finding_id, {r('(cx + 0.5) * 10 / 25.0', 'x')}, {r('(cy + 0.5) * 8 / 20.0', 'y')}, severity FROM findings",
    ),
)
def display_points(spark, sf):
    frames = derived.frames(spark, sf)
    shown = frames.select(
        "frame_id", "crs", "transform", F.col("width").alias("source_width"), F.col("height").alias("source_height"),
        F.lit(10).alias("preview_width"), F.lit(8).alias("preview_height"),
    )
    return tidy(geo.display_points(geo.georeference(run(spark, sf).findings, frames), shown))


@query(
    "crop_windows",
    with_tables(
        ["regions"],
        """SELECT frame_id, finding_id, bl AS box_left, bt AS box_top, br AS box_right, bb AS box_bottom, greatest(0, bl - m) AS crop_left, greatest(0, bt - m) AS crop_top,
        least(50, br + m + 1) AS crop_right, least(30, bb + m + 1) AS crop_bottom FROM
        (SELECT *, greatest(12, CAST(floor(greatest(br - bl, bb - bt) * 0.5) AS BIGINT)) AS m FROM
          (SELECT frame_id, finding_id, greatest(0, least(49, lft * 2)) AS bl, greatest(0, least(29, CAST(round_even(top * 1.5, 0) AS BIGINT))) AS bt,
            greatest(0, least(49, rgt * 2)) AS br, greatest(0, least(29, CAST(round_even(bottom * 1.5, 0) AS BIGINT))) AS bb FROM findings) a) b""",
    ),
)
def crop_windows(spark, sf):
    f = run(spark, sf).findings.withColumns(
        {"source_width": F.lit(25), "source_height": F.lit(20), "display_width": F.lit(50), "display_height": F.lit(30)}
    )
    boxed = geo.crop_window(geo.scaled_geometry(f))
    return tidy(
        boxed.select("frame_id", "finding_id", "box_left", "box_top", "box_right", "box_bottom", "crop_left", "crop_top", "crop_right", "crop_bottom")
    )


@query(
    "mosaic",
    with_tables(["pixels"], f"SELECT row_idx, frame_id * 25 + col_idx AS col_idx, {r('temp_c', 'temp_c')} FROM pixels"),
)
def mosaic_cells(spark, sf):
    return tidy(mosaic.mosaic_pixels(derived.pixels(spark, sf), derived.frames(spark, sf)).select("row_idx", "col_idx", "temp_c"))


@query(
    "mosaic_overlap",
    with_tables(
        ["pixels"],
        f"""SELECT row_idx, col AS col_idx, {r('arg_min(temp_c, frame_id) FILTER (temp_c IS NOT NULL)', 'temp_c')} FROM
        (SELECT row_idx, frame_id * 15 + col_idx AS col, frame_id, temp_c FROM pixels) p GROUP BY row_idx, col""",
    ),
)
def mosaic_overlap(spark, sf):
    """Frames shifted to overlap by ten columns: the earlier source wins, nodata lets the next one through."""
    frames = derived.frames(spark, sf).withColumn(
        "transform", F.expr("array(0.5D, 0D, frame_id * 7.5D, 0D, -0.5D, 100D)")
    )
    return tidy(mosaic.mosaic_pixels(derived.pixels(spark, sf), frames).select("row_idx", "col_idx", "temp_c"))


@query(
    "mosaic_mixed_resolution",
    with_tables(
        ["pixels"],
        f"""SELECT row_idx, col_idx, {r('any_value(temp_c)', 'temp_c')} FROM (
        SELECT g.row_idx, c.col_idx, p.temp_c FROM (SELECT unnest(range(40)) AS row_idx) g
        CROSS JOIN (SELECT unnest(range((SELECT max(60 * frame_id + CASE WHEN frame_id % 2 = 0 THEN 25 ELSE 50 END) FROM pixels))) AS col_idx) c
        LEFT JOIN pixels p ON p.frame_id = c.col_idx // 60 AND p.row_idx = g.row_idx // (1 + p.frame_id % 2) AND p.col_idx = (c.col_idx % 60) // (1 + p.frame_id % 2)) q
        GROUP BY row_idx, col_idx""",
    ),
)
def mosaic_mixed_resolution(spark, sf):
    """Every other frame has pixels of twice the size, and gaps lie between the frames."""
    frames = derived.frames(spark, sf).withColumn(
        "transform", F.expr("array(0.5D * (1 + frame_id % 2), 0D, frame_id * 30D, 0D, -0.5D * (1 + frame_id % 2), 100D)")
    )
    return tidy(mosaic.mosaic_pixels(derived.pixels(spark, sf), frames).select("row_idx", "col_idx", "temp_c"))


@query(
    "stitched_frames",
    with_tables(["pixels"], f"SELECT true AS stitched, count(*) AS cells, count(temp_c) AS valid, {r('max(temp_c)', 'maximum_c')} FROM pixels"),
)
def stitched_frames(spark, sf):
    """Sources under one contract are stitched on request."""
    frames = derived.frames(spark, sf).withColumn("tags", F.expr("map('THERMAL_UNIT', 'celsius')"))
    pixels = derived.pixels(spark, sf)
    enc = radiometry.frame_encodings(pixels.withColumn("raw", F.col("temp_c")), frames)
    cells, stitched, _ = mosaic.stitch_or_keep(pixels, frames, enc, "on")
    figures = cells.agg(F.count("*").alias("cells"), F.count("temp_c").alias("valid"), F.max("temp_c").alias("maximum_c"))
    return tidy(figures.withColumn("stitched", F.lit(stitched)))


@query(
    "mosaic_contract",
    with_tables(
        ["frames"],
        """SELECT count(*) AS source_count, false AS ok, 'non-radiometric mosaic source' AS error, 1 AS crs_values,
        count(DISTINCT CASE WHEN raw_counts THEN 'decikelvin' ELSE 'celsius' END) AS encodings FROM frames""",
    ),
)
def mosaic_contract(spark, sf):
    frames = derived.frames(spark, sf)
    c = mosaic.mosaic_contract(frames, radiometry.frame_encodings(derived.raw_pixels(spark, sf), frames))
    return tidy(c.select("source_count", "ok", "error", "crs_values", "encodings"))


@query(
    "mosaic_report",
    with_tables(
        ["pixels", "frames"],
        """SELECT 'dataframe-grid' AS backend, true AS quantitative, 'celsius' AS output_unit, count(DISTINCT frame_id) AS source_count, 1.0::DOUBLE AS scale,
        0.0::DOUBLE AS "offset", 'celsius' AS unit, 'EPSG:4326' AS crs, CAST(NULL AS DOUBLE) AS resolution, (max(frame_id) + 1) * 25 AS width, 20 AS height,
        count(*) AS covered_cells, count(temp_c) AS valid_cells FROM pixels JOIN frames USING (frame_id)""",
    ),
)
def mosaic_report(spark, sf):
    frames = derived.frames(spark, sf).withColumn("tags", F.expr("map('THERMAL_UNIT', 'celsius')"))
    pixels = derived.pixels(spark, sf)
    contract = mosaic.mosaic_contract(frames, radiometry.frame_encodings(pixels.withColumn("raw", F.col("temp_c")), frames))
    return tidy(mosaic.mosaic_report(contract, mosaic.mosaic_pixels(pixels, frames)))


@query(
    "stitch_decision",
    with_tables(["pixels"], "SELECT false AS stitched, true AS warned, count(*) AS pixels FROM pixels"),
)
def stitch_decision(spark, sf):
    """The uncalibrated frames break the contract, so automatic stitching falls back to the frames."""
    frames = derived.frames(spark, sf)
    enc = radiometry.frame_encodings(derived.raw_pixels(spark, sf), frames)
    kept, stitched, warnings = mosaic.stitch_or_keep(derived.pixels(spark, sf), frames, enc, "auto")
    return tidy(kept.agg(F.count("*").alias("pixels")).withColumns({"stitched": F.lit(stitched), "warned": F.lit(bool(warnings))}))
