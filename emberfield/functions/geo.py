"""Geospatial column expressions: affine transforms, CRS checks, UTM ↔ WGS84, KML boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import fixed_values as fv


def pixel_to_map(x: Column, y: Column, transform: Column, center: bool = True) -> tuple[Column, Column]:
    half = 0.5 if center else 0.0
    px, py = x + half, y + half
    a, b, c, d, e, f = (transform[i] for i in range(6))
    return a * px + b * py + c, d * px + e * py + f


def map_to_pixel(mx: Column, my: Column, transform: Column) -> tuple[Column, Column]:
    """Inverse affine; NULL when the matrix is not invertible."""
    a, b, c, d, e, f = (transform[i] for i in range(6))
    determinant = a * e - b * d
    det = F.when(F.abs(determinant) >= 1e-15, determinant)
    x, y = mx - c, my - f
    return (e * x - b * y) / det, (a * y - d * x) / det


def world_file_to_map(x: Column, y: Column, w: Column) -> tuple[Column, Column]:
    """``w`` is the world-file struct; pixel centres need no half-pixel shift."""
    return (
        w["x_center"] + x * w["x_pixel_size"] + y * w["x_rotation"],
        w["y_center"] + x * w["y_rotation"] + y * w["y_pixel_size"],
    )


def _plain(crs: Column) -> Column:
    return F.replace(F.upper(crs), F.lit(" "), F.lit(""))


def crs_warning(crs: Column) -> Column:
    """NULL when the CRS text is not suspicious."""
    text = _plain(crs)
    feet = text.contains("FTUS") | text.contains("USFOOT") | text.contains("FOOT_US")
    metre = text.contains('UNIT["METRE",1') | text.contains('LENGTHUNIT["METRE",1')
    local = text.contains("LOCAL_CS") | text.contains("LOCALCRS")
    return F.when(feet & metre, fv.CRS_FOOT_WARNING).when(local, fv.CRS_LOCAL_WARNING)


# Published WGS84 ellipsoid and transverse-Mercator series (Krüger, third flattening n, order 4).
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_K0, _EASTING, _NORTHING = 0.9996, 500000.0, 10000000.0
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_DELTA = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]


def _utm_zone(text: Column) -> Column:
    return F.regexp_extract(text, r"^EPSG:32[67](0[1-9]|[1-5][0-9]|60)$", 1).try_cast("int")


def _central_meridian(text: Column) -> Column:
    return F.radians(F.lit(6) * _utm_zone(text) - 183)


def utm_to_wgs84(x: Column, y: Column, crs: Column) -> tuple[Column, Column]:
    """(lon, lat) of a UTM coordinate; NULL for a CRS that is not UTM on WGS84."""
    text = _plain(crs)
    south = text.startswith("EPSG:327")
    xi = (y - F.when(south, _NORTHING).otherwise(0.0)) / (_K0 * _RADIUS)
    eta = (x - _EASTING) / (_K0 * _RADIUS)
    xi1, eta1 = xi, eta
    for j, beta in enumerate(_BETA, 1):
        xi1 = xi1 - beta * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - beta * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, delta in enumerate(_DELTA, 1):
        lat = lat + delta * F.sin(2 * j * chi)
    lon = _central_meridian(text) + F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.degrees(lon), F.degrees(lat)


def wgs84_to_utm(lon: Column, lat: Column, crs: Column) -> tuple[Column, Column]:
    text = _plain(crs)
    south = text.startswith("EPSG:327")
    phi, lam = F.radians(lat), F.radians(lon) - _central_meridian(text)
    ratio = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - ratio * F.atanh(ratio * F.sin(phi)))
    xi1 = F.atan2(t, F.cos(lam))
    eta1 = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    xi, eta = xi1, eta1
    for j, alpha in enumerate(_ALPHA, 1):
        xi = xi + alpha * F.sin(2 * j * xi1) * F.cosh(2 * j * eta1)
        eta = eta + alpha * F.cos(2 * j * xi1) * F.sinh(2 * j * eta1)
    easting = _EASTING + _K0 * _RADIUS * eta
    northing = F.when(south, _NORTHING).otherwise(0.0) + _K0 * _RADIUS * xi
    return easting, northing


def _is_wgs84(crs: Column) -> Column:
    return _plain(crs).isin("EPSG:4326", "WGS84", "WGS1984")


def to_wgs84(x: Column, y: Column, crs: Column) -> tuple[Column, Column]:
    """(lon, lat); blocked, unsupported or implausible input gives NULL, never a guess."""
    lon_u, lat_u = utm_to_wgs84(x, y, crs)
    lon = F.when(_is_wgs84(crs), x).otherwise(lon_u)
    lat = F.when(_is_wgs84(crs), y).otherwise(lat_u)
    sane = crs_warning(crs).isNull() & (
        _is_wgs84(crs) | (lon.between(-180, 180) & lat.between(-90, 90))
    )
    return F.when(sane, lon), F.when(sane, lat)


def from_wgs84(lon: Column, lat: Column, crs: Column) -> tuple[Column, Column]:
    x_u, y_u = wgs84_to_utm(lon, lat, crs)
    ok = crs_warning(crs).isNull()
    return F.when(ok & _is_wgs84(crs), lon).when(ok, x_u), F.when(ok & _is_wgs84(crs), lat).when(ok, y_u)


def transform_note(x: Column, y: Column, crs: Column) -> Column:
    """Why a coordinate could not be placed; NULL when it was."""
    lon, _ = to_wgs84(x, y, crs)
    warning = crs_warning(crs)
    return F.when(warning.isNotNull(), F.concat(F.lit("coordinate transform blocked: "), warning)).when(
        lon.isNull(), "coordinate reference system is not supported"
    )


def _box_ranges(box: Column) -> tuple[Column, Column]:
    """(longitude range, latitude range), both NULL when either is zero."""
    lon, lat = box["east"] - box["west"], box["north"] - box["south"]
    usable = (lon != 0) & (lat != 0)
    return F.when(usable, lon), F.when(usable, lat)


def box_to_pixel(lat: Column, lon: Column, box: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """lat/lon in a KML box to pixel, clamped into the image; NULL for a zero-range box."""
    lon_range, lat_range = _box_ranges(box)
    clamp = lambda v, n: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), v)))
    return clamp((lon - box["west"]) / lon_range * width, width), clamp((box["north"] - lat) / lat_range * height, height)


def box_to_latlon(x: Column, y: Column, box: Column, width: Column, height: Column) -> tuple[Column, Column]:
    lon_range, lat_range = _box_ranges(box)
    return box["north"] - y / height * lat_range, box["west"] + x / width * lon_range


def box_area_m2(area: Column, lat: Column, box: Column, width: Column, height: Column) -> Column:
    """F15 on a KML box."""
    per_lon = (box["east"] - box["west"]) / width * fv.METERS_PER_DEGREE * F.cos(F.radians(lat))
    per_lat = (box["north"] - box["south"]) / height * fv.METERS_PER_DEGREE
    return area * per_lon * per_lat


def world_area_m2(area: Column, w: Column) -> Column:
    """F15 on a world file in US survey feet."""
    return area * (w["x_pixel_size"] * F.abs(w["y_pixel_size"])) * (fv.US_FOOT_M**2)


def frame_bounds(frames: DataFrame) -> DataFrame:
    """Size, resolution and map bounds from the affine corners."""
    t = F.col("transform")
    zero = F.lit(0.0)
    corners = [
        pixel_to_map(x, y, t, center=False)
        for x in (zero, F.col("width").cast("double"))
        for y in (zero, F.col("height").cast("double"))
    ]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return frames.select(
        "frame_id",
        "width",
        "height",
        "band_count",
        "crs",
        F.sqrt(t[0] * t[0] + t[3] * t[3]).alias("resolution_x"),
        F.sqrt(t[1] * t[1] + t[4] * t[4]).alias("resolution_y"),
        F.least(*xs).alias("bound_left"),
        F.least(*ys).alias("bound_bottom"),
        F.greatest(*xs).alias("bound_right"),
        F.greatest(*ys).alias("bound_top"),
    )


def georeference(findings: DataFrame, frames: DataFrame) -> DataFrame:
    """Centre pixel → map → WGS84. A blocked frame keeps NULL coordinates for all its findings."""
    placed = findings.drop("latitude", "longitude", "georeferencing_status").join(
        frames.select("frame_id", "crs", "transform"), "frame_id", "left"
    )
    mx, my = pixel_to_map(F.col("center_x"), F.col("center_y"), F.col("transform"))
    placed = placed.withColumns({"map_x": mx, "map_y": my})
    lon, lat = to_wgs84(F.col("map_x"), F.col("map_y"), F.col("crs"))
    return placed.withColumns({"longitude": lon, "latitude": lat}).withColumn(
        "georeferencing_status", F.when(F.col("longitude").isNotNull(), "assigned").otherwise("not_authoritative")
    ).drop("map_x", "map_y", "crs", "transform")


def display_points(findings: DataFrame, displays: DataFrame) -> DataFrame:
    """geolocated findings on a preview; rows outside it or without authority are dropped.

    ``displays``: ``frame_id, crs, transform, source_width, source_height, preview_width, preview_height``.
    """
    d = findings.where("latitude IS NOT NULL AND longitude IS NOT NULL").join(displays, "frame_id")
    mx, my = from_wgs84(F.col("longitude"), F.col("latitude"), F.col("crs"))
    d = d.withColumns({"mx": mx, "my": my})
    sx, sy = map_to_pixel(F.col("mx"), F.col("my"), F.col("transform"))
    d = d.withColumns(
        {
            "x": sx * F.col("preview_width") / F.col("source_width"),
            "y": sy * F.col("preview_height") / F.col("source_height"),
        }
    )
    return d.where("x >= 0 AND x < preview_width AND y >= 0 AND y < preview_height").select(
        "frame_id", "finding_id", "x", "y", "severity"
    )


def scaled_geometry(findings: DataFrame) -> DataFrame:
    """F19 annotation box: bbox (or ±8 px around the centre) scaled to the display and clamped."""
    sx = F.col("display_width") / F.greatest(F.col("source_width"), F.lit(1))
    sy = F.col("display_height") / F.greatest(F.col("source_height"), F.lit(1))
    zero = F.lit(0)
    source = {
        "left": (F.coalesce("bbox_left", F.greatest(zero, F.col("center_x") - 8)), sx, "display_width"),
        "top": (F.coalesce("bbox_top", F.greatest(zero, F.col("center_y") - 8)), sy, "display_height"),
        "right": (F.coalesce("bbox_right", F.col("center_x") + 8), sx, "display_width"),
        "bottom": (F.coalesce("bbox_bottom", F.col("center_y") + 8), sy, "display_height"),
    }
    box = {
        f"box_{name}": F.greatest(zero, F.least(F.col(limit) - 1, F.rint(value * scale).cast("int")))
        for name, (value, scale, limit) in source.items()
    }
    spot = {
        "mark_x": F.rint(F.coalesce("hotspot_x", "center_x") * sx).cast("int"),
        "mark_y": F.rint(F.coalesce("hotspot_y", "center_y") * sy).cast("int"),
    }
    return findings.withColumns({**box, **spot})


def crop_window(boxed: DataFrame) -> DataFrame:
    """crop limits (exclusive right/bottom) around a scaled box."""
    longest = F.greatest(F.col("box_right") - F.col("box_left"), F.col("box_bottom") - F.col("box_top"))
    boxed = boxed.withColumn("margin", F.greatest(F.lit(12), F.floor(longest * 0.5).cast("int")))
    return boxed.withColumns(
        {
            "crop_left": F.greatest(F.lit(0), F.col("box_left") - F.col("margin")),
            "crop_top": F.greatest(F.lit(0), F.col("box_top") - F.col("margin")),
            "crop_right": F.least(F.col("display_width"), F.col("box_right") + F.col("margin") + 1),
            "crop_bottom": F.least(F.col("display_height"), F.col("box_bottom") + F.col("margin") + 1),
        }
    )
