"""Column expressions shared by the operators. Everything here stays inside JVM codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberfield import fixed_values as fv


def clean_number(value: Column) -> Column:
    """NaN and infinities become NULL, the only nodata marker the engine knows."""
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(None)).otherwise(value).cast("double")


def fahrenheit(celsius: Column) -> Column:
    return clean_number(celsius) * 9.0 / 5.0 + 32.0


def flag(condition: Column) -> Column:
    """A NULL condition counts as false."""
    return F.coalesce(condition, F.lit(False))


def first_of(*pairs: tuple[Column, str]) -> Column:
    """An ordered decision: the value of the first true condition, else NULL."""
    branch = F
    for condition, value in pairs:
        branch = branch.when(condition, F.lit(value))
    return branch


def present(*pairs: tuple[Column, Column | str]) -> Column:
    """ARRAY of the texts whose condition holds, in the given order."""
    texts = [F.when(flag(c), F.lit(t) if isinstance(t, str) else t) for c, t in pairs]
    return F.array_compact(F.array(*texts))


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def signed(value: Column, digits: int) -> Column:
    return F.format_string(f"%+.{digits}f", F.bround(value, digits))


def greatest_of(values: list[Column]) -> Column:
    return values[0] if len(values) == 1 else F.greatest(*values)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; NULL as soon as one coordinate is NULL."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    bounded = F.when(h > 1.0, F.lit(1.0)).otherwise(h)
    return F.lit(2 * fv.EARTH_RADIUS_M) * F.asin(F.sqrt(bounded))


def seconds_apart(left: Column, right: Column) -> Column:
    """Absolute seconds between two ISO texts or timestamps; blank or invalid gives NULL."""
    a, b = (F.unix_micros(F.try_to_timestamp(c.cast("string"))) for c in (left, right))
    return F.abs(a - b) / 1e6


def severity(delta: Column, moderate: Column | float, critical: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(delta >= lit(critical), "critical").when(delta >= lit(moderate), "moderate").otherwise("minor")


def check_severity_policy(moderate: float, critical: float) -> None:
    if not 0 < moderate < critical:
        raise ValueError("severity limits need 0 < moderate < critical")


def confidence(
    delta: Column,
    area: Column,
    support: Column,
    scales: int,
    fill: Column,
    robust: Column,
    touches_edge: Column,
    minimum_delta: float,
    minimum_area: int,
) -> tuple[Column, Column]:
    """(level, components): weighted evidence score and the parts that made it."""
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    contrast = F.least(F.lit(1.0), delta / max(2.0 * minimum_delta, 0.1))
    region = F.least(F.lit(1.0), area / max(2.0 * minimum_area, 1.0))
    persistence = support / float(max(scales, 1))
    coherence = unit(fill)
    scene = unit(robust / 6.0)
    penalty = F.when(touches_edge, 0.15).otherwise(0.0)
    score = 0.35 * contrast + 0.20 * region + 0.20 * persistence + 0.15 * coherence + 0.10 * scene - penalty
    level = F.when(score >= 0.75, "high").when(score >= 0.50, "medium").otherwise("low")
    parts = F.struct(
        F.bround(score, 4).alias("internal_score"),
        F.bround(contrast, 4).alias("thermal_contrast"),
        F.bround(region, 4).alias("region_support"),
        F.bround(persistence, 4).alias("scale_persistence"),
        F.bround(coherence, 4).alias("spatial_coherence"),
        F.bround(scene, 4).alias("robust_scene_support"),
        touches_edge.alias("touches_edge"),
    )
    return level, parts


def text_lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """CASE over a fixed table; keeps the look-up inside codegen instead of a join."""
    branch = F
    for name, value in table.items():
        branch = branch.when(key == name, F.lit(value))
    return branch if default is None else branch.otherwise(default)
