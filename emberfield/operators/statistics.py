"""Frame statistics with exact percentiles that stay safe for groups of any size.

Groups known to be small use Spark's built-in exact percentile. A giant group would put all its
values into one aggregation buffer, so it goes through ``binned_quantiles``: order-preserving bins
are counted with map-side combine, only the bins holding a wanted rank are opened again, and the
last step ranks the distinct values of a very thin bin. Both give the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.operators.sheets import KEYS
from emberfield.session import cut_lineage

#: Values of one group that a single aggregation buffer may hold; above it the binned route, with the same result.
GIANT_GROUP = 65_536
BIN_LEVELS = (256, 2**20)


def _bin(value: Column, resolution: int) -> Column:
    """Monotone, scale-free bin number; needs no minimum or maximum beforehand."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(float(resolution)))


def is_giant(limit: int = GIANT_GROUP, height: str = "height", width: str = "width") -> Column:
    """Row-local size test. The OR of single-column bounds is implied and can reach Parquet statistics."""
    side = math.isqrt(limit)
    h, w = F.col(height), F.col(width)
    return ((h > side) | (w > side)) & (h.cast("long") * w > limit)


def any_giant(sheets: DataFrame, limit: int = GIANT_GROUP) -> bool:
    """Whether the second route is needed at all; extent statistics answer it without reading pixels."""
    return sheets.where(is_giant(limit)).limit(1).count() > 0


def giant_route(sheets: DataFrame, limit: int = GIANT_GROUP) -> Column | None:
    """The row test for groups that need the second route, or None where there is none."""
    return is_giant(limit) if any_giant(sheets, limit) else None


def binned_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact interpolated quantiles: ``keys, q ARRAY<DOUBLE>``, no group ever sits in one task."""
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    positions = [F.col("n_all") * p - p for p in probs]
    ranks = F.array_distinct(
        F.array(*[f(p).cast("long") for p in positions for f in (F.floor, F.ceil)])
    )
    path = list(keys)
    wanted = None
    for level, resolution in enumerate(BIN_LEVELS):
        bin_col = f"bin_{level}"
        if wanted is not None:
            values = values.join(wanted.select(*path).distinct(), path)
        values = values.withColumn(bin_col, _bin(F.col("v"), resolution))
        counts = values.groupBy(*path, bin_col).agg(F.count("*").alias("c"))
        inner = Window.partitionBy(*path)
        counts = counts.withColumn("before", F.sum("c").over(inner.orderBy(bin_col)) - F.col("c"))
        if wanted is None:
            wanted = counts.withColumn("n_all", F.sum("c").over(inner)).withColumn("rank", F.explode(ranks))
            wanted = wanted.withColumn("offset", F.col("rank"))
        else:
            wanted = counts.join(wanted, path)
        wanted = wanted.where((F.col("offset") >= F.col("before")) & (F.col("offset") < F.col("before") + F.col("c")))
        path = [*path, bin_col]
        # a few rows per group: kept, so the next pass neither recounts this level nor shuffles for it
        wanted = cut_lineage(
            wanted.select(*path, "n_all", "rank", (F.col("offset") - F.col("before")).alias("offset"))
        )
    thin = values.join(wanted.select(*path).distinct(), path).groupBy(*path, "v").agg(F.count("*").alias("c"))
    thin = thin.withColumn("before", F.sum("c").over(Window.partitionBy(*path).orderBy("v")) - F.col("c"))
    hits = thin.join(wanted, path).where(
        (F.col("offset") >= F.col("before")) & (F.col("offset") < F.col("before") + F.col("c"))
    )
    found = hits.groupBy(*keys).agg(
        F.map_from_entries(F.collect_set(F.struct("rank", "v"))).alias("at"), F.max("n_all").alias("n_all")
    )

    def pick(position: Column) -> Column:
        low = F.col("at")[F.floor(position).cast("long")]
        high = F.col("at")[F.ceil(position).cast("long")]
        return low + (high - low) * (position - F.floor(position))

    return found.select(*keys, F.array(*[pick(p) for p in positions]).alias("q"))


def summarize(
    df: DataFrame,
    keys: list[str],
    value: str = "temp_c",
    giant: Column | None = None,
) -> DataFrame:
    """Seven statistics per group. Groups without a finite value are absent (they are failures)."""
    valid = df.where(F.col(value).isNotNull())
    v = F.col(value)
    basics = [
        F.min(v).alias("minimum_c"),
        F.max(v).alias("maximum_c"),
        F.avg(v).alias("mean_c"),
        F.stddev_pop(v).alias("stddev_c"),
        F.count(v).alias("valid_pixels"),
    ]
    order = [*keys, "minimum_c", "maximum_c", "mean_c", "median_c", "stddev_c", "p95_c", "valid_pixels"]
    quantiles = lambda d: d.withColumns({"median_c": F.col("q")[0], "p95_c": F.col("q")[1]})
    small = valid if giant is None else valid.where(~giant)
    exact = small.groupBy(*keys).agg(*basics, F.percentile(v, F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    result = quantiles(exact).select(*order)
    if giant is not None:
        large = valid.where(giant)
        wide = large.groupBy(*keys).agg(*basics).join(binned_quantiles(large, keys, value, [0.5, 0.95]), keys)
        result = result.unionByName(quantiles(wide).select(*order))
    return result


def frame_statistics(sheets: DataFrame, limit: int = GIANT_GROUP) -> DataFrame:
    """A1 over sheets; the size test is the sheet extent, so no count is needed first."""
    return summarize(sheets, KEYS, giant=giant_route(sheets, limit))


def failed_frames(sheets: DataFrame) -> DataFrame:
    """Sheets without any finite sample."""
    return (
        sheets.groupBy(*KEYS)
        .agg(F.count("temp_c").alias("valid_pixels"))
        .where("valid_pixels = 0")
        .select(*KEYS, F.lit("ValueError").alias("error_type"), F.lit("temperature array contains no finite values").alias("error"))
    )


def _scene_columns(median: Column, mad: Column, std: Column, p90: Column) -> dict[str, Column]:
    return {
        "scene_median_c": median,
        "scene_mad_c": mad,
        "scene_scale_c": F.greatest(mad * 1.4826, std * 0.25, F.lit(0.25)),
        "scene_p90_c": p90,
    }


def scene_statistics(sheets: DataFrame, limit: int = GIANT_GROUP) -> DataFrame:
    """A3: median, MAD, robust scale and p90 per sheet, plus extent and valid count.

    Sheets within ``limit`` pixels carry their values in one bounded array, so median, p90 and MAD
    come from a single shuffle. Larger sheets use the binned quantiles, MAD in a second pass.
    """
    base = [
        F.max("height").alias("height"),
        F.max("width").alias("width"),
        F.count("temp_c").alias("valid_pixels"),
        F.stddev_pop("temp_c").alias("std"),
    ]
    out = [*KEYS, "height", "width", "valid_pixels", "scene_median_c", "scene_mad_c", "scene_scale_c", "scene_p90_c"]

    def at(values: str, p: float) -> Column:
        n = F.size(F.col(values))
        position = (n - 1) * F.lit(p)
        low = F.floor(position).cast("int")
        high = F.ceil(position).cast("int")
        a, b = F.get(F.col(values), low), F.get(F.col(values), high)
        return a + (b - a) * (position - low)

    mixed = any_giant(sheets, limit)
    small = (
        (sheets.where(~is_giant(limit)) if mixed else sheets)
        .groupBy(*KEYS)
        .agg(*base, F.sort_array(F.collect_list("temp_c")).alias("sorted"))
        .withColumn("med", at("sorted", 0.5))
        .withColumn("dev", F.sort_array(F.transform("sorted", lambda x: F.abs(x - F.col("med")))))
        .withColumns(_scene_columns(F.col("med"), at("dev", 0.5), F.col("std"), at("sorted", 0.9)))
        .select(*out)
    )
    if not mixed:
        return small
    giants = sheets.where(is_giant(limit))
    middle = cut_lineage(binned_quantiles(giants, KEYS, "temp_c", [0.5, 0.9]))
    spread = giants.join(middle, KEYS).withColumn("d", F.abs(F.col("temp_c") - F.col("q")[0]))
    mad = binned_quantiles(spread, KEYS, "d", [0.5]).withColumnRenamed("q", "m")
    large = (
        giants.groupBy(*KEYS)
        .agg(*base)
        .join(middle, KEYS)
        .join(mad, KEYS)
        .withColumns(_scene_columns(F.col("q")[0], F.col("m")[0], F.col("std"), F.col("q")[1]))
        .select(*out)
    )
    return small.unionByName(large)


def raster_statistics(pixels: DataFrame, limit: int = GIANT_GROUP) -> DataFrame:
    """A2: exact statistics of every frame at any size, in the columns of the tiled route's report.

    All finite pixels count, so ``sample_size`` is their number and nothing is marked as sampled.
    """
    stats = summarize(pixels, ["frame_id"], giant=giant_route(pixels, limit))
    return stats.withColumns({"sample_size": F.col("valid_pixels"), "percentiles_sampled": F.lit(False)})


def inspection_statistics(frame_stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A5: valid-pixel-weighted roll-up. The weighted median and p95 are summaries, not quantiles."""
    weight = F.col("valid_pixels")
    weighted = lambda name: (F.sum(F.col(name) * weight) / F.sum(weight)).alias("weighted_" + name)
    return frame_stats.groupBy(*(keys or [])).agg(
        F.min("minimum_c").alias("minimum_c"),
        F.max("maximum_c").alias("maximum_c"),
        weighted("mean_c"),
        weighted("median_c"),
        weighted("stddev_c"),
        weighted("p95_c"),
        F.sum(weight).alias("valid_pixels"),
    )
