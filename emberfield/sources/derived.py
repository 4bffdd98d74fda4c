"""Thermal tables derived by Spark from the given star-schema tables.

``orders`` is a dense key stream, so it serves as a pixel stream of 20×25 frames; ``events`` serves as
geolocated observations and media. Every table grows with its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEIGHT, WIDTH = 20, 25

PIXEL_TEMPERATURE = """CASE WHEN kind = 0 AND k % 97 = 0 THEN NULL
  ELSE CAST(25 + o_totalprice / 1000000.0
    + CASE WHEN kind = 0 AND row_idx BETWEEN 4 AND 8   AND col_idx BETWEEN 4 AND 8   THEN 20 ELSE 0 END
    + CASE WHEN kind = 0 AND row_idx BETWEEN 11 AND 15 AND col_idx BETWEEN 16 AND 20 THEN 16 ELSE 0 END
    + CASE WHEN kind = 1 AND row_idx BETWEEN 7 AND 12  AND col_idx BETWEEN 9 AND 14  THEN 36 ELSE 0 END
    + CASE WHEN kind = 2 AND row_idx = 12 AND col_idx = 12                           THEN 40 ELSE 0 END
    + CASE WHEN kind = 2 AND row_idx <= 1 AND col_idx BETWEEN 5 AND 19               THEN 12 ELSE 0 END
    + CASE WHEN kind = 2 AND row_idx BETWEEN 15 AND 16 AND col_idx BETWEEN 3 AND 5   THEN 30 ELSE 0 END
    + CASE WHEN kind = 4 AND row_idx BETWEEN 7 AND 12  AND col_idx BETWEEN 9 AND 14  THEN 11 ELSE 0 END
    + CASE WHEN kind = 5 AND row_idx BETWEEN 7 AND 12  AND col_idx BETWEEN 9 AND 14  THEN 22 ELSE 0 END
  AS DOUBLE) END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .selectExpr(
            "o_orderkey AS k",
            "o_totalprice",
            "o_orderkey div 500 AS frame_id",
            "CAST((o_orderkey % 500) div 25 AS INT) AS row_idx",
            "CAST(o_orderkey % 25 AS INT) AS col_idx",
            "(o_orderkey div 500) % 6 AS kind",
        )
        .selectExpr(
            "frame_id", "row_idx", "col_idx", f"{PIXEL_TEMPERATURE} AS temp_c", f"{HEIGHT} AS height", f"{WIDTH} AS width"
        )
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame; every tenth is uncalibrated, another tenth stores raw decikelvin."""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr("o_orderkey div 500 AS frame_id")
        .distinct()
        .selectExpr(
            "frame_id",
            "concat('mission/thermal_', lpad(CAST(frame_id AS STRING), 6, '0'), '.tif') AS source_path",
            f"{WIDTH} AS width",
            f"{HEIGHT} AS height",
            "1 AS band_count",
            "'float32' AS dtype",
            "'EPSG:4326' AS crs",
            "array(0.00001D, 0D, -82D + frame_id * 0.00025D, 0D, -0.00001D, 28D) AS transform",
            """CASE WHEN frame_id % 10 = 9 THEN map('THERMAL_UNIT', 'celsius', 'isCalibrated', 'False')
                    WHEN frame_id % 10 = 8 THEN map('note', 'raw counts')
                    ELSE map('THERMAL_UNIT', 'celsius') END AS tags""",
            "CASE WHEN frame_id % 4 = 3 THEN NULL ELSE '2024-01-01T00:00:00Z' END AS capture_time",
            "CAST(NULL AS DOUBLE) AS dataset_scale",
            "CAST(NULL AS DOUBLE) AS dataset_offset",
            "frame_id AS input_order",
        )
    )


def raw_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values before normalisation: decikelvin counts in every tenth frame."""
    raw = F.when(F.col("frame_id") % 10 == 8, F.col("temp_c") * 10 + 2731.5).otherwise(F.col("temp_c"))
    return pixels(spark, sf_dir).withColumn("raw", raw).drop("temp_c")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS obs_ord",
        "event_type AS classification",
        "event_type AS finding_type",
        "IF(event_id % 11 = 0, NULL, 28.0D + (user_id % 50) * 0.001D + (event_id % 7) * 0.000004D) AS latitude",
        "IF(event_id % 11 = 0, NULL, -82.0D + (user_id div 50) * 0.001D + (event_id % 5) * 0.000004D) AS longitude",
        "5 + value / 10 AS delta_temperature_c",
        "30 + value / 8 AS max_temperature_c",
        "CAST(20 + event_id % 80 AS INT) AS area_px",
        "CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence",
        "CAST(ts AS TIMESTAMP) AS ts",
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").selectExpr(
        "event_id AS media_id",
        "IF(event_type = 'view', 'thermal', 'visible') AS sensor_role",
        "CAST(ts AS TIMESTAMP) AS capture_ts",
        "IF(event_id % 11 = 0, NULL, 28.0D + (user_id % 50) * 0.001D + (event_id % 7) * 0.000004D) AS latitude",
        "IF(event_id % 11 = 0, NULL, -82.0D + (user_id div 50) * 0.001D + (event_id % 5) * 0.000004D) AS longitude",
    )
