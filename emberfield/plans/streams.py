"""Streaming queries over the given tables, checked against their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.plans.catalog import query, tidy
from emberfield.plans.detector import FINDING_SQL
from emberfield.plans.intake import scratch
from emberfield.plans.sql import r, with_tables
from emberfield.sources import derived
from emberfield.streaming import incremental


def pixel_stream(spark, sf):
    o = incremental.table_stream(spark, sf, "orders")
    return (
        o.selectExpr(
            "o_orderkey AS k", "o_totalprice", "o_orderkey div 500 AS frame_id", "CAST((o_orderkey % 500) div 25 AS INT) AS row_idx",
            "CAST(o_orderkey % 25 AS INT) AS col_idx", "(o_orderkey div 500) % 6 AS kind", "CAST(o_orderdate AS TIMESTAMP) AS ingest_ts",
        )
        .selectExpr("frame_id", "row_idx", "col_idx", f"{derived.PIXEL_TEMPERATURE} AS temp_c", "20 AS height", "25 AS width", "ingest_ts")
    )


@query(
    "stream_frame_statistics",
    with_tables(
        ["pixels"],
        f"""SELECT frame_id, period, {r('min(temp_c)', 'minimum_c')}, {r('max(temp_c)', 'maximum_c')}, {r('avg(temp_c)', 'mean_c')}, {r('stddev_pop(temp_c)', 'stddev_c')},
        count(temp_c) AS valid_pixels FROM (SELECT p.*, CAST(floor(epoch(CAST(o_orderdate AS TIMESTAMP)) / 2592000) AS BIGINT) AS period FROM pixels p
          JOIN orders ON o_orderkey = frame_id * 500 + row_idx * 25 + col_idx) q GROUP BY frame_id, period""",
    ),
)
def stream_frame_statistics(spark, sf):
    """Frames per window of 30 days of event time; updates are upserted by frame and window."""
    root = scratch(spark, "stream-stats")
    stats = incremental.frame_statistics_stream(pixel_stream(spark, sf), "30 days")
    period = F.floor(F.unix_seconds("window.start") / 2592000).alias("period")
    flat = stats.select("frame_id", period, "minimum_c", "maximum_c", "mean_c", "stddev_c", "valid_pixels")
    incremental.run_to_end(flat, incremental.upsert_batches(f"{root}/rows"), f"{root}/checkpoint", "update")
    schema = "frame_id long, period long, minimum_c double, maximum_c double, mean_c double, stddev_c double, valid_pixels long, batch int"
    return tidy(incremental.latest_rows(spark, f"{root}/rows", schema, ["frame_id", "period"]))


@query("stream_findings", with_tables(["regions"], FINDING_SQL.split(", lft AS")[0] + " FROM findings"))
def stream_findings(spark, sf):
    """Detection per micro-batch on the frames that are complete."""
    root = scratch(spark, "stream-findings")
    incremental.run_to_end(pixel_stream(spark, sf).drop("ingest_ts"), incremental.detect_batches(root), f"{root}/checkpoint")
    f = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/findings")
    return tidy(
        f.select(
            "frame_id", "finding_id", "severity", "confidence", "delta_temperature_c", "max_temperature_c", "mean_temperature_c",
            "reference_temperature_c", "area_px", "center_x", "center_y",
        )
    )


@query(
    "stream_run_status",
    "SELECT user_id AS run_id, arg_max(event_type, event_id) AS stage, max(event_id) AS completed, count(*) AS events FROM events GROUP BY user_id",
)
def stream_run_status(spark, sf):
    root = scratch(spark, "stream-status")
    e = incremental.table_stream(spark, sf, "events").selectExpr(
        "user_id AS run_id", "event_type AS stage", "event_id AS seq", "event_id AS completed", "event_id AS total"
    )
    incremental.run_to_end(incremental.run_status_stream(e), incremental.upsert_batches(f"{root}/rows"), f"{root}/checkpoint", "update")
    schema = "run_id long, stage string, completed long, total long, events long, batch int"
    return tidy(incremental.latest_rows(spark, f"{root}/rows", schema, ["run_id"]).drop("total"))


@query(
    "stream_stage_dwell",
    f"""WITH g AS (SELECT user_id AS run_id, event_type AS stage, ts, event_id,
      CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id, stage ORDER BY ts, event_id) AS sid FROM g)
    SELECT run_id, stage, count(*) AS events, {r('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6', 'dwell_s', 6)} FROM s GROUP BY run_id, stage, sid""",
)
def stream_stage_dwell(spark, sf):
    root = scratch(spark, "stream-dwell")
    e = incremental.table_stream(spark, sf, "events").selectExpr(
        "user_id AS run_id", "event_type AS stage", "CAST(ts AS TIMESTAMP) AS ts"
    )
    d = incremental.stage_dwell_stream(e, "12 hours").select(
        "run_id", "stage", F.col("session_window.start").alias("start"), "events",
        ((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6).alias("dwell_s"),
    )
    incremental.run_to_end(d, incremental.upsert_batches(f"{root}/rows"), f"{root}/checkpoint", "complete")
    schema = "run_id long, stage string, start timestamp, events long, dwell_s double, batch int"
    rows = incremental.latest_rows(spark, f"{root}/rows", schema, ["run_id", "stage", "start"])
    return tidy(rows.drop("start"), 6)


@query(
    "stream_media_pairs",
    with_tables(
        ["media"],
        f"""SELECT a.media_id AS thermal_id, b.media_id AS visible_id, {r('abs(epoch_us(a.capture_ts) - epoch_us(b.capture_ts)) / 1e6', 'time_difference_s', 6)}
        FROM media a JOIN media b ON a.sensor_role = 'thermal' AND b.sensor_role = 'visible' AND abs(epoch_us(a.capture_ts) - epoch_us(b.capture_ts)) <= 2500000""",
    ),
)
def stream_media_pairs(spark, sf):
    root = scratch(spark, "stream-pairs")
    m = incremental.table_stream(spark, sf, "events").selectExpr("event_id AS media_id", "event_type", "CAST(ts AS TIMESTAMP) AS capture_ts")
    pairs = incremental.pair_streams(m.where("event_type = 'view'"), m.where("event_type = 'click'"))
    incremental.run_to_end(pairs, incremental.upsert_batches(f"{root}/rows"), f"{root}/checkpoint")
    schema = "thermal_id long, visible_id long, time_difference_s double, batch int"
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/rows")
    return tidy(rows.drop("batch"), 6)
