"""Structured Streaming re-aims: frame statistics, detection, run status and media pairing (ST1–ST4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.operators.detection import detect
from emberfield.operators.evidence import DetectionSettings
from emberfield.operators.sheets import frame_sheets
from emberfield.session import cut_lineage, drop_stage, remove_folders


def frame_statistics_stream(pixels: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """ST1: per window and frame; rows past the watermark are dropped. ``pixels`` carries ``ingest_ts``."""
    return (
        pixels.withWatermark("ingest_ts", late)
        .groupBy(F.window("ingest_ts", window), "frame_id")
        .agg(
            F.min("temp_c").alias("minimum_c"),
            F.max("temp_c").alias("maximum_c"),
            F.avg("temp_c").alias("mean_c"),
            F.stddev_pop("temp_c").alias("stddev_c"),
            F.count("temp_c").alias("valid_pixels"),
        )
    )


#: Batches that an incomplete frame waits, and that a settled one is remembered, unless told otherwise.
PATIENCE = 24


def detect_batches(
    root: str, settings: DetectionSettings = DetectionSettings(), patience: int = PATIENCE
) -> Callable[[DataFrame, int], None]:
    """ST2: a ``foreachBatch`` sink that detects on frames once all their pixels have arrived.

    Rows that wait are written once, in ``root/pending/<batch>`` of the batch they came with; a small table ``root/waiting/<batch>`` tells
    which frames wait since which batch and how many of their pixels are there, so a batch reads pixels of earlier ones only for frames that
    it completes. Findings go to ``root/findings/<batch>``. A frame still incomplete ``patience`` batches after its first pixel becomes
    a row of ``root/failures/<batch>``. Settled frames, complete or failed, are remembered in ``root/settled/<batch>`` for ``patience``
    batches, in which late duplicates of theirs are dropped. So neither table grows with the stream, and pending
    folders that no frame can still need are removed. Every path is named by its batch: a replayed batch overwrites its own output.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        told = "frame_id bigint, since bigint, cells bigint, size bigint"
        known = "frame_id bigint, settled_in bigint"
        earlier = lambda name, schema: (
            spark.read.schema(schema).parquet(f"{root}/{name}/{batch_id - 1}") if batch_id > 0 else spark.createDataFrame([], schema)
        )
        waited, settled = earlier("waiting", told), earlier("settled", known)
        cells = ["frame_id", "row_idx", "col_idx"]
        fresh = batch.join(settled.select("frame_id"), "frame_id", "left_anti").dropDuplicates(cells)
        fresh = fresh.repartition("frame_id")
        fresh.write.mode("overwrite").parquet(f"{root}/pending/{batch_id}")
        fresh = spark.read.schema(batch.schema).parquet(f"{root}/pending/{batch_id}")
        # Where a frame's cells come in several batches a repeated one may count twice, so such frames are counted over their pixels.
        first = max(0, batch_id - patience)
        paths = [f"{root}/pending/{i}" for i in range(first, batch_id + 1)]
        touched = fresh.select("frame_id").distinct()
        grown = touched.join(waited.select("frame_id"), "frame_id", "left_semi")
        pixels = spark.read.schema(batch.schema).parquet(*paths)
        size = F.max(F.col("height").cast("long") * F.col("width")).alias("size")
        counted = lambda df: df.groupBy("frame_id").agg(F.count("*").alias("cells"), size)
        again = counted(pixels.join(grown, "frame_id", "left_semi").dropDuplicates(cells))
        new = counted(fresh.join(grown, "frame_id", "left_anti"))
        now = again.join(waited.select("frame_id", "since"), "frame_id").unionByName(new.withColumn("since", F.lit(batch_id).cast("long")))
        state = cut_lineage(waited.join(touched, "frame_id", "left_anti").unionByName(now.select(waited.columns)))
        complete = state.where("cells >= size").select("frame_id")
        late = state.where((F.col("cells") < F.col("size")) & (F.lit(batch_id) - F.col("since") >= patience))
        error = F.format_string("frame incomplete: %d of %d pixels arrived", "cells", "size")
        late.select("frame_id", F.lit("IncompleteFrame").alias("error_type"), error.alias("error")).write.mode("overwrite").parquet(
            f"{root}/failures/{batch_id}"
        )
        done = complete.unionByName(late.select("frame_id"))
        state.join(done, "frame_id", "left_anti").write.mode("overwrite").parquet(f"{root}/waiting/{batch_id}")
        remembered = settled.where(F.col("settled_in") > batch_id - patience)
        remembered.unionByName(done.withColumn("settled_in", F.lit(batch_id).cast("long"))).coalesce(1).write.mode("overwrite").parquet(
            f"{root}/settled/{batch_id}"
        )
        ready = pixels.join(complete, "frame_id", "left_semi").dropDuplicates(cells)
        detect(frame_sheets(ready), settings).findings.drop("polygon", "morphology", "confidence_components").write.mode(
            "overwrite"
        ).parquet(f"{root}/findings/{batch_id}")
        drop_stage(state)
        # A replay needs the batch before it; pixels older than the patience belong to settled frames.
        remove_folders(spark, [f"{root}/pending/{first - 1}", *(f"{root}/{n}/{batch_id - 2}" for n in ("waiting", "settled"))])

    return run


def run_status_stream(events: DataFrame) -> DataFrame:
    """ST3: latest stage and progress per run; meant for update mode."""
    return events.groupBy("run_id").agg(
        F.max_by("stage", "seq").alias("stage"),
        F.max_by("completed", "seq").alias("completed"),
        F.max("total").alias("total"),
        F.count("*").alias("events"),
    )


def stage_dwell_stream(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """ST3: sessions of one stage of a run, with their dwell time."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "run_id", "stage")
        .agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )


def pair_streams(
    thermal: DataFrame, visible: DataFrame, seconds: float = fv.PAIR_SECONDS, late: str = "1 minute"
) -> DataFrame:
    """ST4: thermal–visible candidates by event time, state bounded by both watermarks."""
    limit = F.expr(f"INTERVAL {seconds} SECONDS")
    t = thermal.select(F.col("media_id").alias("thermal_id"), F.col("capture_ts").alias("thermal_ts")).withWatermark("thermal_ts", late)
    v = visible.select(F.col("media_id").alias("visible_id"), F.col("capture_ts").alias("visible_ts")).withWatermark("visible_ts", late)
    slot = lambda c: F.floor(F.unix_micros(c) / int(seconds * 1_000_000))
    t = t.withColumn("slot", F.explode(F.array(*[slot("thermal_ts") + d for d in (-1, 0, 1)])))
    v = v.withColumn("slot", slot("visible_ts"))
    near = (
        (t["slot"] == v["slot"])
        & (F.col("visible_ts") >= F.col("thermal_ts") - limit)
        & (F.col("visible_ts") <= F.col("thermal_ts") + limit)
    )
    return t.join(v, near).select(
        "thermal_id",
        "visible_id",
        (F.abs(F.unix_micros("thermal_ts") - F.unix_micros("visible_ts")) / 1e6).alias("time_difference_s"),
    )


def upsert_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Update-mode sink: each batch writes its changed rows under its own number."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return run


def run_to_end(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Process everything available now, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()


def latest_rows(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """Read an update-mode table back: the newest version of every key."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
