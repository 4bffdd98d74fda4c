"""Finding lifecycle, run history and project catalogue (L1, L2, L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.operators.ordering import previous_in_spans
from emberfield.operators.registers import latest_version

STATUSES = ["new", "reviewed", "action_required", "monitor", "resolved", "dismissed"]  # fixed values


def effective_transitions(events: DataFrame, initial: str = "new") -> DataFrame:
    """L1: the append-only audit rows, i.e. status events that change something.

    ``events``: ``(finding_id, seq, ts, status, actor, note)`` in ``ts, seq`` order. The look-back runs
    per finding and day, so a finding with very many events is spread over its days.
    """
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    looked = previous_in_spans(events, ["finding_id"], ["ts", "seq"], "status", day, "from_status")
    looked = looked.withColumn("from_status", F.coalesce("from_status", F.lit(initial)))
    return looked.where(F.col("status") != F.col("from_status")).withColumn(
        "event", F.lit("lifecycle_status_changed")
    )


def current_status(transitions: DataFrame) -> DataFrame:
    """Latest state per finding from combinable aggregates; the trail itself stays in rows."""
    return transitions.groupBy("finding_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("lifecycle_status"),
        F.max("ts").alias("updated_at"),
        F.count("*").alias("changes"),
    )


def apply_status(findings: DataFrame, statuses: DataFrame) -> DataFrame:
    """Operational state beside untouched algorithm fields."""
    return (
        findings.drop("lifecycle_status")
        .join(statuses, "finding_id", "left")
        .withColumn("lifecycle_status", F.coalesce("lifecycle_status", F.lit("new")))
    )


def run_history(runs: DataFrame, project_id: str = "", limit: int | None = None) -> DataFrame:
    """L2: newest first, optionally one project and only so many of them."""
    out = runs.where(F.col("project_id") == project_id) if project_id else runs
    out = out.orderBy(F.desc("finished_at"), "run_id")
    return out if limit is None else out.limit(max(0, limit))


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def project_catalog(versions: DataFrame) -> DataFrame:
    """L4: the latest saved version of every project."""
    return latest_version(versions, "project_id", "modified_at")


def run_outcome(frames: DataFrame, failures: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """L3: accepted and rejected counts with the final status of a run.

    ``reached`` holds the sources that were processed before a stop; when some were not, the run is canceled and
    keeps the results it has.
    """
    lost = failures.groupBy("frame_id").agg(F.min("error").alias("error"))
    marked = frames.select("frame_id").join(lost, "frame_id", "left")
    if reached is None:
        marked = marked.withColumn("done", F.lit(True))
    else:
        marked = marked.join(reached.select("frame_id", F.lit(True).alias("done")).distinct(), "frame_id", "left")
    failed = F.expr("error IS NOT NULL")
    return marked.agg(
        F.count("*").alias("sources"),
        F.count_if(~failed & F.coalesce("done", F.lit(False))).alias("accepted"),
        F.count_if(failed).alias("rejected"),
        F.count_if(~failed & F.col("done").isNull()).alias("left_out"),
    ).select(
        "sources",
        "accepted",
        "rejected",
        F.when(F.col("left_out") > 0, "canceled").when(F.col("accepted") > 0, "complete").otherwise("failed").alias("status"),
    )
