"""Session helpers: a local builder for tests and the checkpoint used to cut iterative lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "emberfield", cores: str | None = None, partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own session."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("EMBERFIELD_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own, or a scratch one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        folder = tempfile.mkdtemp(prefix="spark-emberfield-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a stage of a multi-pass job as a table in the shared checkpoint folder.

    The stage is computed once, later passes read it back with column pruning and real size
    statistics, and a lost executor costs a file read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stage_path = path
    return back


def drop_stage(*frames: DataFrame) -> None:
    """Remove the tables of frames that ``cut_lineage`` gave and that no later pass reads; others are left alone."""
    for frame in frames:
        path = getattr(frame, "_stage_path", None)
        if path:
            remove_folders(frame.sparkSession, [path])


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, whether they exist or not."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
