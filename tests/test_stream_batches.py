"""Micro-batches: windows of event time with late rows, and frames that never complete."""

from pyspark.sql import functions as F

from emberfield.streaming import incremental

SCHEMA = "frame_id long, row_idx int, col_idx int, temp_c double, height int, width int"


def test_windows_over_several_batches_drop_late_rows(spark, tmp_path):
    source = tmp_path / "in"
    rows = lambda *r: spark.createDataFrame(r, "frame_id long, temp_c double, ts string").withColumn("ingest_ts", F.to_timestamp("ts")).drop("ts")
    batches = [
        rows((1, 10.0, "2024-01-01 00:10:00"), (1, 12.0, "2024-01-01 01:10:00")),
        rows((1, 20.0, "2024-01-01 00:20:00"), (1, 30.0, "2024-01-01 09:00:00")),
        rows((1, 99.0, "2024-01-01 00:30:00"), (1, 31.0, "2024-01-01 09:30:00")),
    ]
    for i, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(source / f"b{i}"))
        stream = spark.readStream.schema(b.schema).option("recursiveFileLookup", "true").parquet(str(source))
        stats = incremental.frame_statistics_stream(stream).select("frame_id", F.col("window.start").alias("start"), "maximum_c", "valid_pixels")
        incremental.run_to_end(stats, _named(tmp_path, i), str(tmp_path / "checkpoint"), "update")
    got = incremental.latest_rows(spark, str(tmp_path / "rows"), "frame_id long, start timestamp, maximum_c double, valid_pixels long, batch int", ["frame_id", "start"])
    out = {(r["start"].hour, r["maximum_c"], r["valid_pixels"]) for r in got.collect()}
    assert out == {(0, 20.0, 2), (1, 12.0, 1), (9, 31.0, 2)}


def _named(tmp_path, i):
    return incremental.upsert_batches(str(tmp_path / "rows"))


def test_incomplete_frames_wait_and_expire(spark, tmp_path):
    run = incremental.detect_batches(str(tmp_path), patience=2)
    frame = lambda f, cells: spark.createDataFrame([(f, r, c, 20.0, 12, 12) for r, c in cells], SCHEMA)
    every = [(r, c) for r in range(12) for c in range(12)]
    run(frame(1, every[:70]).unionByName(frame(2, every[:5])), 0)
    run(frame(1, every[70:]), 1)
    waiting = lambda i: {(r["frame_id"], r["cells"]) for r in spark.read.parquet(str(tmp_path / f"waiting/{i}")).collect()}
    assert waiting(1) == {(2, 5)}
    run(frame(3, every[:1]).unionByName(frame(1, every[:9])), 2)  # pixels of a frame that is settled already
    failed = spark.read.parquet(str(tmp_path / "failures/2")).collect()
    assert [(r["frame_id"], r["error"]) for r in failed] == [(2, "frame incomplete: 5 of 144 pixels arrived")]
    assert waiting(2) == {(3, 1)}


def test_state_does_not_grow_over_many_batches(spark, tmp_path):
    """Every batch brings a whole frame, a first pixel of one that never completes, and a duplicate of an earlier frame."""
    run = incremental.detect_batches(str(tmp_path), patience=2)
    every = [(r, c) for r in range(10) for c in range(10)]
    sizes = []
    for i in range(7):
        rows = [(100 + i, r, c, 20.0, 10, 10) for r, c in every] + [(200 + i, 0, 0, 20.0, 10, 10)] + [(99 + i, 3, 3, 20.0, 10, 10)] * (i > 0)
        run(spark.createDataFrame(rows, SCHEMA), i)
        sizes.append(tuple(spark.read.parquet(str(tmp_path / f"{n}/{i}")).count() for n in ("waiting", "settled")))
    assert sizes[3:] == [sizes[3]] * 4 and sizes[3][0] == 2
    assert len([f for f in (tmp_path / "pending").iterdir() if f.is_dir()]) <= 4
    assert {r["frame_id"] for i in range(7) for r in spark.read.parquet(str(tmp_path / f"failures/{i}")).collect()} == {200, 201, 202, 203, 204}
