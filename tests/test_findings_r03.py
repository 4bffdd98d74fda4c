"""One test per finding of the third round."""

import hashlib

from pyspark.sql import functions as F

from emberfield.operators import quality
from emberfield.plans.reports import file_manifest, stamped
from emberfield.sources import sinks


def test_gate_reads_values_without_places(spark):
    rows = [(1, 5.0), (1, 5.0), (1, 7.0), (1, None), (2, None), (3, 2000.0), (3, -0.0), (3, 0.0)]
    pixels = spark.createDataFrame([(f, t, 1, 1) for f, t in rows], "frame_id long, temp_c double, height int, width int")
    got = {r["frame_id"]: r for r in quality.pixel_metrics(pixels).collect()}
    names = ("total_pixels", "valid_pixels", "implausible", "at_min", "at_max", "minimum_c", "maximum_c", "extreme_fraction")
    figures = {f: tuple(r[n] for n in names) for f, r in got.items()}
    assert figures[1] == (4, 3, 0, 2, 1, 5.0, 7.0, 2 / 3)
    assert figures[2] == (1, 0, 0, 0, 0, None, None, 0.0)
    assert figures[3] == (3, 3, 1, 2, 1, 0.0, 2000.0, 2 / 3)


def test_manifest_has_a_file_per_document(spark, tmp_path):
    rows = [(i, None if i == 5 else f"text\n{i}" if i % 2 else "") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in file_manifest(spark, str(tmp_path)).select("sha256", "size_bytes", "state").collect()]
    plain = [None if t is None else t.replace("\n", " ").encode() for _, t in rows]
    want = [(None, None, "ok") if t is None else (hashlib.sha256(t).hexdigest(), len(t), "ok") for t in plain]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_file_per_source_without_folders_per_source(spark, tmp_path):
    rows = [(f, i, f"{f}-{i}") for f in range(300) for i in range(1 + f % 3)]
    lines = spark.createDataFrame(rows, "frame_id long, seq int, value string")
    sinks.write_files(lines.withColumn("file", sinks.source_file("part", "frame_id", ".txt")).repartition(7, "seq"), str(tmp_path), ["seq"])
    made = {p.name: p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert made == {f"frame_id={f}.txt": "".join(f"{f}-{i}\n" for i in range(1 + f % 3)) for f in range(300)}
    assert sum(p.is_dir() for p in tmp_path.rglob("*")) <= 1 + sinks.FOLDERS


def test_bundle_holds_every_source_in_every_part(spark, tmp_path):
    s = stamped(spark, "/root/testdata/sf0.001")
    parts = sinks.report_bundle(sinks.finding_register(s, {}, carry=["frame_id"]), s, str(tmp_path))
    assert parts == ["csv", "json", "geojson", "kml"]
    want = {r["frame_id"]: r["n"] for r in s.groupBy("frame_id").agg(F.count("*").alias("n")).collect()}
    for part in parts:
        files = {int(p.stem.split("=")[1]): p.read_text() for p in (tmp_path / part).rglob(f"*.{part}")}
        assert set(files) == set(want)
        for frame, text in files.items():
            marks = text.count("<Placemark>") if part == "kml" else len(text.splitlines()) - (part == "csv")
            assert marks == want[frame]
