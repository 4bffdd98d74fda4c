"""Sinks: registers, JSON, GeoJSON, KML, evidence layers, manifests."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield import fixed_values as fv
from emberfield.functions.columns import fixed
from emberfield.operators.ordering import CHAIN_SPAN, rank_in_groups
from emberfield.operators.registers import number_rows

#: Bytes of a file that are hashed at once.
HASH_PIECE = 1 << 20
#: Folders that the files of many sources are dealt over, so that they are listed by several tasks.
FOLDERS = 64


def stored(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and place of a path as Spark tells it."""
    if path.startswith("file:") or "://" not in path:
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def source_file(part: str, source: str, ending: str) -> Column:
    """Path of a source's file below the root: ``part/folder/source=value.ending``."""
    folder = F.pmod(F.xxhash64(source), F.lit(FOLDERS)).cast("string")
    return F.concat(F.lit(f"{part}/"), folder, F.lit(f"/{source}="), F.coalesce(F.col(source).cast("string"), F.lit("none")), F.lit(ending))


def write_files(lines: DataFrame, root: str, order: list[str] = [], end: str = "\n") -> None:
    """Text files from ``(file, value)``: each file holds its rows as lines in the given order.

    The tasks write the files themselves, one open at a time, so that a file per source costs neither a folder nor a step of the
    driver's commit. A file has a hidden name until it is complete; a repeated task leaves the same files.
    """
    ordered = lines.repartition("file").sortWithinPartitions("file", *order).select("file", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = stored(root.rstrip("/"))
        made: set[str] = set()
        now, sink, hidden, count = None, None, "", 0

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(hidden, f"{base}/{now}")

        for batch in batches:
            for file, value in zip(*(c.to_pylist() for c in batch.columns)):
                if file != now:
                    close()
                    now, count = file, count + 1
                    folder, name = f"{base}/{file}".rsplit("/", 1)
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(hidden, compression=None)
                sink.write(((value or "") + end).encode())
        close()
        yield pa.RecordBatch.from_pydict({"files": [count]})

    ordered.mapInArrow(run, "files bigint").agg(F.sum("files")).first()


def finding_register(
    findings: DataFrame, project: dict[str, str] | None = None, keys: list[str] = ["frame_id"], carry: list[str] = []
) -> DataFrame:
    """K1: project columns, source, adapter, id and the finding columns in their fixed order, behind those to ``carry``."""
    project = project or {}
    base = number_rows(findings, keys, ["rank"])
    values = {"project_name": project.get("name", ""), **{c: project.get(c, "") for c in fv.PROJECT_COLUMNS[1:]}}
    column = lambda c: F.col(c) if c in findings.columns else F.lit(None).cast("string").alias(c)
    return base.select(
        *carry,
        *[F.lit(values[c]).alias(c) for c in fv.PROJECT_COLUMNS],
        F.col("source_path").alias("source"),
        F.col("radiometric_provenance.adapter").alias("adapter"),
        "id",
        *[column(c) for c in fv.FINDING_COLUMNS],
    )


def write_register(register: DataFrame, path: str, partition: str | None = None) -> None:
    writer = register.write.mode("overwrite").option("header", True)
    (writer.partitionBy(partition) if partition else writer).csv(path)


def _sorted_keys(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs and the keys of its maps in order, however deep they lie."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_sorted_keys(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(value, lambda x: _sorted_keys(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(value)))
    return value


def sorted_fields(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.struct(*[_sorted_keys(F.col(n), df.schema[n].dataType).alias(n) for n in sorted(columns or df.columns)])


def sorted_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """K2: one JSON object with keys in sorted order, those of nested objects too."""
    return F.to_json(sorted_fields(df, columns), {"ignoreNullFields": "false"})


def write_json_lines(findings: DataFrame, path: str, partition: str | None = None) -> None:
    kept = [partition] if partition else []
    rows = findings.select(*kept, sorted_json(findings).alias("value"))
    _by_source(rows, partition).text(path)


def _by_source(df: DataFrame, partition: str | None) -> DataFrameWriter:
    """A writer that leaves one file per value of the partition column, or whatever comes without one."""
    return df.repartition(partition).write.mode("overwrite").partitionBy(partition) if partition else df.write.mode("overwrite")


def inspection_documents(
    frames: DataFrame,
    quality: DataFrame,
    statistics: DataFrame,
    summaries: DataFrame,
    findings: DataFrame,
    suppressions: DataFrame,
    project: dict[str, str],
    profile_id: str,
    adapter: str = "pixel-table",
) -> DataFrame:
    """K2: the inspection document of every source as its lines ``(frame_id, section, seq, value)``.

    Keys are sorted. Findings and suppressions are a line each, so a source with any number of them is no row of its own; the lines of a
    source in (section, seq) order are one JSON object.
    """

    def nested(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("frame_id", "tile_id")]
        return df.select("frame_id", sorted_json(df, rest).alias(name))

    whole = frames.select("frame_id", "source_path", F.coalesce(F.map_from_entries(F.array_sort(F.map_entries("tags"))), F.create_map().cast("map<string,string>")).alias("tags"))
    for part, name in ((quality, "quality"), (statistics, "statistics"), (summaries, "summary")):
        whole = whole.join(nested(part, name), "frame_id", "left")
    text = lambda v: F.lit(json.dumps(v, sort_keys=True, ensure_ascii=False))
    or_null = lambda n: F.coalesce(F.col(n), F.lit("null"))
    # A string is encoded as the only member of an array, whose brackets are taken off.
    source = F.regexp_replace(F.to_json(F.array("source_path")), r"^\[|\]$", "")
    head = F.concat(F.lit('{"adapter": '), text(adapter), F.lit(', "findings": ['))
    middle = F.concat(
        F.lit('], "metadata": '), F.to_json("tags"), F.lit(', "profile": '), text(profile_id), F.lit(', "project": '), text(project),
        F.lit(', "quality": '), or_null("quality"), F.lit(', "source": '), source, F.lit(', "statistics": '), or_null("statistics"),
        F.lit(', "summary": '), or_null("summary"), F.lit(', "suppressions": ['),
    )

    def lines(df: DataFrame, section: int) -> DataFrame:
        """One line a row, with a comma before all but the first of a source."""
        order = [F.col("tile_id"), F.col("label")]
        spans = [[F.col("tile_id"), F.floor(F.col("label") / CHAIN_SPAN)]]
        numbered = df if "rank" in df.columns else rank_in_groups(df, ["frame_id"], spans, order, "rank")
        body = sorted_json(df, [c for c in df.columns if c not in ("frame_id", "tile_id", "label", "rank")])
        comma = F.when(F.col("rank") > 1, ",").otherwise("")
        return numbered.select("frame_id", F.lit(section).alias("section"), F.col("rank").alias("seq"), F.concat(comma, body).alias("value"))

    once = lambda section, value: whole.select("frame_id", F.lit(section).alias("section"), F.lit(0).alias("seq"), value.alias("value"))
    return (
        once(0, head)
        .unionByName(lines(findings, 1))
        .unionByName(once(2, middle))
        .unionByName(lines(suppressions, 3))
        .unionByName(once(4, F.lit("]}")))
    )


def write_documents(lines: DataFrame, path: str) -> None:
    """One JSON file per source, ``frame_id=value.json`` in one of ``FOLDERS`` folders."""
    write_files(lines.withColumn("file", source_file("documents", "frame_id", ".json")), path, ["section", "seq"])


def located(findings: DataFrame) -> DataFrame:
    return findings.where("latitude IS NOT NULL AND longitude IS NOT NULL")


def geojson_features(findings: DataFrame, carry: list[str] = []) -> DataFrame:
    """K3: one Feature per row (a line-delimited collection), ``[lon, lat]``, only located findings."""
    rest = [c for c in findings.columns if c not in ("latitude", "longitude")]
    feature = F.struct(
        F.struct(F.array("longitude", "latitude").alias("coordinates"), F.lit("Point").alias("type")).alias("geometry"),
        F.nullif(F.col("finding_id"), F.lit("")).alias("id"),
        sorted_fields(findings, rest).alias("properties"),
        F.lit("Feature").alias("type"),
    )
    return located(findings).select(*carry, F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_geojson(findings: DataFrame, path: str, partition: str | None = None) -> bool:
    """Writes nothing when no finding is located; returns whether it wrote."""
    features = geojson_features(findings, [partition] if partition else [])
    if features.limit(1).count() == 0:
        return False
    _by_source(features, partition).text(path)
    return True


def placemarks(findings: DataFrame, carry: list[str] = []) -> DataFrame:
    """K4: placemark rows with the description text."""
    kind = F.coalesce(F.nullif(F.col("classification"), F.lit("")), F.col("finding_type"))
    description = F.concat(
        F.lit("Classification: "), kind,
        F.lit("; Severity: "), F.col("severity"),
        F.lit("; Confidence: "), F.col("confidence"),
        F.lit("; ΔT: "), fixed(F.col("delta_temperature_c"), 1),
        F.lit(" °C; Max: "), fixed(F.col("max_temperature_c"), 1), F.lit(" °C"),
    )
    return located(findings).select(
        *carry,
        F.coalesce(F.nullif(F.col("finding_id"), F.lit("")), F.lit("Thermal finding")).alias("name"),
        description.alias("description"),
        F.struct(F.concat_ws(",", F.col("longitude").cast("string"), F.col("latitude").cast("string"), F.lit("0")).alias("coordinates")).alias("Point"),
    )


def legacy_placemarks(regions: DataFrame) -> DataFrame:
    """K4 older style: multi-line description and a style per severity."""
    text = F.concat(
        F.lit("Type: "), F.col("type"),
        F.lit("\nSeverity: "), F.col("severity"),
        F.lit("\nMax Temp: "), fixed(F.col("max_temp"), 1),
        F.lit("°C\nΔT: "), fixed(F.col("temp_delta"), 1),
        F.lit("°C\nArea: "), fixed(F.col("area_m2"), 2),
        F.lit(" m²\nAnnotation: "), F.col("annotation"),
    )
    return located(regions).select(
        "frame_id",
        F.format_string("Anomaly %d", F.col("anomaly_id")).alias("name"),
        text.alias("description"),
        F.concat(F.lit("#"), F.col("severity"), F.lit("Style")).alias("styleUrl"),
    )


def write_kml(marks: DataFrame, path: str, partition: str | None = None) -> None:
    writer = marks.write.mode("overwrite").format("xml").option("rowTag", "Placemark").option("rootTag", "Document")
    (writer.partitionBy(partition) if partition else writer).save(path)


def evidence_table(evidence: DataFrame) -> DataFrame:
    """K6: the nine bands in band order beside the pixel key."""
    named = evidence.withColumnRenamed("temp_c", "temperature_c")
    return named.select(
        "frame_id", "row_idx", "col_idx", *[F.col(n).cast("double").alias(n) for n, *_ in fv.EVIDENCE_BANDS]
    )


def write_evidence(evidence: DataFrame, path: str, buckets: int = 256) -> None:
    """K6: Parquet partitioned by a frame bucket, so directory count is bounded however many frames come."""
    evidence.withColumn("frame_bucket", F.pmod(F.hash("frame_id"), F.lit(buckets))).write.mode("overwrite").partitionBy(
        "frame_bucket"
    ).parquet(path)


def band_manifest(spark: SparkSession) -> DataFrame:
    rows = [(i, *band) for i, band in enumerate(fv.EVIDENCE_BANDS, 1)]
    return spark.createDataFrame(rows, "band int, name string, description string, unit string, authority string, experimental boolean")


def file_manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """K7: relative path, SHA-256 and size of every file under ``root``, empty ones too; hidden names (``.`` or ``_`` first) are passed over.

    The driver sees the folders directly below ``root`` only: tasks list what is in them, and the files are dealt out again to be read in
    pieces of 1 MiB, so files of any size pass in bounded memory. The folder is reached by ``pyarrow.fs`` (local, HDFS, S3 and others).
    """
    store, base = stored(root.rstrip("/"))
    info = store.get_file_info(pyarrow.fs.FileSelector(base))
    below = [i.base_name for i in info if i.type == pyarrow.fs.FileType.Directory]
    folders = spark.createDataFrame([(f,) for f in ["", *below]], "folder string").repartition("folder")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = stored(root.rstrip("/"))
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                chosen = pyarrow.fs.FileSelector(f"{base}/{folder}" if folder else base, recursive=bool(folder))
                for i in store.get_file_info(chosen):
                    path = i.path[len(base) :].lstrip("/")
                    seen = i.type == pyarrow.fs.FileType.File and fnmatch.fnmatchcase(i.base_name, glob)
                    if seen and not any(p[0] in "._" and "=" not in p for p in path.split("/")):
                        yield pa.RecordBatch.from_pydict({"path": [path], "size_bytes": [i.size]})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = stored(root.rstrip("/"))
        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with store.open_input_stream(f"{base}/{path}", compression=None) as source:
                    while piece := source.read(HASH_PIECE):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), batch.column(1)], names=["path", "sha256", "size_bytes"])

    files = folders.mapInArrow(listed, "path string, size_bytes bigint").repartition("path")
    return files.mapInArrow(hashed, "path string, sha256 string, size_bytes bigint")


def verify_manifest(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Full outer comparison; ``state`` is ok, changed, missing or unexpected."""
    r = recorded.select("path", F.col("sha256").alias("was_sha"), F.col("size_bytes").alias("was_size"))
    both = r.join(actual, "path", "full_outer")
    state = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("was_sha").isNull(), "unexpected")
        .when((F.col("was_sha") != F.col("sha256")) | (F.col("was_size") != F.col("size_bytes")), "changed")
        .otherwise("ok")
    )
    return both.select("path", state.alias("state"))


def replace_package(df: DataFrame, path: str, key: str = "inspection_id") -> None:
    """K8: a rerun replaces exactly the inspections it holds; a failed rerun leaves the old ones.

    The dynamic partition overwrite commits staged files at the end of the job.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def report_bundle(register: DataFrame, findings: DataFrame, root: str, source: str = "frame_id") -> list[str]:
    """A file per source in each part: CSV and JSON always, KML and GeoJSON for sources with coordinates.

    ``register`` carries the ``source`` column (see ``finding_register``). Files are ``part/folder/source=value.ending``.
    """
    columns = [c for c in register.columns if c != source]

    def part(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select(source_file(name, source, f".{name}").alias("file"), F.lit(1).alias("seq"), value.alias("value"))

    def around(df: DataFrame, name: str, seq: int, text: str) -> DataFrame:
        return df.select(source).distinct().select(source_file(name, source, f".{name}").alias("file"), F.lit(seq).alias("seq"), F.lit(text).alias("value"))

    lines = around(register, "csv", 0, ",".join(columns)).unionByName(part(register, "csv", F.to_csv(F.struct(*columns))))
    lines = lines.unionByName(part(findings, "json", sorted_json(findings)))
    written = ["csv", "json"]
    if located(findings).limit(1).count():
        marks = placemarks(findings, [source])
        mark = F.to_xml(F.struct(*[c for c in marks.columns if c != source]), {"rowTag": "Placemark"})
        features = geojson_features(findings, [source])
        lines = lines.unionByName(part(features, "geojson", F.col("feature"))).unionByName(part(marks, "kml", mark))
        lines = lines.unionByName(around(marks, "kml", 0, "<Document>")).unionByName(around(marks, "kml", 2, "</Document>"))
        written += ["geojson", "kml"]
    write_files(lines, root, ["seq", "value"])
    return written


def cube_status(frames: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per evidence cube: written, or unavailable with its error."""
    return frames.select("frame_id", F.col("source_path").alias("source")).join(
        failures.select("frame_id", "error_type", "error"), "frame_id", "left"
    ).select(
        "frame_id",
        "source",
        F.when(F.col("error").isNull(), "written").otherwise("unavailable").alias("status"),
        "error_type",
        "error",
    )


def evidence_appendix(bands: DataFrame, cubes: DataFrame) -> DataFrame:
    """Band contract and cube status as JSON rows of one appendix."""
    band_rows = bands.select(F.lit("band").alias("section"), F.col("band").cast("string").alias("item"), sorted_json(bands).alias("body"))
    cube_rows = cubes.select(F.lit("cube").alias("section"), F.col("source").alias("item"), sorted_json(cubes).alias("body"))
    return band_rows.unionByName(cube_rows)
