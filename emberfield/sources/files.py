"""File sources: mission folders, KML, world files, sidecars, finding documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield import fixed_values as fv


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^./]+$", "")


def scan_folder(spark: SparkSession, root: str, mission_id: str = "") -> DataFrame:
    """File listing without reading contents (the content column is pruned from the scan)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return classify_files(
        files.select(F.lit(mission_id).alias("mission_id"), "path", F.col("length").alias("size_bytes"))
    )


def classify_files(files: DataFrame) -> DataFrame:
    """Supported files only, split into analysis sources and context."""
    out = files.withColumn("ext", suffix(F.col("path"))).where(F.col("ext").isin(fv.IMAGE_SUFFIXES + fv.CONTEXT_SUFFIXES))
    return out.withColumns(
        {
            "is_image": F.col("ext").isin(fv.IMAGE_SUFFIXES),
            "is_analysis_source": F.col("ext").isin(fv.RASTER_SUFFIXES),
        }
    )


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per mission path."""
    return files.dropDuplicates(["mission_id", "path"])


def context_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Discovered minus analysed."""
    return files.join(sources.select("mission_id", "path"), ["mission_id", "path"], "left_anti")


def mission_intake(files: DataFrame, roots: DataFrame) -> DataFrame:
    """S8+S9 per mission: counts, bytes, readiness, name and starting profile.

    Every name counts as a hint: each is turned into one flag per hint word, and flags combine by maximum, so a
    mission with a third of all files needs no sort and no long text.
    """
    spaced = lambda c: F.concat(F.lit(" "), F.translate(F.lower(c), "_-", "  "), F.lit(" "))
    words = list(dict.fromkeys(w for _, own in fv.PROFILE_HINTS for w in own))
    name = spaced(stem(F.col("path")))
    totals = files.groupBy("mission_id").agg(
        F.count("*").alias("files"),
        F.count_if("is_image").alias("images"),
        F.count_if("is_analysis_source").alias("analysis_sources"),
        F.sum("size_bytes").alias("total_bytes"),
        *[F.max(name.contains(w)).alias(f"hint_{i}") for i, w in enumerate(words)],
    )
    joined = roots.join(totals, "mission_id", "left")
    folder = spaced(F.coalesce("folder", F.lit("")))
    profile = F
    for profile_id, own in fv.PROFILE_HINTS:
        hit = F.lit(False)
        for word in own:
            hit = hit | folder.contains(word) | F.coalesce(F.col(f"hint_{words.index(word)}"), F.lit(False))
        profile = profile.when(hit, profile_id)
    clean = F.trim(F.regexp_replace(F.regexp_replace("folder", "[_-]+", " "), r"\s+", " "))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    return joined.select(
        "mission_id",
        F.coalesce(F.nullif(clean, F.lit("")), F.lit("Thermal mission")).alias("project_name"),
        zero("files"),
        zero("images"),
        zero("analysis_sources"),
        zero("total_bytes"),
        (F.coalesce("analysis_sources", F.lit(0)) > 0).alias("ready"),
        profile.otherwise("generic-thermal").alias("profile_id"),
    )


def resolve_sidecars(files: DataFrame) -> DataFrame:
    """Per raster, the first matching sidecar of every kind (same folder and stem)."""
    base = F.regexp_replace("path", r"\.[^./]+$", "")
    kinds = F.array(
        *[F.struct(F.lit(s).alias("ext"), F.lit(k).alias("kind"), F.lit(p).alias("priority")) for k, s, p in fv.SIDECAR_SUFFIXES]
    )
    rasters = files.where("is_analysis_source").select("mission_id", "path", base.alias("base"))
    wanted = rasters.withColumn("k", F.explode(kinds)).select("mission_id", "path", "base", "k.*")
    side = files.select("mission_id", F.col("path").alias("sidecar"), base.alias("base"), "ext")
    return wanted.join(side, ["mission_id", "base", "ext"]).groupBy("mission_id", "path", "kind").agg(
        F.min_by("sidecar", "priority").alias("sidecar")
    )


PLACEMARK = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("Point", T.StructType([T.StructField("coordinates", T.StringType())])),
    ]
)


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Point placemarks of many KML files; invalid coordinates are dropped."""
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(PLACEMARK).load(path)
    parts = F.split(F.trim("Point.coordinates"), ",")
    return (
        rows.select(
            F.col("_metadata.file_path").alias("file"),
            F.coalesce("name", F.lit("Unnamed")).alias("name"),
            F.try_element_at(parts, F.lit(2)).try_cast("double").alias("latitude"),
            F.try_element_at(parts, F.lit(1)).try_cast("double").alias("longitude"),
        )
        .where("latitude IS NOT NULL AND longitude IS NOT NULL")
    )


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """The last north, south, east and west value anywhere in each file, whatever element holds it."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def last(tag: str) -> Column:
        found = F.regexp_extract_all("value", F.lit(rf"<(?:[A-Za-z_][\w.-]*:)?{tag}(?:\s[^>]*)?>\s*([^<]*?)\s*</"), F.lit(1))
        return F.try_element_at(found, F.lit(-1)).try_cast("double").alias(tag)

    return texts.select("file", *[last(n) for n in ("north", "south", "east", "west")])


def placemark_bounds(placemarks: DataFrame, buffer: float = 0.001) -> DataFrame:
    """Fallback bounds of files with at least two placemarks."""
    return placemarks.groupBy("file").agg(
        F.count("*").alias("placemarks"),
        (F.max("latitude") + buffer).alias("north"),
        (F.min("latitude") - buffer).alias("south"),
        (F.max("longitude") + buffer).alias("east"),
        (F.min("longitude") - buffer).alias("west"),
    ).where("placemarks >= 2")


def kml_bounds(placemarks: DataFrame, boxes: DataFrame) -> DataFrame:
    """A complete box of the file wins over its placemark range."""
    complete = boxes.where("north IS NOT NULL AND south IS NOT NULL AND east IS NOT NULL AND west IS NOT NULL")
    box = complete.groupBy("file").agg(F.max(F.struct("north", "south", "east", "west")).alias("b")).select("file", "b.*")
    inferred = placemark_bounds(placemarks).drop("placemarks").join(box, "file", "left_anti")
    return box.withColumn("origin", F.lit("box")).unionByName(inferred.withColumn("origin", F.lit("placemarks")))


WORLD_FIELDS = ["x_pixel_size", "y_rotation", "x_rotation", "y_pixel_size", "x_center", "y_center"]


def read_world_files(spark: SparkSession, path: str) -> DataFrame:
    """Six numbers per file; anything else is an error row, not a failed job."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    parsed = texts.withColumn("lines", lines).withColumn(
        "numbers", F.transform("lines", lambda x: x.try_cast("double"))
    )
    good = (F.size("lines") == 6) & ~F.exists("numbers", lambda x: x.isNull())
    world = F.struct(*[F.get("numbers", F.lit(i)).alias(n) for i, n in enumerate(WORLD_FIELDS)])
    return parsed.select(
        "file",
        F.when(good, world).alias("world"),
        F.when(~good, F.lit("world file must contain exactly six numeric lines")).alias("error"),
    )


# The fields of a finding document in their order; free-form objects stay JSON text.
FINDING_FIELDS = """
    center_x int, center_y int, area_px long, max_temperature_c double, mean_temperature_c double, baseline_temperature_c double,
    delta_temperature_c double, severity string, finding_type string, latitude double, longitude double, notes string,
    finding_id string, inspection_id string, project_id string, source_image_id string, source_dataset_id string,
    source_path string, classification string, classification_rationale string, severity_rationale string,
    confidence string, confidence_components string, bbox array<int>, polygon array<array<int>>, hotspot_x int,
    hotspot_y int, min_temperature_c double, reference_temperature_c double, reference_method string,
    area_physical double, percentage_asset_affected double, morphology string, altitude double, source_sensor string,
    capture_time string, radiometric_provenance string, quality_status string, evidence array<string>,
    suppression_checks array<string>, recommendation string, ai_enrichment string, annotated_image_path string,
    crop_path string, visible_image_path string, duplicate_cluster_id string, canonical_finding_id string,
    supporting_observations array<string>, profile_id string, profile_version string, analysis_engine_version string,
    lifecycle_status string, created_at string, updated_at string, audit_trail array<string>
"""
FINDING_DOCUMENT = f"findings array<struct<frame_id long, {' '.join(FINDING_FIELDS.split())}>>"


def read_findings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Documents with a ``findings`` list; the defaults fill missing states."""
    docs = spark.read.schema(FINDING_DOCUMENT).option("multiLine", multi_line).json(path)
    rows = docs.select(F.explode("findings").alias("f")).select("f.*")
    defaults = {  # fixed values
        "severity": "minor",
        "confidence": "medium",
        "quality_status": "pass",
        "lifecycle_status": "new",
        "classification": "Thermal anomaly",
        "finding_type": "Thermal anomaly",
    }
    return rows.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in defaults.items()})
