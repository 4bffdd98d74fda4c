"""Finding registers, summaries, provenance and report projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberfield import ENGINE_VERSION
from emberfield import fixed_values as fv
from emberfield.functions.columns import fixed, signed, text_lookup

SEVERITIES = ["critical", "moderate", "minor"]


def profiles(spark: SparkSession) -> DataFrame:
    """the profile catalogue. Ten fixed rows, so joins to it may broadcast."""
    rows = [
        (
            *row,
            fv.RECOMMENDATION_MINOR,
            fv.PROFILE_RECOMMENDATION_MODERATE.get(row[0], fv.RECOMMENDATION_MODERATE),
            fv.PROFILE_RECOMMENDATION_CRITICAL.get(row[0], fv.RECOMMENDATION_CRITICAL),
        )
        for row in fv.PROFILE_ROWS
    ]
    return spark.createDataFrame(
        rows,
        "profile_id string, name string, version string, minimum_delta_c double, minimum_area_px int, "
        "moderate_delta_c double, critical_delta_c double, finding_label string, recommendation_minor string, "
        "recommendation_moderate string, recommendation_critical string",
    )


def with_profile(df: DataFrame, column: str = "profile_id") -> DataFrame:
    """Profile columns for a trimmed, case-insensitive id; blank means the generic profile."""
    key = F.lower(F.trim(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("generic-thermal"))))
    catalogue = F.broadcast(profiles(df.sparkSession).withColumnRenamed("profile_id", "_profile"))
    return df.withColumn("_key", key).join(catalogue, F.col("_key") == F.col("_profile")).drop("_key", "_profile")


def unknown_profiles(df: DataFrame, column: str = "profile_id") -> DataFrame:
    known = [row[0] for row in fv.PROFILE_ROWS]
    key = F.lower(F.trim(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("generic-thermal"))))
    return df.where(~key.isin(known))


def recommendation(severity: Column, profile_id: Column | None = None) -> Column:
    """the profile's text, or the default text without a profile."""
    if profile_id is None:
        return text_lookup(severity, fv.DEFAULT_RECOMMENDATION)
    moderate = text_lookup(profile_id, fv.PROFILE_RECOMMENDATION_MODERATE, F.lit(fv.RECOMMENDATION_MODERATE))
    critical = text_lookup(profile_id, fv.PROFILE_RECOMMENDATION_CRITICAL, F.lit(fv.RECOMMENDATION_CRITICAL))
    return F.when(severity == "critical", critical).when(severity == "moderate", moderate).otherwise(fv.RECOMMENDATION_MINOR)


def stamp_provenance(
    findings: DataFrame,
    frames: DataFrame,
    quality: DataFrame,
    project: dict[str, str],
    adapter: str = "pixel-table",
    calibration: dict[str, float] | None = None,
) -> DataFrame:
    """Project, source, sensor, quality, calibration and recommendation columns."""
    cal = {"emissivity": 0.95, "distance_m": 5.0, "relative_humidity": 0.5, "reflected_temperature_c": 20.0}
    cal.update(calibration or {})
    sensor = " ".join(filter(None, [project.get("sensor_vendor"), project.get("sensor_model")]))
    stamped = findings.join(frames.select("frame_id", "source_path", "capture_time"), "frame_id", "left").join(
        quality.select("frame_id", F.col("status").alias("quality_status")), "frame_id", "left"
    )
    provenance = F.struct(
        F.lit(adapter).alias("adapter"),
        "quality_status",
        F.struct(*[F.lit(float(cal[k])).alias(k) for k in list(cal)[:4]]).alias("calibration"),
    )
    return stamped.withColumns(
        {
            "inspection_id": F.lit(project.get("inspection_id", "")),
            "project_id": F.lit(project.get("project_id", "")),
            "source_image_id": F.element_at(F.split("source_path", "/"), -1),
            "source_sensor": F.lit(sensor),
            "radiometric_provenance": provenance,
            "analysis_engine_version": F.lit(ENGINE_VERSION),
            "recommendation": recommendation(F.col("severity"), F.col("profile_id")),
            "notes": F.lit(""),
        }
    )


def observation_ids(findings: DataFrame, frames: DataFrame) -> DataFrame:
    """``OBS-%05d-%03d`` from the 1-based source number (failed sources leave gaps) and the rank."""
    numbered = findings.join(frames.select("frame_id", "input_order"), "frame_id")
    return numbered.withColumn(
        "finding_id", F.format_string("OBS-%05d-%03d", F.col("input_order") + 1, F.col("rank"))
    ).withColumn("obs_ord", F.shiftleft(F.col("input_order").cast("long"), 32) + F.col("rank"))


def finding_frames(findings: DataFrame, frames: DataFrame) -> DataFrame:
    """Look the frame of a finding up by its source path; unknown paths keep NULL."""
    return findings.join(frames.select("source_path", F.col("frame_id").alias("source_frame")), "source_path", "left")


def inspection_summary(
    quality: DataFrame,
    observations: DataFrame,
    canonical: DataFrame,
    frames: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """One row. All inputs are stacked as narrow rows of flags and meet in one combinable aggregate.

    With ``frames`` and ``failures`` every source counts as discovered and every failed one as rejected, also those
    that failed before the gate and so have no quality row.
    """
    one = lambda name, test: F.when(test, F.lit(1)).alias(name)
    accepted = F.col("status") != "rejected"
    alone = frames is None or failures is None
    rows = [
        quality.select(
            one("images_accepted", accepted),
            one("images_warned", accepted & (F.size("warnings") > 0)),
            *([one("images_discovered", F.lit(True)), one("images_rejected", ~accepted)] if alone else []),
        ),
        observations.select(one("observations", F.lit(True))),
        canonical.select(
            one("canonical_findings", F.lit(True)),
            *[one(s, F.col("severity") == s) for s in SEVERITIES],
            F.col("max_temperature_c").alias("highest_temperature_c"),
            F.col("delta_temperature_c").alias("highest_delta_c"),
        ),
    ]
    if not alone:
        rows.append(frames.select(one("images_discovered", F.lit(True))))
        rows.append(failures.select("frame_id").distinct().select(one("images_rejected", F.lit(True))))
    stacked = rows[0]
    for part in rows[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    counts = ["images_discovered", "images_accepted", "images_warned", "images_rejected", "observations", "canonical_findings", *SEVERITIES]
    return stacked.agg(
        *[F.count(n).alias(n) for n in counts],
        *[F.max(n).alias(n) for n in ("highest_temperature_c", "highest_delta_c")],
    )


def frame_summaries(statistics: DataFrame, quality: DataFrame, findings: DataFrame) -> DataFrame:
    """A6 for single frames: the highest temperature falls back to the frame maximum."""
    per = findings.groupBy("frame_id").agg(
        F.count("*").alias("observations"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
        F.max("max_temperature_c").alias("top_c"),
        F.max("delta_temperature_c").alias("highest_delta_c"),
    )
    base = statistics.join(quality.where("status <> 'rejected'").select("frame_id", "warnings"), "frame_id")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    return base.join(per, "frame_id", "left").select(
        "frame_id",
        (F.size("warnings") > 0).cast("int").alias("images_warned"),
        zero("observations"),
        *[zero(s) for s in SEVERITIES],
        F.coalesce("top_c", "maximum_c").alias("highest_temperature_c"),
        "highest_delta_c",
    )


def severity_counts(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long, zero-filled severity counts per key (or overall)."""
    keys = keys or []
    counts = findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.select(*keys, F.stack(F.lit(3), *[x for s in SEVERITIES for x in (F.lit(s), F.col(s))]).alias("severity", "n"))


def type_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("finding_type").agg(F.count("*").alias("n"))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Counts by frame and severity with subtotals."""
    return findings.rollup("frame_id", "severity").agg(
        F.count("*").alias("n"), F.max("delta_temperature_c").alias("highest_delta_c")
    )


def action_advice(findings: DataFrame) -> DataFrame:
    """Advice lines by severity count; a line without findings is left out."""
    lines = severity_counts(findings).where("n > 0")
    text = (
        F.when(
            F.col("severity") == "critical",
            F.format_string("%d critical anomalies detected. Immediate inspection and repair required.", F.col("n")),
        )
        .when(
            F.col("severity") == "moderate",
            F.format_string("%d moderate anomalies detected. Schedule maintenance within the next month.", F.col("n")),
        )
    )
    return lines.withColumn("advice", text).where("advice IS NOT NULL").select("severity", "advice")


def portfolio(projects: DataFrame, findings: DataFrame, rejected_sources: DataFrame) -> DataFrame:
    """One row over projects, findings and rejected sources."""
    p = projects.agg(F.count("*").alias("projects"), F.sum(F.size("datasets")).alias("datasets"))
    f = findings.agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("severity") == "critical").alias("critical_findings"),
        F.count_if(F.col("lifecycle_status") == "action_required").alias("action_required"),
    )
    r = rejected_sources.agg(F.count("*").alias("rejected_sources"))
    stacked = p.unionByName(f, allowMissingColumns=True).unionByName(r, allowMissingColumns=True)
    return stacked.agg(*[F.max(n).alias(n) for n in stacked.columns])


def search_projects(projects: DataFrame, query: str = "", profile_id: str = "", client: str = "") -> DataFrame:
    """text over name, site, client, location and tags, exact profile, case-insensitive client."""
    out = projects
    text = query.strip().lower()
    if text:
        hay = F.lower(F.concat_ws(" ", "name", "site", "client", "location", F.concat_ws(" ", "tags")))
        out = out.where(hay.contains(text))
    if profile_id:
        out = out.where(F.col("profile_id") == profile_id)
    if client:
        out = out.where(F.lower("client") == client.lower())
    return out


def search_findings(findings: DataFrame, query: str = "", severity: str | None = None) -> DataFrame:
    out = findings
    text = query.strip().lower()
    if text:
        out = out.where(F.lower(F.concat_ws(" ", "finding_id", "classification", "source_path")).contains(text))
    return out if severity is None else out.where(F.col("severity") == severity)


def explicit_locations(projects: DataFrame) -> DataFrame:
    """only coordinates that are numbers in range; nothing is geocoded."""
    number = lambda k: F.try_element_at("metadata", F.lit(k)).try_cast("double")
    return projects.withColumns({"latitude": number("latitude"), "longitude": number("longitude")}).where(
        F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    )


def location_text(digits: int = 5) -> Column:
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return F.when(both, F.concat_ws(", ", fixed(F.col("latitude"), digits), fixed(F.col("longitude"), digits)))


def finding_label() -> Column:
    """the annotation label."""
    return F.concat(
        F.coalesce(F.nullif(F.col("finding_id"), F.lit("")), F.lit("FINDING")),
        F.lit("  "),
        fixed(F.col("max_temperature_c"), 1),
        F.lit(" C  dT "),
        signed(F.col("delta_temperature_c"), 1),
        F.lit(" C  "),
        F.upper("severity"),
        F.lit(" / "),
        F.upper("confidence"),
    )


def listed_text(values: Column) -> Column:
    """An array of strings as a quoted list; a text with an apostrophe and without quotes stands in double quotes."""
    escaped = lambda x: F.replace(x, F.lit("\\"), F.lit("\\\\"))
    single = lambda x: F.concat(F.lit("'"), F.replace(escaped(x), F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = lambda x: F.concat(F.lit('"'), escaped(x), F.lit('"'))
    quoted = F.transform(values, lambda x: F.when(x.contains("'") & ~x.contains('"'), double(x)).otherwise(single(x)))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def prompt_lines(project: dict[str, str] | None = None) -> Column:
    """the text handed to an external narrator: instructions, quantitative context, evidence and project."""
    three = lambda n: fixed(F.col(n), 3)
    return F.concat_ws(
        "\n",
        *[F.lit(line) for line in fv.PROMPT_INSTRUCTIONS],
        F.concat(F.lit("Industry/profile: "), F.col("profile_id")),
        F.concat(F.lit("Finding ID: "), F.col("finding_id")),
        F.concat(F.lit("Classification: "), F.coalesce(F.nullif(F.col("classification"), F.lit("")), F.col("finding_type"))),
        F.concat(F.lit("Severity authority: "), F.col("severity")),
        F.concat(F.lit("Evidence confidence authority: "), F.col("confidence")),
        F.concat(F.lit("Maximum temperature: "), three("max_temperature_c"), F.lit(" C")),
        F.concat(
            F.lit("Local reference: "),
            fixed(F.coalesce("reference_temperature_c", "baseline_temperature_c"), 3),
            F.lit(" C"),
        ),
        F.concat(F.lit("Local delta-T: "), three("delta_temperature_c"), F.lit(" C")),
        F.concat(F.lit("Area: "), F.col("area_px").cast("string"), F.lit(" pixels")),
        F.concat(F.lit("Evidence: "), listed_text(F.coalesce("evidence", F.array().cast("array<string>")))),
        F.lit(f"Project context: {dict(project or {})}"),
    )


def finding_details(findings: DataFrame) -> DataFrame:
    """the detail view of a finding."""
    return findings.select(
        F.col("finding_id").alias("id"),
        F.coalesce(F.nullif(F.col("classification"), F.lit("")), F.col("finding_type")).alias("classification"),
        "severity",
        "confidence",
        "max_temperature_c",
        "reference_temperature_c",
        "delta_temperature_c",
        F.when(
            F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.array("latitude", "longitude")
        ).alias("location"),
        F.col("source_path").alias("source"),
        "evidence",
        "recommendation",
        F.col("lifecycle_status").alias("status"),
    )


def report_rows(findings: DataFrame) -> DataFrame:
    """K9: the findings table of the report with all evidence."""
    return findings.select(
        "frame_id",
        F.col("finding_id").alias("id"),
        F.coalesce(F.nullif(F.col("classification"), F.lit("")), F.col("finding_type")).alias("classification"),
        F.upper("severity").alias("severity"),
        F.upper("confidence").alias("confidence"),
        fixed(F.col("max_temperature_c"), 1).alias("max_c"),
        fixed(F.col("delta_temperature_c"), 1).alias("delta_c"),
        F.coalesce(location_text(5), F.lit("—")).alias("location"),
        F.col("evidence"),
        F.coalesce(F.nullif(F.col("recommendation"), F.lit("")), recommendation(F.col("severity"))).alias("recommendation"),
    )


def _wrapped(line: Column) -> Column:
    return F.when(F.length(line) <= 64, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit("(?s).{1,64}"), F.lit(0)))


def plate_lines(findings: DataFrame) -> DataFrame:
    """K9: text lines of a finding plate, with all evidence; longer lines are wrapped at 64 characters."""
    reference = F.coalesce("reference_temperature_c", "baseline_temperature_c")
    head = F.array(
        F.col("finding_id"),
        F.concat(F.lit("Classification: "), F.coalesce(F.nullif(F.col("classification"), F.lit("")), F.col("finding_type"))),
        F.concat(F.lit("Severity: "), F.upper("severity")),
        F.concat(F.lit("Confidence: "), F.upper("confidence")),
        F.concat(F.lit("Maximum: "), fixed(F.col("max_temperature_c"), 1), F.lit(" C")),
        F.concat(F.lit("Reference: "), fixed(reference, 1), F.lit(" C")),
        F.concat(F.lit("Delta T: "), signed(F.col("delta_temperature_c"), 1), F.lit(" C")),
        F.concat(F.lit("Area: "), F.col("area_px").cast("string"), F.lit(" px")),
        F.concat(F.lit("Reference: "), F.coalesce(F.nullif(F.col("reference_method"), F.lit("")), F.lit("not established"))),
    )
    place = F.array_compact(F.array(F.concat(F.lit("Location: "), location_text(6))))
    evidence = F.transform("evidence", lambda x: F.concat(F.lit("- "), x))
    advice = F.coalesce(
        F.nullif(F.col("recommendation"), F.lit("")), F.nullif(F.col("notes"), F.lit("")), F.lit("Field verification recommended.")
    )
    lines = F.concat(
        head, place, F.array(F.lit(""), F.lit("Evidence:")), evidence, F.array(F.lit(""), F.lit("Recommendation:"), advice)
    )
    return findings.select(
        "frame_id", "finding_id", F.flatten(F.transform(lines, _wrapped)).alias("lines")
    )


def executive_summary(summary: DataFrame, statistics: DataFrame) -> DataFrame:
    """K9: label/value rows in report order from the one-row summary and the frame statistics."""
    top = statistics.agg(F.max("maximum_c").alias("maximum_c"))
    s = summary.unionByName(top, allowMissingColumns=True)
    s = s.agg(*[F.max(n).alias(n) for n in s.columns])
    text = lambda n: F.col(n).cast("string")
    rows = [
        ("Images accepted / discovered", F.concat_ws(" / ", text("images_accepted"), text("images_discovered"))),
        ("Canonical findings", text("canonical_findings")),
        ("Critical", text("critical")),
        ("Moderate", text("moderate")),
        ("Minor", text("minor")),
        ("Highest temperature", F.concat(fixed(F.col("maximum_c"), 1), F.lit(" °C"))),
        (
            "Highest local ΔT",
            F.when(F.col("canonical_findings") > 0, F.concat(fixed(F.col("highest_delta_c"), 1), F.lit(" °C"))).otherwise("—"),
        ),
    ]
    pairs = [x for i, (label, value) in enumerate(rows) for x in (F.lit(i), F.lit(label), value)]
    return s.select(F.stack(F.lit(len(rows)), *pairs).alias("line", "label", "value"))


def information_rows(projects: DataFrame) -> DataFrame:
    """K9: project information rows, blanks dropped."""
    rows = [
        ("Project", F.col("name")),
        ("Client", F.col("client")),
        ("Site", F.col("site")),
        ("Inspection date", F.col("inspection_date")),
        ("Operator", F.col("operator")),
        ("Asset type", F.col("asset_type")),
        ("Sensor", F.concat_ws(" ", F.nullif(F.col("sensor_vendor"), F.lit("")), F.nullif(F.col("sensor_model"), F.lit("")))),
        ("Profile", F.col("profile_id")),
    ]
    pairs = [x for i, (label, value) in enumerate(rows) for x in (F.lit(i), F.lit(label), value)]
    return projects.select("project_id", F.stack(F.lit(len(rows)), *pairs).alias("line", "label", "value")).where(
        "value IS NOT NULL AND value <> ''"
    )


AUTHORITY = [
    "max_temperature_c",
    "mean_temperature_c",
    "baseline_temperature_c",
    "delta_temperature_c",
    "severity",
    "confidence",
    "bbox_left",
    "bbox_top",
    "bbox_right",
    "bbox_bottom",
    "polygon",
    "latitude",
    "longitude",
    "classification",
    "finding_id",
]


def attach_narrative(findings: DataFrame, enrichments: DataFrame, key: str = "finding_id") -> DataFrame:
    """Append narrative columns by id; a narrative adds text and nothing else.

    ``enrichments`` may not carry any other finding column: that is checked by name up front. Of several narratives for one
    id the least by its columns is taken, so that none multiplies a finding; ``narratives`` counts them.
    """
    clash = set(enrichments.columns) & (set(findings.columns) - {key})
    if clash:
        raise ValueError(f"narrative tables may not replace finding columns: {sorted(clash)}")
    texts = [c for c in enrichments.columns if c != key]
    one = enrichments.groupBy(key).agg(F.min(F.struct(*texts)).alias("text"), F.count("*").alias("narratives"))
    return findings.join(one, key, "left").select(
        *findings.columns, *[F.col(f"text.{c}").alias(c) for c in texts], F.coalesce("narratives", F.lit(0)).alias("narratives")
    )


def authority_check(findings: DataFrame, enriched: DataFrame, key: str) -> DataFrame:
    """``(key, state)`` of the enriched table against the findings it was made from: kept, changed, lost or added.

    Rows meet by key, so whatever was done to the authority fields after the narratives were attached shows.
    """
    shared = [c for c in AUTHORITY if c in findings.columns and c in enriched.columns]
    told = lambda df, name: df.groupBy(key).agg(F.count("*").alias(f"n_{name}"), F.sum(F.xxhash64(*shared).cast("decimal(38,0)")).alias(name))
    both = told(findings, "before").join(told(enriched, "after"), key, "full_outer")
    same = (F.col("before") == F.col("after")) & (F.col("n_before") == F.col("n_after"))
    state = F.when(F.col("after").isNull(), "lost").when(F.col("before").isNull(), "added").when(same, "kept").otherwise("changed")
    return both.select(key, state.alias("state"))


def ranked_findings(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """O1: ΔT descending with a stable tie-break."""
    ordered = findings.orderBy(F.desc("delta_temperature_c"), "frame_id", "tile_id", "label")
    return ordered if limit is None else ordered.limit(limit)


def latest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key by a combinable aggregate."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("row"))
    return best.select(key, *[F.col(f"row.{c}").alias(c) for c in others])


def number_rows(findings: DataFrame, keys: list[str], order: list) -> DataFrame:
    return findings.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
