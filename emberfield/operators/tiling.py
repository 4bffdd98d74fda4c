"""Tile grid, halo replication, core ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.operators.detection import Detection, detect, rank_findings
from emberfield.operators.evidence import DetectionSettings
from emberfield.operators.sheets import KEYS, int_div


def tile_overlap(radii: tuple[int, ...]) -> int:
    return max(fv.TILE_OVERLAP, 2 * max(radii))


def tile_grid(frames: DataFrame, size: int = fv.TILE_SIZE, overlap: int = fv.TILE_OVERLAP) -> DataFrame:
    """Cores of ``size`` with read windows grown by ``overlap`` and clamped to the frame."""
    if size <= 0 or overlap < 0:
        raise ValueError("tile size must be positive and overlap non-negative")
    last = lambda n: int_div(F.col(n) - 1, size)
    t = (
        frames.select("frame_id", "height", "width")
        .withColumn("tile_r", F.explode(F.sequence(F.lit(0), last("height"))))
        .withColumn("tile_c", F.explode(F.sequence(F.lit(0), last("width"))))
        .withColumn("tile_id", F.col("tile_r") * (last("width") + 1) + F.col("tile_c"))
    )

    def axis(index: str, limit: str, name: str) -> dict[str, Column]:
        start = F.col(index) * size
        stop = F.least(start + size, F.col(limit))
        read = F.greatest(F.lit(0), start - overlap)
        read_stop = F.least(F.col(limit), stop + overlap)
        word = {"row": "height", "col": "width"}[name]
        return {
            f"core_{name}_off": start,
            f"core_{word}": stop - start,
            f"read_{name}_off": read,
            f"read_{word}": read_stop - read,
        }

    return t.withColumns({**axis("tile_r", "height", "row"), **axis("tile_c", "width", "col")})


def tile_sheets(pixels: DataFrame, size: int = fv.TILE_SIZE, overlap: int = fv.TILE_OVERLAP) -> DataFrame:
    """Every pixel once per read window holding it, in tile-local coordinates.

    Tiles follow from arithmetic on the pixel itself, so there is no join and no shuffle here.
    """

    def windows(index: str, limit: str) -> Column:
        last = int_div(F.col(limit) - 1, size)
        low = F.greatest(F.lit(0), int_div(F.col(index) - overlap, size))
        high = F.least(last, int_div(F.col(index) + overlap, size))
        return F.explode(F.sequence(low, high))

    p = pixels.withColumn("tile_r", windows("row_idx", "height")).withColumn("tile_c", windows("col_idx", "width"))

    def local(tile: str, index: str, limit: str) -> tuple[Column, Column]:
        start = F.greatest(F.lit(0), F.col(tile) * size - overlap)
        stop = F.least(F.col(limit), F.least((F.col(tile) + 1) * size, F.col(limit)) + overlap)
        return (F.col(index) - start).cast("int"), (stop - start).cast("int")

    row, height = local("tile_r", "row_idx", "height")
    col, width = local("tile_c", "col_idx", "width")
    columns = int_div(F.col("width") - 1, size) + 1
    return p.select(
        "frame_id",
        (F.col("tile_r") * columns + F.col("tile_c")).cast("int").alias("tile_id"),
        row.alias("row_idx"),
        col.alias("col_idx"),
        F.col("temp_c").cast("double").alias("temp_c"),
        height.alias("height"),
        width.alias("width"),
    )


def core_pixels(sheets: DataFrame, grid: DataFrame) -> DataFrame:
    """Each pixel once, with its owning tile, back in frame coordinates."""
    s = sheets.drop("height", "width").join(
        grid.select(*KEYS, "height", "width", "read_row_off", "read_col_off", "core_row_off", "core_col_off", "core_height", "core_width"),
        KEYS,
    ).withColumns(
        {"row_idx": F.col("row_idx") + F.col("read_row_off"), "col_idx": F.col("col_idx") + F.col("read_col_off")}
    )
    return s.where(_in_core("col_idx", "row_idx"))


def _in_core(x: str, y: str) -> Column:
    return (
        (F.col(x) >= F.col("core_col_off"))
        & (F.col(x) < F.col("core_col_off") + F.col("core_width"))
        & (F.col(y) >= F.col("core_row_off"))
        & (F.col(y) < F.col("core_row_off") + F.col("core_height"))
    )


def own_findings(d: Detection, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and suppressions whose centre lies in their tile's core, shifted to the frame."""
    place = grid.select(
        *KEYS, "read_row_off", "read_col_off", "core_row_off", "core_col_off", "core_height", "core_width"
    )

    def owned(df: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
        moved = df.join(place, KEYS).withColumns(
            {
                **{x: F.col(x) + F.col("read_col_off") for x in xs},
                **{y: F.col(y) + F.col("read_row_off") for y in ys},
            }
        )
        if "polygon" in df.columns:
            moved = moved.withColumn(
                "polygon",
                F.transform(
                    "polygon",
                    lambda p: F.struct((p["x"] + F.col("read_col_off")).alias("x"), (p["y"] + F.col("read_row_off")).alias("y")),
                ),
            )
        kept = moved.where(_in_core("center_x", "center_y"))
        return kept.drop(*[c for c in place.columns if c not in KEYS])

    findings = owned(
        d.findings.drop("rank", "finding_id", "canonical_finding_id"),
        ["center_x", "hotspot_x", "bbox_left", "bbox_right"],
        ["center_y", "hotspot_y", "bbox_top", "bbox_bottom"],
    )
    return rank_findings(findings, rows=d.components.count()), owned(d.suppressions, ["center_x"], ["center_y"])


def detect_tiled(
    pixels: DataFrame,
    frames: DataFrame,
    settings: DetectionSettings = DetectionSettings(),
    size: int = fv.TILE_SIZE,
    overlap: int | None = None,
) -> tuple[DataFrame, DataFrame, Detection]:
    """Tile-scope detection: scene statistics and regions per tile including its halo, then ownership."""
    overlap = tile_overlap(settings.radii) if overlap is None else overlap
    d = detect(tile_sheets(pixels, size, overlap), settings)
    findings, suppressions = own_findings(d, tile_grid(frames, size, overlap))
    return findings, suppressions, d
