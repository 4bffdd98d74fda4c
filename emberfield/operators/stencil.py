"""Neighbourhood operators: mirrored box sums, annular references, curvature, illumination.

One shuffle on (sheet, block) serves everything: each pixel is sent to the blocks whose halo it
falls in, mirrored ghosts included, and the row pass and column pass are two window sorts inside
that partitioning. RANGE frames on the pixel position make a missing pixel count as nodata.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.operators.sheets import BLOCK, BLOCK_KEYS, KEYS, WHOLE_FRAME, int_div


#: Rows, halo included, that a task of the window passes sorts, about. Their number sets the tasks: a pixel takes far fewer bytes in a
#: shuffle file than in a sort, so partitions merged by the size of the files would let a task's memory grow with the table.
HALO_ROWS = 1 << 20


def halo_tasks(sheets: DataFrame, radius: int, block: int = BLOCK, cells: Column | None = None) -> int:
    """Tasks for the window passes over ``sheets``, from their rows (or the sum of ``cells``, for rows of blocks) and extents."""
    grown = lambda n: (F.col(n) + F.ceil(F.col(n) / block) * 2 * radius) / F.col(n)
    each = grown("height") * grown("width") * (F.lit(1) if cells is None else cells)
    rows = round(sheets.agg(F.sum(each)).first()[0] or 0)
    spread = min(int(sheets.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * 16 / HALO_ROWS))
    return max(2, spread, math.ceil(rows / HALO_ROWS))  # one would be a single partition, not one by block


def mirrored_positions(index: Column, size: Column, radius: int) -> Column:
    """Padded positions a pixel index shows up at: reflection without repeating the edge."""
    period = (size - 1) * 2
    low_side = (index >= 1) & (index <= radius)
    high_side = (index >= size - 1 - radius) & (index <= size - 2)
    # plain CASE branches: no lambda, so the common path stays in generated code
    near = (
        F.when(low_side & high_side, F.array(index, -index, period - index))
        .when(low_side, F.array(index, -index))
        .when(high_side, F.array(index, period - index))
        .otherwise(F.array(index))
    )

    def copies(base: Column) -> Column:
        low = F.ceil((F.lit(-radius) - base) / period).cast("int")
        high = F.floor((size - 1 + radius - base) / period).cast("int")
        spread = F.transform(F.sequence(low, F.greatest(low, high)), lambda k: (base + k * period).cast("int"))
        return F.when(low <= high, spread).otherwise(F.array().cast("array<int>"))

    far = F.array_distinct(F.concat(copies(index), copies(-index)))
    single = F.sequence(F.lit(-radius), F.lit(radius))
    return F.when(size > radius, near).when(size == 1, single).otherwise(far)


def _blocks_of(position: Column, size: Column, radius: int, block: int) -> Column:
    last = int_div(size - 1, block)
    low = F.greatest(F.lit(0), int_div(position - radius, block))
    low = F.least(low, last)
    high = F.greatest(F.least(int_div(position + radius, block), last), F.lit(0))
    return F.when(high == low, F.array(low)).otherwise(F.array(low, high))


def with_halo(sheets: DataFrame, radius: int, block: int = BLOCK, carry: list[str] | None = None) -> DataFrame:
    """Replicate pixels into block halos (``p_row``/``p_col`` are padded positions)."""
    if block <= 2 * radius:
        raise ValueError("block must exceed twice the radius")
    rows, cols = F.col("height"), F.col("width")
    values = carry or ["temp_c"]
    return (
        sheets.select(*KEYS, "row_idx", *values, "height", "width",
                      F.explode(mirrored_positions(F.col("col_idx"), cols, radius)).alias("p_col"))
        .withColumn("blk_c", F.explode(_blocks_of(F.col("p_col"), cols, radius, block)))
        .withColumn("p_row", F.explode(mirrored_positions(F.col("row_idx"), rows, radius)))
        .withColumn("blk_r", F.explode(_blocks_of(F.col("p_row"), rows, radius, block)))
        .drop("row_idx")
    )


def _core(position: str, block_col: str, size: str, block: int) -> Column:
    start = F.col(block_col) * block
    return (F.col(position) >= start) & (F.col(position) < F.least(start + block, F.col(size)))


def box_sums(
    sheets: DataFrame,
    radii: list[int],
    value: str = "temp_c",
    block: int = BLOCK,
    neighbours: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """N1+N2: ``s{q}``, ``n{q}`` (sum and finite count of the (2q+1)² box) for every radius at once.

    With ``neighbours`` the four adjacent values come along (NULL when missing) for the curvature. ``tasks`` is counted
    (``halo_tasks``) where it is not given.
    """
    reach = max([*radii, 1])
    boxed = sorted({q for q in radii if q > 0})
    tasks = halo_tasks(sheets, reach, block) if tasks is None else tasks
    halo = with_halo(sheets, reach, block, [value]).repartition(tasks, *BLOCK_KEYS)
    along_cols = Window.partitionBy(*BLOCK_KEYS, "p_row").orderBy("p_col")
    row_pass = {}
    for q in boxed:
        frame = along_cols.rangeBetween(-q, q)
        row_pass[f"rs{q}"] = F.sum(value).over(frame)
        row_pass[f"rn{q}"] = F.count(value).over(frame)
    if neighbours:
        row_pass["v_left"] = F.max(value).over(along_cols.rangeBetween(-1, -1))
        row_pass["v_right"] = F.max(value).over(along_cols.rangeBetween(1, 1))
    swept = halo.withColumns(row_pass).where(_core("p_col", "blk_c", "width", block))
    along_rows = Window.partitionBy(*BLOCK_KEYS, "p_col").orderBy("p_row")
    col_pass = {}
    for q in boxed:
        frame = along_rows.rangeBetween(-q, q)
        col_pass[f"s{q}"] = F.coalesce(F.sum(f"rs{q}").over(frame), F.lit(0.0))
        col_pass[f"n{q}"] = F.coalesce(F.sum(f"rn{q}").over(frame), F.lit(0))
    if neighbours:
        col_pass["v_up"] = F.max(value).over(along_rows.rangeBetween(-1, -1))
        col_pass["v_down"] = F.max(value).over(along_rows.rangeBetween(1, 1))
    done = swept.withColumns(col_pass).where(_core("p_row", "blk_r", "height", block))
    for q in (q for q in radii if q <= 0):
        done = done.withColumns(
            {f"s{q}": F.coalesce(F.col(value), F.lit(0.0)), f"n{q}": F.col(value).isNotNull().cast("long")}
        )
    sums = [c for q in dict.fromkeys(radii) for c in (f"s{q}", f"n{q}")]
    around = ["v_left", "v_right", "v_up", "v_down"] if neighbours else []
    return done.select(
        *BLOCK_KEYS,
        F.col("p_row").alias("row_idx"),
        F.col("p_col").alias("col_idx"),
        value,
        "height",
        "width",
        *sums,
        *around,
    )


def box_mean(radius: int) -> Column:
    return F.col(f"s{radius}") / F.nullif(F.col(f"n{radius}"), F.lit(0))


def annular_reference(inner: int, outer: int) -> Column:
    """Mean of the outer box without the inner box, NULL without a finite sample."""
    if outer <= inner:
        raise ValueError("outer reference radius must exceed inner radius")
    count = F.col(f"n{outer}") - F.col(f"n{inner}")
    return (F.col(f"s{outer}") - F.col(f"s{inner}")) / F.when(count > 0, count)


def texture_curvature(scene_median: Column) -> Column:
    """|4-neighbour Laplacian|; nodata takes the scene median, the frame edge repeats itself."""
    centre = F.col("temp_c")
    at_edge = {
        "v_left": F.col("col_idx") == 0,
        "v_right": F.col("col_idx") == F.col("width") - 1,
        "v_up": F.col("row_idx") == 0,
        "v_down": F.col("row_idx") == F.col("height") - 1,
    }
    total = F.lit(0.0)
    for name, edge in at_edge.items():
        total = total + F.coalesce(F.when(edge, centre).otherwise(F.col(name)), scene_median)
    return F.abs(4.0 * centre - total)


def illumination_context(rgb: DataFrame, radius: int = 15, block: int = BLOCK) -> DataFrame:
    """N10 on ``(frame_id, row_idx, col_idx, r, g, b, height, width, image_max)``.

    ``image_max`` decides whether channels are bytes; it is a per-image value carried by the rows.
    """
    level = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    sheets = rgb.select(
        "frame_id",
        F.expr(WHOLE_FRAME).alias("tile_id"),
        "row_idx",
        "col_idx",
        F.when(F.col("image_max") > 1.0, level / 255.0).otherwise(level).alias("brightness"),
        "height",
        "width",
    )
    boxed = box_sums(sheets, [radius], "brightness", block).withColumn("illumination_field", box_mean(radius))
    shadow = (F.col("illumination_field") - F.col("brightness")) / F.greatest(F.col("illumination_field"), F.lit(1e-6))
    return boxed.select(
        "frame_id",
        "row_idx",
        "col_idx",
        "brightness",
        "illumination_field",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), shadow)).alias("shadow_score"),
    )
