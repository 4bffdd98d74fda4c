"""Queries on regions of interest and presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.operators import render, roi, stencil
from emberfield.plans.catalog import query, tidy
from emberfield.plans.detector import sheets
from emberfield.plans.sql import r, with_tables
from emberfield.sources import derived

SHAPES = [
    ("spot", 12.0, 12.0, None, None, None, None, None, None, None, 4, None),
    ("rectangle", 14.0, 7.0, 9.0, 12.0, None, None, None, None, None, None, None),
    ("circle", None, None, None, None, 12.0, 10.0, 5.0, None, None, None, None),
    ("ellipse", None, None, None, None, 12.0, 10.0, 7.0, 3.0, None, None, None),
    ("line", 2.0, 2.0, 20.0, 17.0, None, None, None, None, 2.0, None, None),
    ("polygon", None, None, None, None, None, None, None, None, None, None, [(4.0, 4.0), (18.0, 4.0), (18.0, 16.0), (4.0, 16.0)]),
]


def rois(spark: SparkSession, sf: str) -> DataFrame:
    """Six shapes on every frame of the pixel stream."""
    kinds = "struct<kind:string,x0:double,y0:double,x1:double,y1:double,cx:double,cy:double,rx:double,ry:double,width_px:double,kernel:int,points:array<struct<x:double,y:double>>>"
    names = ["kind", "x0", "y0", "x1", "y1", "cx", "cy", "rx", "ry", "width_px", "kernel"]

    def literal(shape: tuple):
        points = F.lit(None) if shape[11] is None else F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in shape[11]])
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, shape)], points.alias("points")).cast(kinds)

    shapes = F.explode(F.array(*[literal(s) for s in SHAPES]))
    return (
        derived.frames(spark, sf)
        .select("frame_id", "height", "width", shapes.alias("s"))
        .select("frame_id", "height", "width", F.col("s.kind").alias("roi_id"), "s.*")
    )


@query(
    "roi_pixels",
    with_tables(["rois"], "SELECT frame_id, roi_id, row_idx, col_idx FROM roi_px"),
)
def roi_pixels(spark, sf):
    p = roi.roi_pixels(derived.pixels(spark, sf), roi.prepare_rois(rois(spark, sf)))
    return tidy(p.select("frame_id", "roi_id", "row_idx", "col_idx"))


@query(
    "roi_statistics",
    with_tables(
        ["rois"],
        f"""SELECT frame_id, roi_id, {r('min(temp_c)', 'minimum_c')}, {r('max(temp_c)', 'maximum_c')}, {r('avg(temp_c)', 'mean_c')}, {r('median(temp_c)', 'median_c')},
        {r('stddev_pop(temp_c)', 'stddev_c')}, {r('quantile_cont(temp_c, 0.95)', 'p95_c')}, count(temp_c) AS valid_pixels FROM roi_px GROUP BY frame_id, roi_id""",
    ),
)
def roi_statistics(spark, sf):
    return tidy(roi.roi_statistics(derived.pixels(spark, sf), rois(spark, sf)))


@query(
    "roi_failures",
    """SELECT o_orderkey AS roi_id, o_orderkey // 500 AS frame_id, CASE WHEN o_orderkey % 40 = 0 THEN 'kernel_size must be positive' ELSE 'spot is outside the temperature matrix' END AS error
    FROM orders WHERE o_orderkey % 40 = 0 OR o_custkey % 30 >= 25""",
)
def roi_failures(spark, sf):
    """One spot per order, some off the frame or without a kernel."""
    spots = derived.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS roi_id", "o_orderkey div 500 AS frame_id", "'spot' AS kind", "CAST(o_custkey % 30 AS DOUBLE) AS x0", "CAST(o_custkey % 20 AS DOUBLE) AS y0",
        "CAST(NULL AS DOUBLE) AS x1", "CAST(NULL AS DOUBLE) AS y1", "CAST(NULL AS DOUBLE) AS cx", "CAST(NULL AS DOUBLE) AS cy", "CAST(NULL AS DOUBLE) AS rx",
        "CAST(NULL AS DOUBLE) AS ry", "CAST(NULL AS DOUBLE) AS width_px", "IF(o_orderkey % 40 = 0, 0, 4) AS kernel",
        "CAST(NULL AS ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>) AS points", "20 AS height", "25 AS width",
    )
    return tidy(roi.roi_failures(spots, roi.roi_statistics(derived.pixels(spark, sf), spots)))


@query(
    "spot_delta",
    with_tables(
        ["pixels"],
        f"""SELECT frame_id, 1 AS pair_id, {r('avg(temp_c) FILTER (col_idx BETWEEN 10 AND 13 AND row_idx BETWEEN 8 AND 11) - avg(temp_c) FILTER (col_idx BETWEEN 1 AND 4 AND row_idx BETWEEN 14 AND 17)', 'delta_c')}
        FROM pixels GROUP BY frame_id""",
    ),
)
def spot_delta(spark, sf):
    pairs = derived.frames(spark, sf).selectExpr("frame_id", "1 AS pair_id", "2 AS x0", "15 AS y0", "11 AS x1", "9 AS y1", "height", "width")
    return tidy(roi.spot_delta(derived.pixels(spark, sf), pairs))


LIMIT_SQL = """lim AS (SELECT frame_id, quantile_cont(temp_c, 0.02) AS low, quantile_cont(temp_c, 0.98) AS high FROM pixels GROUP BY frame_id),
pos AS (SELECT p.*, CASE WHEN temp_c IS NULL THEN 0 ELSE greatest(0, least(1, (temp_c - low) / (high - low))) END AS x FROM pixels p JOIN lim USING (frame_id))"""


@query(
    "automatic_style",
    with_tables(["pixels"], "").rstrip() + ",\n" + LIMIT_SQL
    + f" SELECT frame_id, {r('low', 'low_c')}, {r('high', 'high_c')}, {r('high - low', 'span_c')}, {r('(low + high) / 2', 'level_c')} FROM lim",
)
def automatic_style(spark, sf):
    return tidy(render.automatic_limits(sheets(spark, sf)).drop("tile_id", "height", "width"))


def _channel_sql(palette: str, channel: int, position: str = "x") -> str:
    anchors = fv.PALETTES[palette]
    parts = [f"WHEN {position} <= {anchors[0][0]} THEN {anchors[0][1][channel]}"]
    for (p0, c0), (p1, c1) in zip(anchors, anchors[1:]):
        parts.append(
            f"WHEN {position} <= {p1} THEN {c0[channel]} + ({c1[channel] - c0[channel]})::DOUBLE / ({p1} - {p0})::DOUBLE * ({position} - {p0})"
        )
    return f"CAST(round_even(CASE {' '.join(parts)} ELSE {anchors[-1][1][channel]} END, 0) AS BIGINT)"


def _rendered(palette: str) -> str:
    chans = ", ".join(f"{_channel_sql(palette, i)} AS {c}" for i, c in enumerate("rgb"))
    return with_tables(["pixels"], "").rstrip() + ",\n" + LIMIT_SQL + f" SELECT frame_id, row_idx, col_idx, {chans} FROM pos"


def _palette_query(palette: str):
    @query(f"rendered_{palette.replace('-', '_')}", _rendered(palette))
    def rendered(spark, sf):
        s = sheets(spark, sf)
        out = render.render(s, render.style_limits(s), palette)
        return tidy(out.drop("tile_id", "temp_c"))

    return rendered


for _name in fv.PALETTES:
    _palette_query(_name)


@query(
    "rendered_span_isotherm",
    with_tables(["pixels"], "").rstrip()
    + ", pos AS (SELECT *, CASE WHEN temp_c IS NULL THEN 0 ELSE greatest(0, least(1, (temp_c - 30) / 20.0)) END AS x FROM pixels) SELECT frame_id, row_idx, col_idx, "
    + ", ".join(
        f"CASE WHEN temp_c BETWEEN 45 AND 60 THEN {fv.ISOTHERM_RGB[i]} ELSE {_channel_sql('gray', i)} END AS {c}" for i, c in enumerate("rgb")
    )
    + " FROM pos",
)
def rendered_span_isotherm(spark, sf):
    s = sheets(spark, sf)
    out = render.render(s, render.style_limits(s, span=20.0, level=40.0), "gray", (45.0, 60.0))
    return tidy(out.drop("tile_id", "temp_c"))


@query(
    "grayscale",
    with_tables(["pixels"], "").rstrip() + ",\n" + LIMIT_SQL
    + " SELECT frame_id, row_idx, col_idx, CAST(floor(x * 255.0::DOUBLE) AS BIGINT) AS gray_truncated, CAST(round_even(x * 255.0::DOUBLE, 0) AS BIGINT) AS gray_rounded FROM pos",
)
def grayscale(spark, sf):
    s = sheets(spark, sf)
    return tidy(render.grayscale(s, render.automatic_limits(s)).drop("tile_id"))


RGB_SPARK = [
    "o_orderkey div 500 AS image_id",
    "CAST((o_orderkey % 500) div 25 AS INT) AS row_idx",
    "CAST(o_orderkey % 25 AS INT) AS col_idx",
    "CAST(o_custkey % 256 AS INT) AS r",
    "CAST(o_orderkey * 7 % 256 AS INT) AS g",
    "CAST(floor(o_totalprice) % 256 AS INT) AS b",
    "20 AS height",
    "25 AS width",
]
RGB_SQL = """rgb AS (SELECT o_orderkey // 500 AS image_id, (o_orderkey % 500) // 25 AS row_idx, o_orderkey % 25 AS col_idx,
  o_custkey % 256 AS r, o_orderkey * 7 % 256 AS g, CAST(floor(o_totalprice) AS BIGINT) % 256 AS b FROM orders)"""


def rgb(spark: SparkSession, sf: str) -> DataFrame:
    """Even images are 20×25; odd ones keep their upper left 12×15 pixels, so pairs differ in shape."""
    full = derived.table(spark, sf, "orders").selectExpr(*RGB_SPARK)
    small = F.col("image_id") % 2 == 1
    return full.where(~small | ((F.col("row_idx") < 12) & (F.col("col_idx") < 15))).withColumns(
        {"height": F.when(small, 12).otherwise(F.col("height")), "width": F.when(small, 15).otherwise(F.col("width"))}
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rgb(spark, sf).where("image_id % 2 = 0").select("image_id").distinct().selectExpr(
        "image_id AS pair_id", "image_id AS left_id", "image_id + 1 AS right_id", "20 AS h_l", "25 AS w_l", "12 AS h_r", "15 AS w_r"
    )


ALIGN_SQL = f"""{RGB_SQL}, al AS (SELECT a.image_id AS pair_id, y AS t_row, x AS t_col, a.r AS rl, a.g AS gl, a.b AS bl, c.r AS rr, c.g AS gr, c.b AS br
  FROM range(0, 12) q(y), range(0, 15) w(x), rgb a JOIN rgb c ON c.image_id = a.image_id + 1 AND a.image_id % 2 = 0
  WHERE a.row_idx = y * 20 // 12 AND a.col_idx = x * 25 // 15 AND c.row_idx = y AND c.col_idx = x)"""


@query(
    "rgb_blend",
    f"WITH {ALIGN_SQL} SELECT pair_id, t_row, t_col, "
    + ", ".join(f"CAST(round_even({c}l * 0.7::DOUBLE + {c}r * 0.3::DOUBLE, 0) AS BIGINT) AS {c}" for c in "rgb")
    + " FROM al",
)
def rgb_blend(spark, sf):
    return tidy(render.blend(render.align_pair(pairs(spark, sf), rgb(spark, sf)), 0.3))


@query(
    "rgb_swipe",
    f"WITH {ALIGN_SQL} SELECT pair_id, t_row, t_col, " + ", ".join(f"CASE WHEN t_col < 6 THEN {c}l ELSE {c}r END AS {c}" for c in "rgb") + " FROM al",
)
def rgb_swipe(spark, sf):
    return tidy(render.swipe(render.align_pair(pairs(spark, sf), rgb(spark, sf)), 0.4))


@query(
    "rgb_side_by_side",
    f"WITH {ALIGN_SQL} SELECT pair_id, t_row, t_col, rl AS r, gl AS g, bl AS b FROM al UNION ALL SELECT pair_id, t_row, t_col + 15, rr, gr, br FROM al",
)
def rgb_side_by_side(spark, sf):
    return tidy(render.side_by_side(render.align_pair(pairs(spark, sf), rgb(spark, sf))))


@query(
    "illumination_context",
    f"""WITH {RGB_SQL}, br AS (SELECT image_id, row_idx, col_idx, (r + g + b) / 3.0::DOUBLE / 255.0::DOUBLE AS v FROM rgb),
    pad AS (SELECT image_id, rr.pos AS pr, cc.pos AS pc, v FROM br
      JOIN (SELECT pos, CASE WHEN pos > 19 THEN 38 - pos ELSE abs(pos) END AS src FROM range(-15, 35) t(pos)) rr ON rr.src = row_idx
      JOIN (SELECT pos, CASE WHEN pos > 24 THEN 48 - pos ELSE abs(pos) END AS src FROM range(-15, 40) t(pos)) cc ON cc.src = col_idx),
    rs AS (SELECT image_id, pr, pc, avg(v) OVER (PARTITION BY image_id, pr ORDER BY pc ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS m FROM pad),
    cs AS (SELECT image_id, pr, pc, avg(m) OVER (PARTITION BY image_id, pc ORDER BY pr ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS ill FROM rs WHERE pc BETWEEN 0 AND 24)
    SELECT b.image_id AS frame_id, row_idx, col_idx, {r('v', 'brightness')}, {r('ill', 'illumination_field')},
      {r('greatest(0, least(1, (ill - v) / greatest(ill, 1e-6)))', 'shadow_score')}
    FROM br b JOIN cs ON cs.image_id = b.image_id AND pr = row_idx AND pc = col_idx""",
)
def illumination_context(spark, sf):
    full = derived.table(spark, sf, "orders").selectExpr(*RGB_SPARK).withColumnRenamed("image_id", "frame_id")
    return tidy(stencil.illumination_context(full.withColumn("image_max", F.lit(255))))
