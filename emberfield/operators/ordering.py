"""Ordered look-ups and numbering that never put an unbounded group into one window partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN_SPAN = 1_000_000


def previous_in_spans(
    df: DataFrame, keys: list[str], order: str | list[str], value: str, span: Column, name: str
) -> DataFrame:
    """``name`` = ``value`` of the previous row of the key in ``order`` (NULL for the first).

    ``span`` cuts the order into consecutive pieces. The look-back runs inside (key, span); the head of
    a span takes the last value of the key's previous span from a table with one row per span.
    """
    order = [order] if isinstance(order, str) else order
    spanned = df.withColumn("_span", span)
    inner = Window.partitionBy(*keys, "_span").orderBy(*order)
    looked = spanned.withColumns({"_in": F.lag(value).over(inner), "_first": F.row_number().over(inner) == 1})
    tails = spanned.groupBy(*keys, "_span").agg(F.max_by(value, F.struct(*order)).alias("_tail"))
    before = tails.select(
        *keys, "_span", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_span")).alias("_before")
    ).where("_before IS NOT NULL")
    return looked.join(before, [*keys, "_span"], "left").withColumn(
        name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_in"))
    ).drop("_span", "_in", "_first", "_before")


def number_groups(df: DataFrame, order: str, name: str, span: int = CHAIN_SPAN) -> DataFrame:
    """W1 over everything. Dense 1-based number in ``order`` without a single-partition window over the rows.

    Rows are numbered inside spans of the order column; span sizes (one row per million) are summed.
    """
    spanned = df.withColumn("_span", F.floor(F.col(order) / span))
    sizes = spanned.groupBy("_span").agg(F.count("*").alias("_n"))
    before = sizes.select("_span", (F.sum("_n").over(Window.orderBy("_span")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_span").orderBy(order))
    return spanned.withColumn("_in", inside).join(before, "_span").withColumn(
        name, F.col("_before") + F.col("_in")
    ).drop("_span", "_in", "_before")


def rank_in_groups(
    df: DataFrame, keys: list[str], levels: list[list[Column]], order: list[Column], name: str, rows: int | None = None
) -> DataFrame:
    """``name`` = 1-based rank inside a key in ``order``; no task ranks more than a span, whatever the size of a key.

    ``levels`` are coarser orders, each list refining the ones before it (first by bins, then by exact value and spans of a
    tie-breaker, say). Rows are counted per span and level, counts of earlier spans are added up, and a row's rank is theirs plus its place
    in its last span. With at most ``CHAIN_SPAN`` ``rows`` altogether a single window is a span already.
    """
    if rows is not None and rows <= CHAIN_SPAN:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    scope, out, before = list(keys), df, F.lit(0).cast("long")
    for i, level in enumerate(levels):
        own = [f"_level_{i}_{j}" for j in range(len(level))]
        out = out.withColumns(dict(zip(own, level)))
        counts = out.groupBy(*scope, *own).agg(F.count("*").alias("_n"))
        earlier = Window.partitionBy(*scope).orderBy(*own)
        counts = counts.select(*scope, *own, (F.sum("_n").over(earlier) - F.col("_n")).alias(f"_before_{i}"))
        match = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*scope, *own)]
        out = out.alias("l").join(counts.alias("r"), match).select("l.*", f"r._before_{i}")
        scope, before = [*scope, *own], before + F.col(f"_before_{i}")
    inside = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    out = out.withColumn("_inside", inside).withColumn(name, (before + F.col("_inside")).cast("int"))
    return out.select(*df.columns, name)


def running_max(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, rows: int | None = None, span: int = CHAIN_SPAN
) -> DataFrame:
    """``name`` = greatest ``value`` up to a row of its key in ``order``, a span at a time: the maxima of earlier spans are a row each.

    At most a span of ``rows`` altogether needs no second level.
    """
    if rows is not None and rows <= span:
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.max(value).over(whole))
    cut = df.withColumn("_span", F.floor(F.col(order) / span))
    tops = cut.groupBy(*keys, "_span").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_span", F.max("_top").over(earlier).alias("_earlier"))
    so_far = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cut.withColumn("_so_far", F.max(value).over(so_far))
        .join(tops, [*keys, "_span"])
        .withColumn(name, F.greatest("_so_far", "_earlier"))
        .drop("_span", "_so_far", "_earlier")
    )


def around(probes: DataFrame, points: DataFrame, keys: list[str], at: str, value: str, width: int, pieces: int = 64) -> DataFrame:
    """Probes with ``before`` and ``after``: the ``value`` of the last point up to and of the first point behind their ``at``, in their key.

    A point farther away than ``width`` may be missed, one within it never is. ``at`` is a whole number, the same in both, and a key has
    one point at a time. The sweep runs inside (key, piece of ``width``), so that a burst within one width is many tasks' work; at
    its ends it takes the edges that are carried over from the pieces of the same and of the neighbouring width.
    """
    step = max(1, width // pieces)
    own = [c for c in probes.columns if c not in keys and c != at]
    left = probes.select(*keys, at, F.struct(*own).alias("_probe"), F.lit(None).cast(points.schema[value].dataType).alias("_point"))
    right = points.select(*keys, at, F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"), F.col(value).alias("_point"))
    both = left.unionByName(right).withColumns({"_piece": F.floor(F.col(at) / step), "_part": F.floor(F.floor(F.col(at) / step) / pieces)})
    order = [F.col(at), F.col("_probe").isNotNull()]  # points before probes of the same time
    inner = Window.partitionBy(*keys, "_part", "_piece").orderBy(*order)
    swept = both.withColumns(
        {
            "_before": F.last("_point", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_after": F.first("_point", ignorenulls=True).over(inner.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    ).where("_probe IS NOT NULL")
    edges = both.groupBy(*keys, "_part", "_piece").agg(
        F.min_by("_point", F.when(F.col("_point").isNotNull(), F.col(at))).alias("_first"),
        F.max_by("_point", F.when(F.col("_point").isNotNull(), F.col(at))).alias("_last"),
    )
    shared = edges.withColumn("_near", F.explode(F.array(F.col("_part") - 1, F.col("_part"), F.col("_part") + 1)))
    along = Window.partitionBy(*keys, "_near").orderBy("_piece")
    carried = shared.withColumns(
        {
            "_earlier": F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)),
            "_later": F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).where("_near = _part").select(*keys, "_part", "_piece", "_earlier", "_later")
    met = swept.join(carried, [*keys, "_part", "_piece"])
    return met.select(
        *keys, at, "_probe.*", F.coalesce("_before", "_earlier").alias("before"), F.coalesce("_after", "_later").alias("after")
    )
