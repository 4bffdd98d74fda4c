"""Connected regions of a sparse pixel mask.

Pixels collapse to row runs natively, runs of one group (up to 2304² pixels, one tile with halo)
are joined to labels by a small vectorised helper, and sheets larger than a group are stitched by
star contraction over the few runs on group borders. A label is the row-major index of the
region's first pixel, so labels sort in discovery order.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield.operators.sheets import KEYS, int_div
from emberfield.session import cut_lineage, drop_stage

GROUP = 2304

# Ship the label helper inside the task, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _min_labels(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    labels = np.arange(count)
    while True:
        low = np.minimum(labels[left], labels[right])
        nxt = labels.copy()
        np.minimum.at(nxt, left, low)
        np.minimum.at(nxt, right, low)
        nxt = nxt[nxt]
        if np.array_equal(nxt, labels):
            return labels
        labels = nxt


def label_runs(row: np.ndarray, start: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
    """Index of the first run of each run's region; runs sorted by (row, start)."""
    stride = int(end.max()) + 4
    starts, ends = row * stride + start, row * stride + end
    first = np.searchsorted(ends, (row + 1) * stride + np.maximum(start - reach, 0), "left")
    last = np.searchsorted(starts, (row + 1) * stride + end + reach, "right")
    fan = np.maximum(last - first, 0)
    left = np.repeat(np.arange(len(row)), fan)
    right = np.arange(len(left)) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(first, fan)
    return _min_labels(len(row), left, right)


def pixel_runs(mask: DataFrame, aggregates: list, keys: list[str] = KEYS, group: int = GROUP) -> DataFrame:
    """Maximal horizontal runs per row and group, with per-run partial aggregates of the pixels."""
    scope = [*keys, "grp_r", "grp_c"]
    placed = mask.withColumns(
        {"grp_r": int_div(F.col("row_idx"), group), "grp_c": int_div(F.col("col_idx"), group)}
    ).repartition(*scope)
    order = Window.partitionBy(*scope, "row_idx").orderBy("col_idx")
    return (
        placed.withColumn("island", F.col("col_idx") - F.row_number().over(order))
        .groupBy(*scope, "row_idx", "island")
        .agg(
            F.min("col_idx").alias("c0"),
            F.max("col_idx").alias("c1"),
            F.max("height").alias("height"),
            F.max("width").alias("width"),
            *aggregates,
        )
        .drop("island")
    )


def label_regions(
    runs: DataFrame, connectivity: int = 8, keys: list[str] = KEYS, group: int = GROUP, stitch: bool = False
) -> DataFrame:
    """Runs with ``label``. ``stitch`` joins regions across group borders (sheets above ``group``)."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    reach = 1 if connectivity == 8 else 0
    scope = [*keys, "grp_r", "grp_c"]

    def label_group(runs_of_group: pa.Table) -> pa.Table:
        column = lambda n: runs_of_group.column(n).to_numpy().astype(np.int64)
        row, start, end, width = (column(n) for n in ("row_idx", "c0", "c1", "width"))
        order = np.lexsort((start, row))
        root = label_runs(row[order], start[order], end[order], reach)
        labels = np.empty(len(row), np.int64)
        labels[order] = (row * width + start)[order][root]
        return runs_of_group.append_column("label", pa.array(labels))

    schema = T.StructType([*runs.schema.fields, T.StructField("label", T.LongType())])
    labelled = runs.groupBy(*scope).applyInArrow(label_group, schema)
    return _stitch(labelled, reach, keys, group) if stitch else labelled


def _border_edges(labelled: DataFrame, reach: int, keys: list[str], group: int) -> DataFrame:
    """Label pairs touching across a group border. Rows are bucketed, so no bucket exceeds one row of a group."""
    runs = labelled.select(*keys, "grp_r", "grp_c", "row_idx", "c0", "c1", "label").where(
        (F.col("row_idx") % group == 0)
        | (F.col("row_idx") % group == group - 1)
        | (F.col("c0") % group == 0)
        | (F.col("c1") % group == group - 1)
    )
    side = F.array_compact(
        F.array(
            F.col("grp_c"),
            F.when(F.col("c0") % group == 0, F.col("grp_c") - 1),
            F.when(F.col("c1") % group == group - 1, F.col("grp_c") + 1),
        )
    )
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    probe = runs.withColumn("at_c", F.explode(side)).withColumn("d", F.explode(step))
    probe = probe.withColumn("at_row", F.col("row_idx") + F.col("d"))
    a, b = probe.alias("a"), runs.alias("b")
    near = F.when(F.col("a.d") == 0, F.lit(1)).otherwise(F.lit(reach))
    touching = a.join(
        b,
        [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
        + [
            F.col("a.at_row") == F.col("b.row_idx"),
            F.col("a.at_c") == F.col("b.grp_c"),
            F.col("b.c0") <= F.col("a.c1") + near,
            F.col("b.c1") >= F.col("a.c0") - near,
            F.col("a.label") != F.col("b.label"),
        ],
    )
    return touching.select(
        *[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.label").alias("u"), F.col("b.label").alias("v")
    ).distinct()


def propagate_minimum(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """``node, root``: smallest node reachable along ``u → v`` edges against their direction.

    A round gives every node the least value of its in-neighbours and of its value's own node, and contracts the graph: an edge from a node
    that nothing leads to has given all it has and goes; one from a node that a single edge leads to starts at that
    edge's tail instead, as the node itself is accounted for. So chains, with any number of dead ends along them, halve
    in every round. Where no value changes all are final. ``rounds`` takes a note per round.
    """
    edges = stage_edges = cut_lineage(edges.select("u", "v").where("u <> v").distinct())
    ends = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node")))
    roots = stage = cut_lineage(ends.distinct().withColumn("root", F.col("node")))
    while True:
        arriving = edges.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n"), F.min("u").alias("tail"))
        known = roots.join(arriving, "node", "left").select(F.col("node").alias("u"), F.col("root").alias("offer"), "n", "tail")
        met = cut_lineage(edges.join(known, "u"))
        incoming = met.groupBy(F.col("v").alias("node")).agg(F.min("offer").alias("offer"))
        nxt = roots.join(incoming, "node", "left").select(
            "node", F.col("root").alias("was"), F.least("root", F.coalesce("offer", "root")).alias("root")
        )
        jump = nxt.select(F.col("node").alias("root"), F.col("root").alias("far"))
        nxt = cut_lineage(
            nxt.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root"))
        )
        start = F.when(F.col("n") == 1, F.col("tail")).otherwise(F.col("u"))
        edges = met.where("n IS NOT NULL").select(start.alias("u"), "v").where("u <> v").distinct()
        drop_stage(stage, stage_edges)
        roots, stage, stage_edges = nxt.select("node", "root"), nxt, met
        if rounds is not None:
            rounds.append(1)
        if nxt.where("was <> root").limit(1).count() == 0:
            drop_stage(met)
            return roots


def component_minimum(edges: DataFrame, keys: list[str], salts: int = 16, rounds: list | None = None) -> DataFrame:
    """``keys, node, root``: smallest node of the component of undirected ``u, v`` edges, by large and small stars in turn.

    A large star hands the larger neighbours of a node to the smallest node around it, a small star the smaller ones and the node itself, so
    that rounds grow with the logarithm of a component's length. A node's neighbours are dealt over ``salts`` keys, so that a hub, like
    the label of a region that runs through the whole sheet, is not one task's work.
    """

    def with_least(pairs: DataFrame, least: Column) -> DataFrame:
        dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)))
        parts = dealt.groupBy(*keys, "u", "salt").agg(least.alias("m"))
        handed = parts.select(*keys, "u", "salt").join(parts.groupBy(*keys, "u").agg(F.min("m").alias("m")), [*keys, "u"])
        return dealt.join(handed, [*keys, "u", "salt"])

    def turned(pairs: DataFrame) -> DataFrame:
        return pairs.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")

    now = cut_lineage(edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            return now.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        both = now.unionByName(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        large = turned(with_least(both, F.least("u", F.min("v"))).where("v > u")).distinct()
        met = with_least(large, F.min("v"))
        own = met.select(*keys, "u", F.col("m").alias("v"))
        after = cut_lineage(turned(met).unionByName(own).where("u <> v").distinct())
        drop_stage(now)
        now = after
        if rounds is not None:
            rounds.append(1)


def _stitch(labelled: DataFrame, reach: int, keys: list[str], group: int) -> DataFrame:
    labelled = cut_lineage(labelled)
    edges = _border_edges(labelled, reach, keys, group)
    roots = component_minimum(edges, keys).withColumnRenamed("node", "label")
    return labelled.join(roots, [*keys, "label"], "left").withColumn(
        "label", F.coalesce("root", "label")
    ).drop("root").select(*labelled.columns)
