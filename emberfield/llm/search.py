"""Exact top-k inner-product search by pivot-table elimination.

Vectors are turned into integers. The index keeps every vector's distances to a set of pivots. For a query q and a
candidate x the greatest difference of their distances to a pivot is a lower bound of their own distance, so
(|q|² + |x|² - bound²) / 2 is an upper bound of the inner product. A query meets the candidates of a block in the order of this
bound and stops when the next bound is below its k-th best score; scores are exact integers.

Queries and candidates are dealt into blocks of bounded size, every pair of blocks is one task's work and gives at most
k rows a query, which are merged by rank. Rows are told apart by a row number, not by id.

Defined results: vectors that are null or hold null or non-finite components take no part; only vectors of one
length meet; equal scores go to the smaller id (null last, then the earlier row); rows with null ids are candidates but no queries;
scores beyond a 64-bit integer are held at its ends; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.llm.common import Batch, Stages

SCALE = 256
QUERY_EVERY = 50
PIVOTS = 32
#: Pivots are picked among so many vectors of the smallest id hashes; any choice gives exact results.
PIVOT_SAMPLE = 1024
CANDIDATES, QUERIES = 16384, 4096
#: Components up to this size are multiplied as doubles or 64-bit integers without overflow; beyond it as Python integers.
SMALL, WIDE = 1 << 20, 1 << 27
STEP = 512


def _matrix(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<f8").reshape(len(parts), -1)


def _pick_pivots(rows: list[bytes], count: int) -> np.ndarray:
    """Far-apart vectors of a sample: each next pivot is the one farthest from those before."""
    points = _matrix(rows)
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def build_index(vectors: DataFrame, stages: Stages, pivots: int = PIVOTS) -> DataFrame:
    """``(vec_id, embedding)`` to ``(row, vec_id, dim, ints, norm, table)``: integers as doubles, and distances to pivots."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    sound = vectors.where(F.col("embedding").isNotNull() & ~bad & (F.size("embedding") > 0)).select("vec_id", wide.alias("x"))

    def to_ints(batches: Iterator[Batch]) -> Iterator[Batch]:
        for batch in batches:
            ints = [np.floor(np.array(x) * SCALE).astype("<f8").tobytes() for x in batch.column(1).to_pylist()]
            yield Batch.from_pydict({"vec_id": batch.column(0), "ints": ints})

    staged = stages.write(
        sound.mapInArrow(to_ints, "vec_id bigint, ints binary").withColumn("row", F.monotonically_increasing_id())
    )
    sample = (
        staged.select("ints", F.length("ints").alias("n"), F.xxhash64("vec_id", "row").alias("h")).orderBy("h").limit(PIVOT_SAMPLE).collect()
    )
    by_size: dict[int, list[bytes]] = {}
    for r in sample:
        by_size.setdefault(r["n"], []).append(bytes(r["ints"]))
    chosen = {n: _pick_pivots(rows, pivots) for n, rows in by_size.items()}

    def measure(batches: Iterator[Batch]) -> Iterator[Batch]:
        for batch in batches:
            norms, tables = [], []
            for raw in batch.column(batch.schema.get_field_index("ints")).to_pylist():
                x = np.frombuffer(raw, "<f8")
                norms.append(float(x @ x))
                at = chosen.get(len(raw))
                tables.append(np.sqrt(((at - x) ** 2).sum(1)).astype("<f8").tobytes() if at is not None else b"")
            yield Batch.from_pydict(
                {"row": batch.column(2), "vec_id": batch.column(0), "ints": batch.column(1), "norm": norms, "pivots": tables}
            )

    schema = "row bigint, vec_id bigint, ints binary, norm double, pivots binary"
    return stages.write(staged.select("vec_id", "ints", "row").mapInArrow(measure, schema))


def _scores(q: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Exact inner products of integers kept as doubles."""
    most = max(np.abs(q).max(initial=0), np.abs(xs).max(initial=0))
    if most <= SMALL:
        return (xs @ q).astype(np.int64)  # below 2**53 for up to 8192 components
    if most <= WIDE:
        return xs.astype(np.int64) @ q.astype(np.int64)
    ends = (-(2**63), 2**63 - 1)
    own = [int(c) for c in q]
    return np.array([min(max(sum(a * int(b) for a, b in zip(own, x)), ends[0]), ends[1]) for x in xs], np.int64)


def _best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows, ids, -scores.astype(object) if (scores == -(2**63)).any() else -scores))[:k]


def search_block(queries: pa.Table, found: pa.Table, k: int) -> Iterator[tuple]:
    """Top k of one block of candidates for every query of a block, in bound order with an exact stop."""
    xs, norms = _matrix(found["ints"].to_pylist()), found["norm"].to_numpy()
    tables = found["pivots"].to_pylist()
    at = _matrix(tables) if tables[0] else np.zeros((len(tables), 0))
    names = found["vec_id"].to_pylist()
    ids = np.array([2**63 - 1 if v is None else v for v in names], np.int64)
    rows = found["row"].to_numpy()
    for q in queries.to_pylist():
        x = np.frombuffer(q["ints"], "<f8")
        own = np.frombuffer(q["pivots"], "<f8")
        apart = np.abs(at - own).max(axis=1, initial=0.0)
        # A little is added so that rounding never puts a bound below the true product.
        bound = (q["norm"] + norms - apart**2) / 2 + 1e-9 * (q["norm"] + norms) + 1
        order = np.argsort(-bound, kind="stable")
        order = order[rows[order] != q["row"]]
        kept = order[:0]
        scores = np.empty(0, np.int64)
        for start in range(0, len(order), STEP):
            part = order[start : start + STEP]
            if len(kept) == k and bound[part[0]] < scores[-1]:
                break
            kept, scores = np.concatenate([kept, part]), np.concatenate([scores, _scores(x, xs[part])])
            best = _best(ids[kept], rows[kept], scores, k)
            kept, scores = kept[best], scores[best]
        for c, s in zip(kept, scores):
            yield q["row"], q["vec_id"], int(rows[c]), names[c], int(s)


def top_k(vectors: DataFrame, k: int = 5, every: int = QUERY_EVERY, pivots: int = PIVOTS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of every vector whose id is a multiple of ``every``, against all others."""
    stages = Stages(vectors.sparkSession)
    index = build_index(vectors.select("vec_id", "embedding"), stages, pivots)
    asked = index.where(F.col("vec_id") % every == 0)
    n, m = index.count(), asked.count()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    spread = F.xxhash64("row")

    def every_block(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))

    columns = ["row", "vec_id", "ints", "norm", "pivots", F.length("ints").alias("dim")]
    left = asked.select(
        *columns,
        F.pmod(spread, F.lit(q_blocks)).alias("qb"),
        every_block(c_blocks).alias("cb"),
    )
    right = index.select(
        *columns,
        every_block(q_blocks).alias("qb"),
        F.pmod(spread, F.lit(c_blocks)).alias("cb"),
    )
    schema = "q_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint"

    def run(queries: pa.Table, found: pa.Table) -> pa.Table:
        made = list(search_block(queries, found, k)) if queries.num_rows and found.num_rows else []
        names = ["q_row", "query_id", "row", "vec_id", "score"]
        return pa.table({n: pa.array([m[i] for m in made], pa.int64()) for i, n in enumerate(names)})

    keys = ["qb", "cb", "dim"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (
        near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
