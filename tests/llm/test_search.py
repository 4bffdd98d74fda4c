import math
import random

from emberfield.llm import search
from emberfield.llm.search import top_k


def slow(rows, k=5):
    use = [(i, vid, [math.floor(256 * x) for x in e]) for i, (vid, e) in enumerate(rows) if e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, vid, q in use:
        if vid is None or vid % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, c)), math.inf if cid is None else cid, j) for j, cid, c in use if j != i and len(c) == len(q)]
        out += [(vid, r + 1, None if cid == math.inf else cid, -s) for r, (s, cid, _) in enumerate(sorted(scored)[:k])]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    return sorted(out, key=key)


def run(spark, rows, kind="float"):
    df = spark.createDataFrame([(v, e, 1) for v, e in rows], f"vec_id long, embedding array<{kind}>, score int")
    got = top_k(df).select("query_id", "rank", "vec_id", "score").collect()
    return sorted((tuple(r) for r in got), key=lambda r: tuple(-1 if v is None else v for v in r))


def test_random_vectors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "CANDIDATES", 300)
    monkeypatch.setattr(search, "QUERIES", 7)
    rng = random.Random(2)
    f = lambda: float(int(rng.gauss(0, 1) * 4096)) / 4096
    rows = [(i, [f() for _ in range(16)]) for i in range(1200)]
    assert run(spark, rows) == slow(rows)


def test_ties_repeats_nulls_lengths_and_large_values(spark):
    same = [0.5, -0.25, 1.0]
    nan = float("nan")
    rows = [(i, same) for i in range(60)] + [(50, same), (None, same), (100, None), (150, [1.0, None, 2.0]), (200, [nan, 1.0, 1.0])]
    rows += [(250, [1.0]), (251, [2.0]), (300, []), (350, [1e6, 2e6, -3e6]), (351, [1e6, 2e6, 3e6]), (400, [0.0, 0.0, 0.0])]
    assert run(spark, rows, "double") == slow(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
