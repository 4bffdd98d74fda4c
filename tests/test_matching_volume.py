"""How many rows matching moves: cells touched by a reach, words of a kind, findings looked at in late rounds."""

import random

import pytest
from helpers import metres
from test_matching import SCHEMA, serial_compare

from emberfield.operators import matching


@pytest.mark.parametrize("lat, lon", [(28.0, -82.0), (0.0, 180.0), (-60.0, 0.0), (89.8995, 10.0), (-89.9999, 180.0)])
def test_a_reach_touches_few_cells_and_misses_none(spark, lat, lon):
    rng = random.Random(7)
    wide = 0.00012 / max(0.001, abs(90 - abs(lat)) / 60) if abs(lat) > 89 else 0.0002
    points = [(i, lat + rng.uniform(-0.0001, 0.0001), (lon + rng.uniform(-wide, wide) + 180) % 360 - 180) for i in range(150)]
    df = spark.createDataFrame(points, "i long, latitude double, longitude double")
    home = {r["i"]: r["cell"] for r in matching.at_home(df, 3.0).collect()}
    near = {}
    for r in matching.at_near_cells(df, 3.0).collect():
        near.setdefault(r["i"], []).append(r["cell"])
    for a in points:
        for b in points:
            if metres(a[1:], b[1:]) <= 3.0:
                assert home[b[0]] in near[a[0]]
    assert max(map(len, near.values())) <= 8
    if abs(lat) < 80:
        assert sum(map(len, near.values())) <= 3.5 * len(points)


def test_a_class_that_is_the_type_is_one_word(spark):
    rows = [(1, 5, "a", "a"), (2, 5, "a", "b"), (3, 5, None, "a"), (4, 5, None, None), (5, 5, "b", "c")]
    df = spark.createDataFrame(rows, "obs_ord long, cell long, classification string, finding_type string")
    placed = matching._place_kind(df)
    counts = {r["obs_ord"]: r["count"] for r in placed.groupBy("obs_ord").count().collect()}
    assert counts == {1: 1, 2: 2, 3: 1, 5: 2}
    a, b = placed.alias("a"), placed.alias("b")
    met = sorted((r[0], r[1]) for r in a.join(b, matching._same_kind("a", "b")).select("a.obs_ord", "b.obs_ord").collect())
    alike = lambda x, y: any(p is not None and p == q for p, q in zip(x[2:], y[2:]))
    assert met == sorted((x[0], y[0]) for x in rows for y in rows if alike(x, y))


def test_quiet_sites_are_not_looked_at_again(spark, monkeypatch):
    finding = lambda i, lat, lon: (i, lat, lon, 10.0, 40.0, 30, "a", "x", "low", f"F{i}")
    # Sites 100 m apart with a partner of their own, and two places that want the same one.
    quiet = [finding(i, 28.0 + 0.001 * (i // 2), -82.0) for i in range(80)]
    contested = [finding(100, 29.0, -82.0), finding(101, 29.000002, -82.0), finding(102, 29.000009, -82.0), finding(103, 29.000001, -82.0)]
    rows = quiet + contested
    previous, current = [r for r in rows if r[0] % 2 == 0], [r for r in rows if r[0] % 2 == 1]
    asked, plain = [], matching.running_max

    def counted(df, *rest, **more):
        asked.append(df.count())
        return plain(df, *rest, **more)

    monkeypatch.setattr(matching, "running_max", counted)
    out = matching.match_inspections(*(spark.createDataFrame(r, SCHEMA) for r in (previous, current))).collect()
    want = sorted((c, p) for _, c, p in serial_compare(previous, current) if None not in (c, p))
    assert sorted((r["cur"], r["prev"]) for r in out) == want
    assert asked[0] == 42 and len(asked) > 1 and max(asked[1:]) <= 2
