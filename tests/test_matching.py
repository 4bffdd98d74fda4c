import math
import random
from datetime import datetime, timedelta

import pytest
from helpers import metres
from pyspark.sql import functions as F

from emberfield.operators import matching, ordering, regions

SCHEMA = (
    "obs_ord long, latitude double, longitude double, delta_temperature_c double, max_temperature_c double, "
    "area_px int, classification string, finding_type string, confidence string, finding_id string"
)


def cloud(seed, n, lat=28.0, lon=-82.0, spread=0.00006):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        where = (None, None) if rng.random() < 0.05 else (lat + rng.uniform(-spread, spread), (lon + rng.uniform(-spread, spread) + 180) % 360 - 180)
        rows.append(
            (i, *where, rng.uniform(5, 30), rng.uniform(30, 70), 30, rng.choice("ab"), rng.choice("xy"), rng.choice(["low", "medium", "high"]), f"F{i}")
        )
    return rows


def compatible(a, b):
    if None in (a[1], b[1]):
        return False
    return (
        metres(a[1:3], b[1:3]) <= 3 and abs(a[3] - b[3]) <= 8 and abs(a[4] - b[4]) <= 12 and (a[6] == b[6] or a[7] == b[7])
    )


def greedy_clusters(rows):
    clusters = []
    for o in rows:
        home = next((c for c in clusters if any(compatible(o, m) for m in c)), None)
        if home is None:
            clusters.append([o])
        else:
            home.append(o)
    return {m[0]: c[0][0] for c in clusters for m in c}


@pytest.mark.parametrize("seed,lat,lon", [(1, 28.0, -82.0), (2, -45.0, 180.0), (3, 0.0, 0.0), (4, 71.0, 10.0)])
def test_clusters_equal_the_ordered_greedy(spark, seed, lat, lon):
    rows = cloud(seed, 160, lat, lon)
    got = matching.assign_clusters(spark.createDataFrame(rows, SCHEMA)).select("obs_ord", "founder").collect()
    assert {r.obs_ord: r.founder for r in got} == greedy_clusters(rows)


def test_late_link_does_not_merge_clusters(spark):
    step = 2.0 / 111_195
    base = (10.0, 50.0, 30, "a", "a", "low")
    rows = [(0, 28.0, -82.0, *base, "A"), (1, 28.0 + 2 * step, -82.0, *base, "B"), (2, 28.0 + step, -82.0, *base, "C")]
    got = {r.obs_ord: r.founder for r in matching.assign_clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_canonical_merge(spark):
    rows = [
        (0, 28.0, -82.0, 10.0, 50.0, 30, "a", "a", "low", "OBS-1"),
        (1, 28.0, -82.0, 12.0, 50.0, 30, "a", "a", "low", "OBS-2"),
        (2, None, None, 12.0, 50.0, 30, "a", "a", "high", "OBS-3"),
    ]
    assigned = matching.assign_clusters(spark.createDataFrame(rows, SCHEMA))
    c = matching.canonical_findings(assigned).orderBy("founder").collect()
    assert [(r.finding_id, r.duplicate_cluster_id, r.obs_ord, r.confidence, r.members) for r in c] == [
        ("A-001", "D-001", 1, "medium", 2),
        ("A-002", "", 2, "high", 1),
    ]
    support = matching.supporting_observations(assigned).where("founder = 0").orderBy("obs_ord").collect()
    assert [r.finding_id for r in support] == ["OBS-1", "OBS-2"]


def serial_compare(previous, current):
    free, out = dict(enumerate(previous)), []
    for item in current:
        near = [
            (round(metres(p[1:3], item[1:3]), 6), i)
            for i, p in free.items()
            if None not in (p[1], item[1]) and (p[6] == item[6] or p[7] == item[7]) and metres(p[1:3], item[1:3]) <= 3
        ]
        if not near:
            out.append(("new", item[0], None))
            continue
        p = free.pop(min(near)[1])
        change = item[3] - p[3]
        out.append(("worsened" if change >= 3 else "improved" if change <= -3 else "persisted", item[0], p[0]))
    return out + [("resolved", None, p[0]) for p in free.values()]


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_comparison_equals_the_serial_rule(spark, seed):
    rows = cloud(seed, 140)
    previous, current = [r for r in rows if r[0] % 2 == 0], [r for r in rows if r[0] % 2]
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    got = matching.compare_inspections(frame(previous), frame(current)).collect()
    assert sorted((r.state, str(r.current_ord), str(r.previous_ord)) for r in got) == sorted(
        (s, str(c), str(p)) for s, c, p in serial_compare(previous, current)
    )


def test_findings_at_one_spot_store_a_linear_number_of_rows(spark, monkeypatch):
    """2,000 x 2,000 findings of one place and kind: one preference row per previous finding, one state row per current one."""
    n = 2000
    spot = spark.range(2 * n).selectExpr(
        "id AS obs_ord", "28.0D AS latitude", "-82.0D AS longitude", "9.0D AS delta_temperature_c", "50.0D AS max_temperature_c",
        "20 AS area_px", "'a' AS classification", "'t' AS finding_type", "'low' AS confidence", "'F' AS finding_id",
    )
    written = []
    cut = matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(matching, "drop_stage", lambda *frames: None)
    got = matching.match_inspections(spot.where("obs_ord % 2 = 0"), spot.where("obs_ord % 2 = 1")).collect()
    assert sorted((r.cur, r.prev) for r in got) == [(2 * i + 1, 2 * i) for i in range(n)]
    assert sum(df.count() for df in written) <= 6 * n and len(written) <= 6


def test_two_sites_share_their_partners_like_the_serial_rule(spark):
    """Interleaved findings of two kinds at one place and a few distinct places around it, with ties in distance."""
    rng = random.Random(11)
    rows = []
    for i in range(240):
        lat, lon = 28.0 + rng.choice([-1, 0, 1]) * 4e-6, -82.0 + rng.choice([-1, 0, 1]) * 4e-6
        rows.append((i, lat, lon, rng.uniform(5, 30), 50.0, 30, rng.choice("ab"), rng.choice("xy"), "low", f"F{i}"))
    previous, current = [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3]
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    got = matching.compare_inspections(frame(previous), frame(current)).collect()
    assert sorted((r.state, str(r.current_ord), str(r.previous_ord)) for r in got) == sorted(
        (s, str(c), str(p)) for s, c, p in serial_compare(previous, current)
    )


@pytest.mark.parametrize("rows", [None, 10])
def test_ranks_and_running_maxima_in_spans(spark, rows):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.choice([1.0, 2.5, 2.5000001, 7.0]), i, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, d double, i long, v int")
    got = ordering.rank_in_groups(df, ["k"], [[F.floor("d")], [F.col("d"), F.floor(F.col("i") / 7)]], [F.col("d"), F.col("i")], "n", rows)
    want = {}
    for k in "ab":
        want |= {i: n + 1 for n, (_, i) in enumerate(sorted((d, i) for q, d, i, _ in data if q == k))}
    assert {r.i: r.n for r in got.collect()} == want
    top = ordering.running_max(df, ["k"], "i", "v", "m", rows, span=10 if rows is None else 1000)
    for r in top.collect():
        assert r.m == max(v for k, _, i, v in data if k == r.k and i <= r.i)


def test_pairing_needs_either_clue_and_prefers_the_best_score(spark):
    media = "media_id long, capture_ts timestamp, latitude double, longitude double"
    t0 = datetime(2024, 1, 1, 12, 0, 0)
    thermal = spark.createDataFrame(
        [(1, t0, 28.0, -82.0), (2, datetime(2024, 1, 2), 28.0, -82.0), (3, datetime(2024, 1, 3), None, None)], media
    )
    visible = spark.createDataFrame([(10, datetime(2024, 1, 1, 12, 0, 1), 28.00001, -82.0), (11, datetime(2024, 1, 5), 28.0, -82.0)], media)
    got = {r.thermal_id: r for r in matching.pair_media(thermal, visible).collect()}
    assert got[1].visible_id == 10 and got[1].confidence == "medium" and len(got[1].rationale) == 2
    assert got[2].visible_id == 11 and got[2].confidence == "low"
    assert 3 not in got


def slow_pairs(thermal, visible):
    out = {}
    for m, ts, lat, lon in thermal:
        best = None
        for n, when, la, lo in visible:
            gap = abs((ts - when).total_seconds())
            d = None if None in (lat, la) else metres((lat, lon), (la, lo))
            if gap > 2.5 and (d is None or d > 8):
                continue
            score = round((0.6 * (1 - gap / 2.5) if gap <= 2.5 else 0) + (0.4 * (1 - d / 8) if d is not None and d <= 8 else 0), 12)
            if best is None or (-score, n) < best:
                best = (-score, n)
        if best:
            out[m] = best[1]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairing_equals_all_pairs(spark, seed):
    """Bursts inside one window, equal times, shared and missing positions, media far from everything."""
    rng = random.Random(seed)
    t0 = datetime(2024, 1, 1, 12)
    moment = lambda: t0 + timedelta(microseconds=rng.choice([0, 1, 40_000, 2_500_000, 7_000_000]) + rng.choice([0, 0, rng.randrange(3_000_000)]))
    place = lambda: rng.choice([(None, None), (28.0, -82.0), (28.00002, -82.0), (28.1, -82.0), (28.0 + rng.uniform(0, 1e-4), -82.0)])
    rows = lambda first, n: [(first + i, moment(), *place()) for i in range(n)]
    thermal, visible = rows(0, 80), rows(1000, 90)
    media = "media_id long, capture_ts timestamp, latitude double, longitude double"
    got = matching.pair_media(spark.createDataFrame(thermal, media), spark.createDataFrame(visible, media)).collect()
    assert {r.thermal_id: r.visible_id for r in got} == slow_pairs(thermal, visible)


def test_a_burst_gives_a_linear_number_of_candidates(spark):
    """20,000 thermal and 20,000 visible media within one second: every thermal meets two visibles, the nearest in time."""
    n = 20_000
    rows = spark.range(n).selectExpr("id AS media_id", "id * 50 AS at")
    points = spark.range(n).selectExpr("id * 50 + 20 AS at", "struct(id AS visible_id) AS seen")
    one = F.lit(0).alias("k")
    met = ordering.around(rows.withColumn("k", one), points.withColumn("k", one), ["k"], "at", "seen", 2_500_000).collect()
    assert len(met) == n
    assert all((r.before is None and r.media_id == 0) or r.before.visible_id == r.media_id - 1 for r in met)
    assert all(r.after.visible_id == r.media_id for r in met)


def test_a_chain_with_decoys_takes_a_logarithmic_number_of_rounds(spark):
    """1,000 members in a row, each beside an earlier decoy of its own: hop by hop this is a round a member."""
    n, step = 1000, 2.0 / 111_195
    rng = random.Random(5)
    decoys = list(range(n))
    rng.shuffle(decoys)
    rows = [(decoys[i], 28.0 + i * step, -82.0 + 2.5 / 111_195 / 0.883, 5.0 + 10 * (i % 2), 50.0, 30, "a", "a", "low", "D") for i in range(n)]
    rows += [(n + i, 28.0 + i * step, -82.0, 10.0, 50.0, 30, "a", "a", "low", "V") for i in range(n)]
    rounds = []
    edges = matching.compatibility_edges(spark.createDataFrame(rows, SCHEMA))
    roots = {r.node: r.root for r in regions.propagate_minimum(edges, rounds).collect()}
    least = n * 2
    for i in range(n):
        least = min(least, decoys[i])
        assert roots[n + i] == least
    assert len(rounds) <= 2 * math.log2(2 * n)


def test_a_serpentine_of_groups_takes_a_logarithmic_number_of_rounds(spark):
    """A region running through 64 x 64 groups in one line of labels, in random order."""
    labels = list(range(4096))
    random.Random(6).shuffle(labels)
    edges = [(0, a, b) for a, b in zip(labels, labels[1:])] + [(1, 7, 9), (1, 9, 12)]
    rounds = []
    found = regions.component_minimum(spark.createDataFrame(edges, "k int, u long, v long"), ["k"], rounds=rounds).collect()
    assert {(r.k, r.node): r.root for r in found} == {**{(0, i): 0 for i in range(1, 4096)}, (1, 9): 7, (1, 12): 7}
    assert len(rounds) <= 2 * math.log2(4096)
