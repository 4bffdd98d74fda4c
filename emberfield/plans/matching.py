"""Queries that match observations, inspections and media."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.operators import matching
from emberfield.plans.catalog import query, tidy
from emberfield.plans.sql import r, with_tables
from emberfield.sources import derived

DIST = """2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2)
  + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))"""

# b earlier, a later; every compatible pair, then the smallest observation reachable through earlier ones
CLUSTERS = f"""edge AS (SELECT b.obs_ord AS u, a.obs_ord AS v FROM observations a JOIN observations b
  ON a.classification = b.classification AND b.obs_ord < a.obs_ord AND abs(a.latitude - b.latitude) < 0.0005
  AND abs(a.delta_temperature_c - b.delta_temperature_c) <= 8 AND abs(a.max_temperature_c - b.max_temperature_c) <= 12 AND {DIST} <= 3.0),
reach AS (SELECT obs_ord AS node, obs_ord AS root FROM observations WHERE obs_ord NOT IN (SELECT v FROM edge)
  UNION SELECT e.v, q.root FROM reach q JOIN edge e ON e.u = q.node),
clusters AS (SELECT node AS obs_ord, min(root) AS founder FROM reach GROUP BY node),
numbered AS (SELECT founder, count(*) AS members, row_number() OVER (ORDER BY founder) AS n FROM clusters GROUP BY founder)"""


@query(
    "observation_clusters",
    with_tables(["observations"], "").rstrip() + ",\n" + CLUSTERS + " SELECT obs_ord, founder FROM clusters",
)
def observation_clusters(spark, sf):
    return tidy(matching.assign_clusters(derived.observations(spark, sf)).select("obs_ord", "founder"))


@query(
    "canonical_findings",
    with_tables(["observations"], "").rstrip() + ",\n" + CLUSTERS
    + f""", best AS (SELECT c.founder, o.*, row_number() OVER (PARTITION BY c.founder ORDER BY delta_temperature_c DESC, max_temperature_c DESC, area_px DESC, o.obs_ord) AS k
      FROM clusters c JOIN observations o USING (obs_ord))
    SELECT 'A-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS finding_id,
      CASE WHEN members > 1 THEN 'D-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') ELSE '' END AS duplicate_cluster_id,
      obs_ord, members, CASE WHEN members > 1 AND confidence = 'low' THEN 'medium' WHEN members > 2 AND confidence = 'medium' THEN 'high' ELSE confidence END AS confidence,
      {r('delta_temperature_c', 'delta_temperature_c')}, area_px,
      CASE WHEN members > 1 THEN 'corroborated by ' || members || ' geospatially compatible observations' ELSE '' END AS evidence
    FROM best JOIN numbered USING (founder) WHERE k = 1""",
)
def canonical_findings(spark, sf):
    o = derived.observations(spark, sf).withColumn("finding_id", F.format_string("OBS-%d", F.col("obs_ord")))
    c = matching.canonical_findings(matching.assign_clusters(o))
    return tidy(
        c.select("finding_id", "duplicate_cluster_id", "obs_ord", "members", "confidence", "delta_temperature_c", "area_px", "evidence")
    )


@query(
    "supporting_observations",
    with_tables(["observations"], "").rstrip() + ",\n" + CLUSTERS + " SELECT founder, obs_ord, 'OBS-' || obs_ord AS finding_id FROM clusters",
)
def supporting_observations(spark, sf):
    o = derived.observations(spark, sf).withColumn("finding_id", F.format_string("OBS-%d", F.col("obs_ord")))
    return tidy(matching.supporting_observations(matching.assign_clusters(o)))


# The in-order greedy as a recursion over the k-th current observation of every site, all sites side by side; partners
# taken so far are the state. Sites lie 100 m apart, so no pair leaves its site.
COMPARE_SQL = f"""loc AS (SELECT *, floor((latitude - 28.0) / 0.001 + 0.3) AS s1, floor((longitude + 82.0) / 0.001 + 0.3) AS s2 FROM observations WHERE latitude IS NOT NULL),
pr AS (SELECT a.obs_ord AS cur, b.obs_ord AS prev, round({DIST}, 6) AS d FROM loc a JOIN loc b ON a.obs_ord % 2 = 1 AND b.obs_ord % 2 = 0
  AND a.classification = b.classification AND a.s1 = b.s1 AND a.s2 = b.s2 AND {DIST} <= 3.0),
cand AS (SELECT cur, list(prev ORDER BY d, prev) AS partners FROM pr GROUP BY cur),
cu AS (SELECT s1, s2, classification, obs_ord AS cur, row_number() OVER (PARTITION BY s1, s2, classification ORDER BY obs_ord) AS k,
  coalesce(partners, []) AS partners FROM loc LEFT JOIN cand ON cur = obs_ord WHERE obs_ord % 2 = 1),
walk AS (SELECT s1, s2, classification, k, cur, partners[1] AS prev, [partners[1]] AS used FROM cu WHERE k = 1
  UNION ALL SELECT s1, s2, classification, k, cur, free[1], list_append(used, free[1]) FROM
    (SELECT cu.*, w.used, list_filter(cu.partners, lambda x: NOT list_contains(w.used, x)) AS free FROM walk w JOIN cu
     ON cu.s1 = w.s1 AND cu.s2 = w.s2 AND cu.classification = w.classification AND cu.k = w.k + 1) n)"""


@query(
    "inspection_comparison",
    with_tables(["observations"], "").rstrip() + ",\n" + COMPARE_SQL
    + f""" SELECT CASE WHEN prev IS NULL THEN 'new' WHEN dt >= 3 THEN 'worsened' WHEN dt <= -3 THEN 'improved' ELSE 'persisted' END AS state,
      c.obs_ord AS current_ord, prev AS previous_ord, {r('dt', 'delta_t_change_c', 6)}, {r('mt', 'max_temperature_change_c', 6)} FROM
      (SELECT c.obs_ord, w.prev, c.delta_temperature_c - p.delta_temperature_c AS dt, c.max_temperature_c - p.max_temperature_c AS mt FROM observations c
       LEFT JOIN walk w ON w.cur = c.obs_ord LEFT JOIN observations p ON p.obs_ord = w.prev WHERE c.obs_ord % 2 = 1) c
    UNION ALL SELECT 'resolved', NULL, obs_ord, NULL, NULL FROM observations WHERE obs_ord % 2 = 0 AND obs_ord NOT IN (SELECT prev FROM walk WHERE prev IS NOT NULL)""",
)
def inspection_comparison(spark, sf):
    """Even events as the previous inspection, odd ones as the current."""
    o = derived.observations(spark, sf)
    return tidy(matching.compare_inspections(o.where("obs_ord % 2 = 0"), o.where("obs_ord % 2 = 1")), 6)


@query(
    "comparison_candidates",
    with_tables(
        ["observations"],
        f"""SELECT a.obs_ord AS cur, count(*) AS partners, {r(f'min({DIST})', 'nearest_m', 6)} FROM observations a JOIN observations b ON a.obs_ord % 2 = 1 AND b.obs_ord % 2 = 0
        AND a.classification = b.classification AND abs(a.latitude - b.latitude) < 0.0005 AND {DIST} <= 3.0 GROUP BY a.obs_ord""",
    ),
)
def comparison_candidates(spark, sf):
    """How many partners are within range of each current observation, and how near the nearest is."""
    o = derived.observations(spark, sf)
    pairs = matching._candidate_pairs(
        o.where("obs_ord % 2 = 0"), o.where("obs_ord % 2 = 1 AND latitude IS NOT NULL"), 3.0
    )
    near = pairs.groupBy("cur").agg(F.count("*").alias("partners"), F.min("d").alias("nearest_m"))
    return tidy(near, 6)


PAIR = f"""p AS (SELECT a.media_id AS thermal_id, b.media_id AS visible_id, abs(epoch_us(a.capture_ts) - epoch_us(b.capture_ts)) / 1e6 AS gap, {DIST} AS d
  FROM media a JOIN media b ON a.sensor_role = 'thermal' AND b.sensor_role = 'visible'
  AND (abs(epoch_us(a.capture_ts) - epoch_us(b.capture_ts)) <= 2500000 OR abs(a.latitude - b.latitude) < 0.0005)),
s AS (SELECT *, CASE WHEN gap <= 2.5 THEN 0.6 * (1 - gap / 2.5) ELSE 0 END + CASE WHEN d <= 8 THEN 0.4 * (1 - d / 8) ELSE 0 END AS score FROM p WHERE gap <= 2.5 OR d <= 8),
k AS (SELECT *, row_number() OVER (PARTITION BY thermal_id ORDER BY round(score, 12) DESC, visible_id) AS n FROM s)"""


@query(
    "media_pairs",
    with_tables(["media"], "").rstrip() + ",\n" + PAIR
    + f""" SELECT thermal_id, visible_id, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS confidence, {r('score', 'score')},
      {r('d', 'distance_m', 3)} FROM k WHERE n = 1""",
)
def media_pairs(spark, sf):
    m = derived.media(spark, sf)
    out = matching.pair_media(m.where("sensor_role = 'thermal'"), m.where("sensor_role = 'visible'"))
    out = out.withColumn("distance_m", F.round("distance_m", 3))
    return tidy(out.select("thermal_id", "visible_id", "confidence", "score", "distance_m"))


@query(
    "unpaired_media",
    with_tables(["media"], "").rstrip() + ",\n" + PAIR
    + " SELECT media_id FROM media WHERE sensor_role = 'thermal' AND media_id NOT IN (SELECT thermal_id FROM k)",
)
def unpaired_media(spark, sf):
    m = derived.media(spark, sf)
    t = m.where("sensor_role = 'thermal'")
    paired = matching.pair_media(t, m.where("sensor_role = 'visible'"))
    return tidy(t.join(paired, t["media_id"] == paired["thermal_id"], "left_anti").select("media_id"))
