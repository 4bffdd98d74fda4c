"""SQL text of the derived tables and detector stages, for the side-by-side SQL checks.

The detector stages are written independently of the Spark operators: box sums by a pixel self-join
over mirrored positions and regions by a recursive flood, instead of windows and run labels.
"""

from __future__ import annotations

from emberfield import fixed_values as fv
from emberfield.sources.derived import PIXEL_TEMPERATURE

TEXT = {
    "pixels": f"""pixels AS (SELECT frame_id, row_idx, col_idx, {PIXEL_TEMPERATURE} AS temp_c, 20 AS height, 25 AS width
  FROM (SELECT o_orderkey AS k, o_totalprice, o_orderkey // 500 AS frame_id, (o_orderkey % 500) // 25 AS row_idx,
               o_orderkey % 25 AS col_idx, (o_orderkey // 500) % 6 AS kind FROM orders) b)""",
    "frames": """frames AS (SELECT DISTINCT frame_id, 25 AS width, 20 AS height,
  'mission/thermal_' || lpad(CAST(frame_id AS VARCHAR), 6, '0') || '.tif' AS source_path,
  frame_id % 10 = 9 AS uncalibrated, frame_id % 10 = 8 AS raw_counts,
  CASE WHEN frame_id % 4 = 3 THEN NULL ELSE '2024-01-01T00:00:00Z' END AS capture_time,
  -82.0::DOUBLE + frame_id * 0.00025::DOUBLE AS origin_x, frame_id AS input_order
  FROM (SELECT o_orderkey // 500 AS frame_id FROM orders) f)""",
    "observations": """observations AS (SELECT event_id AS obs_ord, event_type AS classification, event_type AS finding_type,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 28.0::DOUBLE + (user_id % 50) * 0.001::DOUBLE + (event_id % 7) * 0.000004::DOUBLE END AS latitude,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE -82.0::DOUBLE + (user_id // 50) * 0.001::DOUBLE + (event_id % 5) * 0.000004::DOUBLE END AS longitude,
  5 + value / 10 AS delta_temperature_c, 30 + value / 8 AS max_temperature_c, 20 + event_id % 80 AS area_px,
  CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, ts FROM events)""",
    "media": """media AS (SELECT event_id AS media_id, CASE WHEN event_type = 'view' THEN 'thermal' ELSE 'visible' END AS sensor_role,
  ts AS capture_ts,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 28.0::DOUBLE + (user_id % 50) * 0.001::DOUBLE + (event_id % 7) * 0.000004::DOUBLE END AS latitude,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE -82.0::DOUBLE + (user_id // 50) * 0.001::DOUBLE + (event_id % 5) * 0.000004::DOUBLE END AS longitude
  FROM events WHERE event_type IN ('view', 'click'))""",
    "scene": """scene0 AS (SELECT frame_id, count(temp_c) AS valid_pixels, median(temp_c) AS med, stddev_pop(temp_c) AS std,
  quantile_cont(temp_c, 0.9) AS p90 FROM pixels GROUP BY frame_id),
scene AS (SELECT s.frame_id, any_value(valid_pixels) AS valid_pixels, any_value(med) AS med, any_value(p90) AS p90,
  median(abs(temp_c - med)) AS mad, greatest(1.4826 * median(abs(temp_c - med)), 0.25 * any_value(std), 0.25) AS scale
  FROM pixels p JOIN scene0 s USING (frame_id) GROUP BY s.frame_id)""",
    "box": """padded AS (SELECT frame_id, rr.pos AS r, cc.pos AS c, temp_c FROM pixels
  JOIN (SELECT pos, CASE WHEN pos > 19 THEN 38 - pos ELSE abs(pos) END AS src FROM range(-7, 27) t(pos)) rr ON rr.src = row_idx
  JOIN (SELECT pos, CASE WHEN pos > 24 THEN 48 - pos ELSE abs(pos) END AS src FROM range(-7, 32) t(pos)) cc ON cc.src = col_idx),
box AS (SELECT p.frame_id, p.row_idx, p.col_idx, any_value(p.temp_c) AS temp_c,
  coalesce(sum(q.temp_c) FILTER (abs(q.r - p.row_idx) <= 1 AND abs(q.c - p.col_idx) <= 1), 0) AS s1,
  count(q.temp_c) FILTER (abs(q.r - p.row_idx) <= 1 AND abs(q.c - p.col_idx) <= 1) AS n1,
  coalesce(sum(q.temp_c) FILTER (abs(q.r - p.row_idx) <= 3 AND abs(q.c - p.col_idx) <= 3), 0) AS s3,
  count(q.temp_c) FILTER (abs(q.r - p.row_idx) <= 3 AND abs(q.c - p.col_idx) <= 3) AS n3,
  coalesce(sum(q.temp_c), 0) AS s7, count(q.temp_c) AS n7
  FROM pixels p JOIN padded q ON q.frame_id = p.frame_id AND q.r BETWEEN p.row_idx - 7 AND p.row_idx + 7
    AND q.c BETWEEN p.col_idx - 7 AND p.col_idx + 7
  GROUP BY p.frame_id, p.row_idx, p.col_idx)""",
    "layers": """refs AS (SELECT *, CASE WHEN n3 > n1 THEN (s3 - s1) / (n3 - n1) END AS ref3,
  CASE WHEN n7 > n1 THEN (s7 - s1) / (n7 - n1) END AS ref7 FROM box),
layers AS (SELECT r.*, temp_c - ref3 AS d3, temp_c - ref7 AS d7, greatest(temp_c - ref3, temp_c - ref7) AS peak,
  CASE WHEN temp_c - ref7 IS NULL OR temp_c - ref3 >= temp_c - ref7 THEN CASE WHEN temp_c - ref3 IS NOT NULL THEN ref3 END ELSE ref7 END AS best_ref,
  coalesce(CAST(temp_c - ref3 >= {gate} AS INT), 0) + coalesce(CAST(temp_c - ref7 >= {gate} AS INT), 0) AS support,
  (temp_c - med) / scale AS robust, temp_c - s7 / nullif(n7, 0) AS residual, med, p90,
  coalesce(greatest(temp_c - ref3, temp_c - ref7) >= {delta} AND
    (coalesce(CAST(temp_c - ref3 >= {gate} AS INT), 0) + coalesce(CAST(temp_c - ref7 >= {gate} AS INT), 0)) >= 1 AND
    ((temp_c - med) / scale >= 1.0 OR temp_c >= p90 OR greatest(temp_c - ref3, temp_c - ref7) >= {strong}), false) AS candidate
  FROM refs r JOIN scene USING (frame_id))""",
    "regions": """cand AS (SELECT frame_id, row_idx * 25 + col_idx AS idx, row_idx, col_idx, temp_c, support, robust, med FROM layers WHERE candidate),
flood AS (SELECT frame_id, idx, row_idx, col_idx, idx AS root FROM cand
  UNION SELECT c.frame_id, c.idx, c.row_idx, c.col_idx, f.root FROM flood f JOIN cand c ON c.frame_id = f.frame_id
    AND abs(c.row_idx - f.row_idx) <= 1 AND abs(c.col_idx - f.col_idx) <= 1),
labels AS (SELECT frame_id, idx, min(root) AS label FROM flood GROUP BY frame_id, idx),
comp AS (SELECT frame_id, label, count(*) AS area, min(row_idx) AS top, max(row_idx) AS bottom, min(col_idx) AS lft, max(col_idx) AS rgt,
  round_even(avg(col_idx), 0) AS cx, round_even(avg(row_idx), 0) AS cy, min(temp_c) AS tmin, avg(temp_c) AS tmean, max(temp_c) AS tmax,
  arg_min(idx, {{'t': -temp_c, 'i': idx}}) AS hot, max(support) AS support, max(robust) AS robust, any_value(med) AS med
  FROM cand JOIN labels USING (frame_id, idx) GROUP BY frame_id, label),
ring AS (SELECT c.frame_id, c.label, median(p.temp_c) AS rmed, count(p.temp_c) AS rn FROM comp c JOIN pixels p ON p.frame_id = c.frame_id
  AND p.row_idx BETWEEN c.top - 7 AND c.bottom + 7 AND p.col_idx BETWEEN c.lft - 7 AND c.rgt + 7
  AND NOT (p.row_idx BETWEEN c.top AND c.bottom AND p.col_idx BETWEEN c.lft AND c.rgt) GROUP BY c.frame_id, c.label),
judged0 AS (SELECT c.*, area / ((rgt - lft + 1) * (bottom - top + 1.0)) AS fill,
  top <= 1 OR lft <= 1 OR bottom >= 18 OR rgt >= 23 AS edge, coalesce(rn, 0) AS rn,
  CASE WHEN coalesce(rn, 0) >= 8 THEN rmed ELSE med END AS ref,
  CASE WHEN coalesce(rn, 0) >= 8 THEN 'surrounding-ring-median' ELSE 'scene-median-fallback' END AS method
  FROM comp c LEFT JOIN ring USING (frame_id, label)),
judged AS (SELECT *, tmax - ref AS delta, CASE WHEN area = 1 THEN 'SINGLE_PIXEL_SPIKE' WHEN area < {area} THEN 'MINIMUM_REGION_SUPPORT'
  WHEN fill < 0.2 THEN 'LOW_SPATIAL_COHERENCE' WHEN tmax - ref < {delta} THEN 'WEAK_LOCAL_CONTRAST'
  WHEN edge AND tmax - ref < 2 * {delta} THEN 'EDGE_ARTIFACT' END AS reason FROM judged0),
found0 AS (SELECT *, least(1.0, delta / (2 * {delta})) AS contrast, least(1.0, area / (2.0 * {area})) AS region,
  support / 2.0 AS persistence, least(1.0, greatest(0.0, robust / 6.0)) AS scene_support FROM judged WHERE reason IS NULL),
found AS (SELECT *, 0.35 * contrast + 0.20 * region + 0.20 * persistence + 0.15 * least(1.0, greatest(0.0, fill)) + 0.10 * scene_support
  - CASE WHEN edge THEN 0.15 ELSE 0 END AS score,
  CASE WHEN delta >= {critical} THEN 'critical' WHEN delta >= {moderate} THEN 'moderate' ELSE 'minor' END AS severity,
  row_number() OVER (PARTITION BY frame_id ORDER BY delta DESC, label) AS rnk FROM found0),
findings AS (SELECT *, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
  'A-' || lpad(CAST(rnk AS VARCHAR), 3, '0') AS finding_id FROM found)""",
    "rois": """roi_list AS (SELECT * FROM (VALUES
  ('spot', 12, 12, NULL, NULL, NULL, NULL, NULL, NULL), ('rectangle', 9, 7, 14, 12, NULL, NULL, NULL, NULL),
  ('circle', NULL, NULL, NULL, NULL, 12, 10, 5, NULL), ('ellipse', NULL, NULL, NULL, NULL, 12, 10, 7, 3),
  ('line', 2, 2, 20, 17, NULL, NULL, NULL, NULL), ('polygon', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL))
  v(kind, x0, y0, x1, y1, cx, cy, rx, ry)),
roi_px AS (SELECT p.frame_id, kind AS roi_id, p.row_idx, p.col_idx, temp_c FROM pixels p CROSS JOIN roi_list r WHERE CASE kind
  WHEN 'spot' THEN col_idx BETWEEN x0 - 1 AND x0 + 2 AND row_idx BETWEEN y0 - 1 AND y0 + 2
  WHEN 'rectangle' THEN col_idx BETWEEN x0 AND x1 AND row_idx BETWEEN y0 AND y1
  WHEN 'circle' THEN (col_idx - cx) * (col_idx - cx) + (row_idx - cy) * (row_idx - cy) <= rx * rx
  WHEN 'ellipse' THEN pow((col_idx - cx) / rx::DOUBLE, 2) + pow((row_idx - cy) / ry::DOUBLE, 2) <= 1
  WHEN 'line' THEN sqrt(pow(col_idx - (x0 + greatest(0, least(1, ((col_idx - x0) * 18.0 + (row_idx - y0) * 15.0) / 549.0)) * 18.0), 2)
    + pow(row_idx - (y0 + greatest(0, least(1, ((col_idx - x0) * 18.0 + (row_idx - y0) * 15.0) / 549.0)) * 15.0), 2)) <= 1.0
  ELSE col_idx + 0.5 > 4 AND col_idx + 0.5 < 18 AND row_idx + 0.5 > 4 AND row_idx + 0.5 < 16 END)""",
}

NEEDS = {
    "scene": ["pixels"],
    "box": ["pixels"],
    "layers": ["pixels", "scene", "box"],
    "regions": ["pixels", "scene", "box", "layers"],
    "rois": ["pixels"],
}


def with_tables(names: list[str], body: str, profile: str = "generic-thermal") -> str:
    """``WITH RECURSIVE`` prefix holding the named stages and everything they need."""
    row = next(r for r in fv.PROFILE_ROWS if r[0] == profile)
    limits = dict(delta=row[3], gate=row[3] * 0.75, strong=row[3] * 1.5, area=row[4], moderate=row[5], critical=row[6])
    ordered: list[str] = []
    for name in names:
        for n in [*NEEDS.get(name, []), name]:
            if n not in ordered:
                ordered.append(n)
    rank = list(TEXT)
    ordered.sort(key=rank.index)
    parts = [TEXT[n].format(**limits) if n in ("layers", "regions") else TEXT[n] for n in ordered]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def r(expr: str, alias: str, digits: int = 4) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {alias}"


def profile_values() -> str:
    """The profile catalogue as a SQL VALUES list."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [
        "({}, {}, {}, {}, {}, {}, {}, {}, {}, {})".format(
            q(p[0]), q(p[1]), p[3], p[4], p[5], p[6], q(p[7]), q(fv.RECOMMENDATION_MINOR),
            q(fv.PROFILE_RECOMMENDATION_MODERATE.get(p[0], fv.RECOMMENDATION_MODERATE)),
            q(fv.PROFILE_RECOMMENDATION_CRITICAL.get(p[0], fv.RECOMMENDATION_CRITICAL)),
        )
        for p in fv.PROFILE_ROWS
    ]
    return (
        "profiles(profile_id, name, minimum_delta_c, minimum_area_px, moderate_delta_c, critical_delta_c, finding_label, "
        "rec_minor, rec_moderate, rec_critical) AS (VALUES " + ", ".join(rows) + ")"
    )
