"""DuckDB SQL for the registered queries, written from the operators' definitions (brute force, no shared code)."""

from __future__ import annotations

import re

from lanewise.schema import PRESETS, TRACK_SHAPE_WEIGHTS, AgentType, PairType

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _needed(sql: str) -> list[str]:
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z][a-z0-9_]*)", text):
            if name in CTES and name not in order:
                if name in _open:
                    continue
                _open.add(name)
                visit(CTES[name])
                order.append(name)

    _open: set[str] = set()
    visit(sql)
    return order


def oracle(name: str, sql: str) -> None:
    sql = sql.strip()
    parts = [f"{n}{_HEADS.get(n, '')} AS {'MATERIALIZED ' if n in _KEPT else ''}({CTES[n]})" for n in _needed(sql)]
    if parts:
        own = sql.startswith("WITH ")
        sql = "WITH RECURSIVE " + ",\n".join(parts) + (",\n" + sql[5:] if own else "\n" + sql)
    ORACLES[name] = sql


_HEADS: dict[str, str] = {}
_KEPT = {"lf", "lnext"}


_SETTLED = ("win", "crf", "aff", "mrg", "dn", "wa", "after_", "probe_", "sum_", "probed_", "sumd")


def settled(sql: str) -> str:
    """The same text over the probe tables whose increases and critical values are compared to nine digits, as the operator does."""
    return re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(_SETTLED)})\b", r"\1 \2_9", sql)


def settle(*names: str) -> None:
    for n in names:
        cte(f"{n}_9", settled(CTES[n]).replace("delta >= 1", "round(delta,9) >= 1").replace("d.round(delta,9)", "round(d.delta,9)").replace(
            "ORDER BY delta", "ORDER BY round(delta,9)").replace("ORDER BY ttc", "ORDER BY round(ttc,9)").replace("ORDER BY drac", "ORDER BY round(drac,9)"))


def r(expr: str, alias: str | None = None, digits: int = 6) -> str:
    e = f"({expr})"
    text = (f"CASE WHEN isnan({e}) THEN NULL WHEN isinf({e}) THEN 1e9*sign({e}) WHEN round({e},{digits})=0 THEN 0e0 "
            f"ELSE round({e},{digits}) END")
    return f"{text} AS {alias or expr.split('.')[-1]}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits=digits) for n in names)


# --- canonical tables ---------------------------------------------------------------------------------------------

cte("ev", """
SELECT user_id, event_id, ts, event_type, value, CAST(regexp_extract(props,'[0-9]+',0) AS BIGINT) AS k,
 epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events""")
cte("pt0", """
SELECT (user_id - user_id % 10)*1000000000 + seq // 40 AS scenario_id,
 CASE WHEN (user_id - user_id % 10) % 20 = 0 THEN 'alpha' ELSE 'beta' END AS dataset,
 user_id % 10 AS agent_idx, user_id AS agent_id, CAST(seq % 40 AS INTEGER) AS t, user_id, k, value, event_type FROM ev""")
cte("pts", """
SELECT scenario_id, dataset, agent_idx, agent_id, ego_idx, t,
 CASE WHEN agent_idx = ego_idx THEN 5 WHEN agent_idx IN (3,7) THEN 2 WHEN agent_idx = 5 THEN 3
  WHEN agent_idx IN (8,9) THEN 4 ELSE 1 END AS agent_type,
 CAST(t AS DOUBLE)*1e-1 + CAST(k % 3 AS DOUBLE)*1e-2 AS ts_s,
 CAST(agent_idx AS DOUBLE)*6e0 + CASE WHEN agent_idx = 9 THEN 5e2 ELSE 0e0 END
  + CASE WHEN agent_idx IN (2,8) THEN 0e0 WHEN agent_idx = 4 THEN -8e-1 ELSE 1e-1*CAST(5 + user_id % 7 AS DOUBLE) END
  * CAST(t AS DOUBLE) AS x,
 CAST(k % 5 AS DOUBLE)*2e-1 + CASE WHEN agent_idx = 6 THEN 5e-2*CAST(t AS DOUBLE)*CAST(t AS DOUBLE) ELSE 0e0 END AS y,
 0e0 AS z, 45e-1 AS length, 2e0 AS width, 15e-1 AS height,
 CASE WHEN agent_idx = 4 THEN 3.141592653589793e0 WHEN agent_idx = 6 THEN 5e-2*CAST(t AS DOUBLE)
  ELSE 1e-2*CAST(k % 7 AS DOUBLE) END AS heading,
 CASE WHEN agent_idx IN (2,8) THEN 0e0 WHEN agent_idx = 4 THEN -8e0 ELSE CAST(5 + user_id % 7 AS DOUBLE) END
  + CASE WHEN agent_idx IN (2,8) THEN 0e0 ELSE sqrt(abs(value))*1e-1 END AS vx,
 CASE WHEN agent_idx = 6 THEN CAST(t AS DOUBLE) ELSE 0e0 END AS vy,
 event_type <> 'error' AS valid
FROM (SELECT *, min(agent_idx) OVER (PARTITION BY scenario_id) AS ego_idx FROM pt0)""")
cte("scen", """
SELECT scenario_id, any_value(dataset) AS dataset, min(agent_idx) AS ego_idx, 15 AS now, max(t)+1 AS n_steps
FROM pts GROUP BY scenario_id""")
cte("agt", """
SELECT DISTINCT scenario_id, agent_idx, dataset, agent_id, agent_type, ego_idx,
 CASE agent_type WHEN 4 THEN NULL WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS difficulty FROM pts""")
cte("vp", "SELECT * FROM pts WHERE valid")
cte("mp", """
SELECT scenario_id, 'lane' AS feature_class, l.r AS feature_idx, p.r AS point_idx,
 CASE WHEN l.r = 4 THEN 4e1 ELSE 4e0*CAST(p.r AS DOUBLE) END AS x,
 CASE WHEN l.r = 4 THEN 2e0*CAST(p.r AS DOUBLE) - 241e-1 ELSE 35e-1*CAST(l.r - 2 AS DOUBLE) + 1e-1 END AS y,
 0e0 AS z, 2 AS polyline_type
FROM scen, (SELECT CAST(r_regionkey AS BIGINT) AS r FROM region) l, (SELECT CAST(n_nationkey AS BIGINT) AS r FROM nation) p
UNION ALL
SELECT scenario_id, 'crosswalk', 0, r, 2e1 + CAST(r % 2 AS DOUBLE)*3e0, CAST(r - r % 2 AS DOUBLE) - 5e0, 0e0, 18
FROM scen, (SELECT CAST(n_nationkey AS BIGINT) AS r FROM nation) WHERE r < 8""")
cte("lan", """
SELECT scenario_id, CAST(r_regionkey AS BIGINT) AS lane_idx, 25e0 + 5e0*r_regionkey AS mph FROM scen, region""")
cte("sig", """
SELECT scenario_id, t, CAST(r_regionkey AS BIGINT) + 100 AS lane_id, 3e1 + r_regionkey AS x,
 35e-1*(r_regionkey - 2) + 3e-1 AS y, 0e0 AS z FROM scen, region, (SELECT unnest([3,7]) AS t)""")

# --- sources ------------------------------------------------------------------------------------------------------

oracle("S01_scan_track_points", f"""
SELECT scenario_id, dataset, agent_idx, agent_id, t, agent_type, valid,
 {rs('ts_s','x','y','z','length','width','height','heading','vx','vy')} FROM pts""")
oracle("S02_sample_scenarios", """
SELECT scenario_id FROM scen ORDER BY md5('7:' || CAST(scenario_id AS VARCHAR)), scenario_id LIMIT 12""")
oracle("S03_truncate_horizon", """
SELECT h.horizon, scenario_id, agent_idx, count(*) AS steps FROM pts
JOIN (SELECT 'gt' AS horizon, 30 AS n UNION ALL SELECT 'ho', 11) h ON t < h.n GROUP BY ALL""")
oracle("S03_too_short", "SELECT scenario_id, n_steps FROM scen WHERE n_steps < 40")
oracle("S04_pad_tracks", f"""
WITH e AS (SELECT scenario_id, agent_idx, max(t) AS lt FROM pts GROUP BY ALL),
f AS (SELECT e.*, a.ts_s AS ts1, coalesce(a.ts_s - b.ts_s, 1e-1) AS dt FROM e
 JOIN pts a ON a.scenario_id=e.scenario_id AND a.agent_idx=e.agent_idx AND a.t=e.lt
 LEFT JOIN pts b ON b.scenario_id=e.scenario_id AND b.agent_idx=e.agent_idx AND b.t=e.lt-1)
SELECT scenario_id, agent_idx, t, {rs('ts_s','x','y','vx')}, valid FROM pts
UNION ALL
SELECT scenario_id, agent_idx, CAST(g.t AS INTEGER), {r('ts1 + dt*(g.t - lt)','ts_s')}, 0e0, 0e0, 0e0, false
FROM f JOIN (SELECT unnest(range(0,45)) AS t) g ON g.t > lt""")
oracle("S05_category_to_agent_type", """
SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1
 ELSE 4 END AS agent_type FROM events""")
oracle("S06_default_box", """
SELECT event_id, CASE event_type WHEN 'click' THEN 4.5e0 WHEN 'view' THEN 0.8e0 WHEN 'purchase' THEN 2e0 WHEN 'signup'
 THEN 12e0 ELSE 0.5e0 END AS length, CASE event_type WHEN 'click' THEN 2e0 WHEN 'view' THEN 0.8e0 WHEN 'purchase'
 THEN 0.8e0 WHEN 'signup' THEN 2.9e0 ELSE 0.5e0 END AS width, CASE event_type WHEN 'click' THEN 1.7e0 WHEN 'view'
 THEN 1.8e0 WHEN 'purchase' THEN 1.6e0 WHEN 'signup' THEN 3.5e0 ELSE 0.5e0 END AS height FROM events""")
cte("key2", "SELECT *, t*5e-1 + (ts_s - t*1e-1) AS kt, max(t) OVER (PARTITION BY scenario_id) AS last_t FROM pts")
oracle("S07_resample", f"""
WITH g AS (SELECT CAST(unnest(range(0,200)) AS INTEGER) AS k),
pos AS (SELECT a.scenario_id, a.agent_idx, g.k, max(a.t) AS t FROM key2 a JOIN g ON a.kt <= g.k/1e1 + 1e-6 GROUP BY ALL)
SELECT p.scenario_id, p.agent_idx, p.k AS t,
 {', '.join(r(f'CASE WHEN b.t IS NULL THEN a.{c} ELSE a.{c} + (b.{c}-a.{c})*(p.k/1e1 - a.kt)/(b.kt-a.kt) END', c)
            for c in ('x','y','heading','length'))}
FROM pos p JOIN key2 a ON a.scenario_id=p.scenario_id AND a.agent_idx=p.agent_idx AND a.t=p.t AND a.valid
LEFT JOIN key2 b ON b.scenario_id=p.scenario_id AND b.agent_idx=p.agent_idx AND b.t=p.t+1
WHERE (b.valid) OR (b.t IS NULL AND a.t = a.last_t AND abs(p.k/1e1 - a.kt) < 1e-6)""")
oracle("S08_stride", f"""
SELECT scenario_id, agent_idx, CAST(t // 2 AS INTEGER) AS t, {rs('x','y')}, valid FROM pts WHERE t % 2 = 0""")
oracle("S09_velocity", f"""
WITH n AS (SELECT p.*, q.x AS qx, q.y AS qy, q.t AS qt, s.x AS sx, s.y AS sy, s.t AS st FROM pts p
 LEFT JOIN vp q ON q.scenario_id=p.scenario_id AND q.agent_idx=p.agent_idx AND q.t=p.t-1
 LEFT JOIN vp s ON s.scenario_id=p.scenario_id AND s.agent_idx=p.agent_idx AND s.t=p.t+1)
SELECT scenario_id, agent_idx, t,
 {r('CASE WHEN valid AND (qt IS NOT NULL OR st IS NOT NULL) THEN (coalesce(sx,x)-coalesce(qx,x))/(1e-1*(coalesce(st,t)-coalesce(qt,t))) ELSE vx END','vx')},
 {r('CASE WHEN valid AND (qt IS NOT NULL OR st IS NOT NULL) THEN (coalesce(sy,y)-coalesce(qy,y))/(1e-1*(coalesce(st,t)-coalesce(qt,t))) ELSE vy END','vy')}
FROM n""")
oracle("S10_densify", f"""
SELECT a.scenario_id, a.agent_idx, CAST(g.t AS INTEGER) AS t, a.agent_type, {r('coalesce(v.x,0e0)','x')},
 {r('coalesce(v.y,0e0)','y')}, {r('coalesce(v.length,0e0)','length')}, v.t IS NOT NULL AS valid
FROM (SELECT DISTINCT scenario_id, agent_idx, agent_type FROM vp) a JOIN scen s ON s.scenario_id=a.scenario_id
JOIN (SELECT unnest(range(0,40)) AS t) g ON g.t < s.n_steps
LEFT JOIN vp v ON v.scenario_id=a.scenario_id AND v.agent_idx=a.agent_idx AND v.t=g.t""")
oracle("S11_dense_ids", """
WITH f AS (SELECT scenario_id, agent_id, min(t) AS t0, max(CASE WHEN agent_idx=ego_idx THEN 1 ELSE 0 END) AS ego
 FROM pts WHERE valid OR agent_idx=ego_idx GROUP BY ALL)
SELECT scenario_id, agent_id, row_number() OVER (PARTITION BY scenario_id ORDER BY ego DESC, t0, agent_id) - 1 AS agent_idx
FROM f""")
oracle("S12_mark_ego", "SELECT scenario_id, agent_idx, agent_type FROM agt")
oracle("S13_relevance", """
SELECT scenario_id, agent_idx, 'difficulty' AS rule, CASE WHEN agent_idx=ego_idx THEN 1e0 WHEN difficulty=0 THEN 8e-1
 WHEN difficulty=1 THEN 9e-1 WHEN difficulty=2 THEN 1e0 ELSE 0e0 END AS relevance FROM agt
UNION ALL SELECT scenario_id, agent_idx, 'all', 1e0 FROM agt
UNION ALL SELECT scenario_id, agent_idx, 'targets', CASE WHEN agent_idx=ego_idx OR difficulty IS NOT NULL THEN 1e0
 ELSE 0e0 END FROM agt""")
oracle("S14_select_targets", """
SELECT scenario_id, agent_idx, CASE WHEN agent_type=2 THEN 0 ELSE 1 END AS difficulty FROM agt WHERE agent_type<>4""")
oracle("S15_targets_by_scene", """
SELECT DISTINCT user_id % 10 AS scene, user_id AS instance FROM events WHERE event_type='purchase'""")
oracle("S16_frequency", f"""
WITH l AS (SELECT scenario_id, t, min(ts_s) AS ts FROM pts GROUP BY ALL),
d AS (SELECT scenario_id, ts - lag(ts) OVER (PARTITION BY scenario_id ORDER BY t) AS dt FROM l),
f AS (SELECT scenario_id, least(round_even(1e0/avg(dt),0), 1e1) AS hz FROM d GROUP BY 1 HAVING count(dt) > 0)
SELECT f.scenario_id, {r('f.hz','frequency_hz')}, {r('max(p.ts_s)-min(p.ts_s)','duration_s')}
FROM f JOIN pts p ON p.scenario_id=f.scenario_id GROUP BY f.scenario_id, f.hz""")
oracle("S17_first_keyframes", f"""
WITH f AS (SELECT user_id AS scene, event_id AS frame_id, ts_us, seq+1 AS keyframe FROM ev WHERE seq < 13)
SELECT scene, frame_id, keyframe, {r('(ts_us - min(ts_us) OVER (PARTITION BY scene))/1e6','ts_s')} FROM f""")
oracle("S18_candidate_frames", """
WITH s AS (SELECT DISTINCT user_id % 4 AS log_id, user_id AS scene FROM ev),
o AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY scene) AS p, count(*) OVER (PARTITION BY log_id) AS n FROM s)
SELECT DISTINCT o.log_id, event_id AS frame_id, ts_us FROM ev JOIN o ON o.scene = user_id
WHERE event_type <> 'error' AND p >= 3 AND p < n - 1""")
cte("lf", "SELECT user_id % 4 AS log_id, ts_us, min(event_id) AS frame_id FROM ev GROUP BY ALL")
cte("lnext", """
SELECT a.log_id, a.ts_us, b.ts_us AS nxt FROM (SELECT *, ts_us + 1800000000 AS lim FROM lf) a
ASOF LEFT JOIN lf b ON b.log_id=a.log_id AND a.lim <= b.ts_us""")
_HEADS["walk"] = "(log_id, ts_us)"
cte("walk", """
SELECT log_id, min(ts_us) FROM lf GROUP BY 1
UNION ALL SELECT n.log_id, n.nxt FROM walk w JOIN lnext n ON n.log_id=w.log_id AND n.ts_us=w.ts_us WHERE n.nxt IS NOT NULL""")
oracle("S19_thin_frames", "SELECT w.log_id, f.frame_id, f.ts_us FROM walk w JOIN lf f ON f.log_id=w.log_id AND f.ts_us=w.ts_us")
cte("ebox", """
SELECT s.scenario_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vp v JOIN scen s
 ON s.scenario_id=v.scenario_id AND v.agent_idx=s.ego_idx GROUP BY 1
UNION ALL SELECT s.scenario_id, min(x), max(x), min(y), max(y) FROM pts p JOIN scen s
 ON s.scenario_id=p.scenario_id AND p.agent_idx=s.ego_idx GROUP BY 1 HAVING NOT bool_or(valid)""")
oracle("S20_crop_to_ego", """
SELECT m.scenario_id, feature_class, count(*) AS points, 'box' AS shape FROM mp m JOIN ebox b ON b.scenario_id=m.scenario_id
 AND x BETWEEN x0-20 AND x1+20 AND y BETWEEN y0-20 AND y1+20 GROUP BY ALL
UNION ALL
SELECT m.scenario_id, feature_class, count(*), 'circle' FROM mp m JOIN ebox b ON b.scenario_id=m.scenario_id
 AND sqrt((x-(x0+x1)/2)**2 + (y-(y0+y1)/2)**2) <= 0.5*sqrt((x1-x0)**2+(y1-y0)**2)+20 GROUP BY ALL""")
oracle("S21_feature_ranges", """
WITH n AS (SELECT scenario_id, feature_class, feature_idx, count(*) AS n FROM mp GROUP BY ALL),
o AS (SELECT *, CAST(sum(n) OVER (PARTITION BY scenario_id ORDER BY feature_class, feature_idx) AS BIGINT) AS e FROM n)
SELECT scenario_id, feature_class, feature_idx, e - n AS start, e AS "end" FROM o""")
oracle("S22_polyline_directions", f"""
WITH d AS (SELECT *, x-coalesce(lag(x) OVER w,x) AS ex, y-coalesce(lag(y) OVER w,y) AS ey, z-coalesce(lag(z) OVER w,z) AS ez FROM mp
 WINDOW w AS (PARTITION BY scenario_id, feature_class, feature_idx ORDER BY point_idx)), m AS (SELECT *, greatest(sqrt(ex*ex+ey*ey+ez*ez),1e-6) AS n FROM d)
SELECT scenario_id, feature_class, feature_idx, point_idx, {r('ex/n','dx')}, {r('ey/n','dy')}, {r('ez/n','dz')} FROM m""")
oracle("S23_yaw_and_direction", f"""
SELECT scenario_id, agent_idx, t, {r('heading','yaw')}, {r('cos(heading)','dir_x')}, {r('sin(heading)','dir_y')} FROM pts""")
oracle("S24_lane_boundaries", """
SELECT scenario_id, feature_idx, point_idx, CASE feature_idx WHEN 0 THEN 7 WHEN 1 THEN 10 ELSE 7 END AS polyline_type
FROM mp WHERE feature_class='lane' AND feature_idx IN (0,1,3)""")
oracle("S24_close_crosswalk", """
SELECT scenario_id, feature_idx, CASE WHEN point_idx % 2 = 0 THEN point_idx // 2 ELSE 7 - point_idx // 2 END AS point_idx,
 x, y FROM mp WHERE feature_class='crosswalk'""")
oracle("S25_speed_limit_mph", f"""
SELECT scenario_id, lane_idx, CASE WHEN lane_idx < 4 THEN {r('mph','mph').rsplit(' AS ',1)[0]} END AS mph FROM lan""")
oracle("S26_violations", """
WITH l AS (SELECT scenario_id, agent_idx, count(*) AS n FROM pts GROUP BY ALL)
SELECT scenario_id, 'unequal_length' AS rule, count(*) AS rows FROM (SELECT *, max(n) OVER (PARTITION BY scenario_id) AS m
 FROM l) WHERE n < m GROUP BY 1""")
oracle("S33_signal_steps", """
SELECT scenario_id, t, lane_id, CAST(dense_rank() OVER (PARTITION BY scenario_id ORDER BY t) - 1 AS INTEGER) AS step FROM sig""")
cte("epos", """
SELECT DISTINCT v.scenario_id, x, y FROM vp v JOIN scen s ON s.scenario_id=v.scenario_id AND s.ego_idx=v.agent_idx""")
oracle("S34_overlapping_scenarios", """
WITH o AS (SELECT a.scenario_id AS a, b.scenario_id AS b FROM epos a JOIN epos b ON a.x=b.x AND a.y=b.y
 AND a.scenario_id<>b.scenario_id GROUP BY ALL HAVING count(*) >= 5)
SELECT scenario_id, scenario_id IN (SELECT a FROM o) AS overlaps FROM scen""")

# --- per-agent features -------------------------------------------------------------------------------------------

cte("i0", """
SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_idx ORDER BY t) - 1 AS a,
 count(*) OVER (PARTITION BY scenario_id, agent_idx) AS n, sqrt(vx*vx+vy*vy) AS rs FROM vp""")
cte("sm", """
SELECT p.scenario_id, p.agent_idx, p.agent_type, p.t, p.ts_s, p.a, p.n, p.x, p.y, p.z, p.heading, p.rs AS raw_speed,
 sum(q.rs)/5 AS speed FROM i0 p, (SELECT unnest([-2,-1,0,1,2]) AS k) k, i0 q
WHERE q.scenario_id=p.scenario_id AND q.agent_idx=p.agent_idx AND q.a=least(greatest(p.a+k.k,0),p.n-1) AND p.n >= 2
GROUP BY ALL""")


def _slope(src: str, val: str, out: str) -> str:
    return f"""
SELECT p.*, CASE WHEN b.a IS NULL THEN (f.{val}-p.{val})/(f.ts_s-p.ts_s)
 WHEN f.a IS NULL THEN (p.{val}-b.{val})/(p.ts_s-b.ts_s)
 ELSE ((p.ts_s-b.ts_s)/(f.ts_s-b.ts_s))*((f.{val}-p.{val})/(f.ts_s-p.ts_s))
  + ((f.ts_s-p.ts_s)/(f.ts_s-b.ts_s))*((p.{val}-b.{val})/(p.ts_s-b.ts_s)) END AS {out}
FROM {src} p LEFT JOIN {src} b ON b.scenario_id=p.scenario_id AND b.agent_idx=p.agent_idx AND b.a=p.a-1
LEFT JOIN {src} f ON f.scenario_id=p.scenario_id AND f.agent_idx=p.agent_idx AND f.a=p.a+1"""


cte("ac", _slope("sm", "speed", "accel"))
cte("jk", _slope("ac", "accel", "jrk"))
oracle("F04_smoothed_speed", f"SELECT scenario_id, agent_idx, t, {rs('raw_speed','speed')} FROM sm")
oracle("F07_acceleration_and_jerk", f"SELECT scenario_id, agent_idx, t, {r('accel')}, {r('abs(jrk)','jerk')} FROM jk")
for _name, _step, _last in (("cl", 1, 24), ("cl_half", 2, 12)):
    cte(_name, f"""
WITH d AS (SELECT v.scenario_id, v.agent_idx, v.t, v.x, v.y, m.feature_idx AS lane_idx, m.point_idx // {_step} AS pi, m.x AS mx,
  m.y AS my, sqrt((v.x-m.x)**2+(v.y-m.y)**2) AS d FROM vp v JOIN mp m ON m.scenario_id=v.scenario_id AND
  m.feature_class='lane' AND m.point_idx % {_step} = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY scenario_id,agent_idx,t,lane_idx ORDER BY d, pi) AS rn FROM d),
b AS (SELECT n.*, min(d) OVER (PARTITION BY scenario_id,agent_idx,lane_idx) <= 10 AS gate FROM n WHERE rn=1),
s AS (SELECT b.*, CASE WHEN b.pi=0 THEN 0 WHEN b.pi={_last} THEN {_last - 1} WHEN p.d < q.d THEN b.pi-1 ELSE b.pi END AS seg
  FROM b LEFT JOIN d p ON p.scenario_id=b.scenario_id AND p.agent_idx=b.agent_idx AND p.t=b.t AND p.lane_idx=b.lane_idx
   AND p.pi=b.pi-1
  LEFT JOIN d q ON q.scenario_id=b.scenario_id AND q.agent_idx=b.agent_idx AND q.t=b.t AND q.lane_idx=b.lane_idx
   AND q.pi=b.pi+1),
e AS (SELECT s.*, u.mx AS ax, u.my AS ay, w.mx AS bx, w.my AS by_ FROM s
  JOIN d u ON u.scenario_id=s.scenario_id AND u.agent_idx=s.agent_idx AND u.t=s.t AND u.lane_idx=s.lane_idx AND u.pi=s.seg
  JOIN d w ON w.scenario_id=s.scenario_id AND w.agent_idx=s.agent_idx AND w.t=s.t AND w.lane_idx=s.lane_idx AND w.pi=s.seg+1),
f AS (SELECT *, ((x-ax)*(bx-ax)+(y-ay)*(by_-ay))/((bx-ax)**2+(by_-ay)**2) AS u FROM e),
g AS (SELECT *, sqrt((x-(ax+u*(bx-ax)))**2+(y-(ay+u*(by_-ay)))**2) AS pd FROM f),
h AS (SELECT *, gate AND u>=0 AND u<=1 AND pd<d AS use FROM g),
o AS (SELECT scenario_id, agent_idx, t, lane_idx, CASE WHEN use THEN pd ELSE d END AS distance,
  CASE WHEN use THEN seg+u ELSE CAST(pi AS DOUBLE) END AS point_idx, CASE WHEN use THEN ax+u*(bx-ax) ELSE mx END AS proj_x,
  CASE WHEN use THEN ay+u*(by_-ay) ELSE my END AS proj_y FROM h)
SELECT *, CAST(row_number() OVER (PARTITION BY scenario_id,agent_idx,t ORDER BY distance, lane_idx) AS INTEGER) AS rank
FROM o QUALIFY row_number() OVER (PARTITION BY scenario_id,agent_idx,t ORDER BY distance, lane_idx) <= 16""")
oracle("M06_closest_lanes", f"""
SELECT scenario_id, agent_idx, t, rank, lane_idx, {rs('distance','point_idx','proj_x','proj_y')} FROM cl""")
oracle("M07_closest_lanes_of_every_second_point", f"""
SELECT scenario_id, agent_idx, t, rank, lane_idx, {rs('distance','point_idx','proj_x','proj_y')} FROM cl_half WHERE rank <= 3""")
cte("lg", """
SELECT s.scenario_id, s.agent_idx, s.t, avg(abs(s.speed - l.mph*0.44704e0)) AS limit_gap FROM sm s
JOIN cl c ON c.scenario_id=s.scenario_id AND c.agent_idx=s.agent_idx AND c.t=s.t AND c.rank <= 3
JOIN lan l ON l.scenario_id=s.scenario_id AND l.lane_idx=c.lane_idx GROUP BY ALL""")
oracle("F06_speed_limit_gap", f"SELECT scenario_id, agent_idx, t, {r('limit_gap')} FROM lg")
for _c, _f in (("critical", "max"), ("average", "avg")):
    cte(f"f8_{_c}", f"""
SELECT scenario_id, agent_idx, count(*) AS n_valid, {_f}(speed) AS speed,
 coalesce({_f}(accel) FILTER (accel >= 0), 0) AS acceleration, coalesce({_f}(-accel) FILTER (accel < 0), 0) AS deceleration,
 {_f}(abs(jrk)) AS jerk, any_value(agent_type) AS agent_type FROM jk GROUP BY scenario_id, agent_idx""")
# Sums and slopes in the order the operator states them, so that no rounding is left to chance. A constant speed has accelerations of some
# 1e-14 of either sign: none of them is a deceleration.
_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
cte("f8_sm", "SELECT *, (rs" + "".join(
    f" + coalesce(lag(rs,{k}) OVER w, first_value(rs) OVER f) + coalesce(lead(rs,{k}) OVER w, last_value(rs) OVER f)" for k in (1, 2)) + f""")/5e0 AS speed
FROM i0 WHERE n >= 2 WINDOW w AS (PARTITION BY scenario_id, agent_idx ORDER BY t), f AS (PARTITION BY scenario_id, agent_idx ORDER BY t {_ALL})""")
for _n, _src, _v, _out in (("f8_ac", "f8_sm", "speed", "accel"), ("f8_jk", "f8_ac", "accel", "jrk")):
    cte(_n, f"""
WITH s AS (SELECT *, lag({_v}) OVER w AS pv, lead({_v}) OVER w AS nv, ts_s - lag(ts_s) OVER w AS b, lead(ts_s) OVER w - ts_s AS f
 FROM {_src} WINDOW w AS (PARTITION BY scenario_id, agent_idx ORDER BY t))
SELECT * EXCLUDE (pv, nv, b, f), CASE WHEN b IS NULL THEN (nv - {_v})/f WHEN f IS NULL THEN ({_v} - pv)/b
 ELSE (b*b*nv + (f*f - b*b)*{_v} - f*f*pv)/(b*f*(b + f)) END AS {_out} FROM s""")
for _c, _f in (("critical", "max({})"), ("average", "avg({} ORDER BY t)")):
    cte(f"f8s_{_c}", f"""
SELECT scenario_id, agent_idx, count(*) AS n_valid, {_f.format('speed')} AS speed,
 coalesce({_f.format('greatest(accel,0e0)')} FILTER (accel >= -1e-9), 0) AS acceleration,
 coalesce({_f.format('-accel')} FILTER (accel < -1e-9), 0) AS deceleration, {_f.format('abs(jrk)')} AS jerk FROM f8_jk GROUP BY scenario_id, agent_idx""")
oracle("F08_acceleration_split", " UNION ALL ".join(
    f"SELECT '{c}' AS criterion, scenario_id, agent_idx, n_valid, {rs('speed','acceleration','deceleration','jerk')} FROM f8s_{c}"
    for c in ("critical", "average")))
cte("lint", """
SELECT DISTINCT p.scenario_id, p.feature_idx AS la, q.feature_idx AS lb, e.lane, e.pi, e.x, e.y FROM mp p JOIN mp q
 ON q.scenario_id=p.scenario_id AND p.feature_class='lane' AND q.feature_class='lane' AND p.feature_idx < q.feature_idx
 AND sqrt((p.x-q.x)**2+(p.y-q.y)**2) < 5e-1,
 LATERAL (SELECT p.feature_idx AS lane, p.point_idx AS pi, p.x AS x, p.y AS y UNION ALL
          SELECT q.feature_idx, q.point_idx, q.x, q.y) e""")
cte("cps0", """
SELECT scenario_id, 'static' AS kind, x, y FROM mp WHERE feature_class='crosswalk'
UNION ALL SELECT scenario_id, 'lane_intersection', x, y FROM lint""")
cte("cps", "SELECT * FROM cps0 UNION ALL SELECT scenario_id, 'dynamic', x, y FROM sig WHERE t=3")
cte("runs", """
WITH s AS (SELECT *, speed <= 2 AS still FROM sm), g AS (SELECT *, a - row_number() OVER (PARTITION BY scenario_id, agent_idx,
  still ORDER BY a) AS grp FROM s),
r AS (SELECT scenario_id, agent_idx, grp, min(a) AS a0, max(a) AS a1 FROM g WHERE still GROUP BY ALL)
SELECT r.scenario_id, r.agent_idx, r.a0, p.x, p.y, coalesce(q.ts_s, l.ts_s) - p.ts_s AS sec FROM r
JOIN sm p ON p.scenario_id=r.scenario_id AND p.agent_idx=r.agent_idx AND p.a=r.a0
JOIN sm l ON l.scenario_id=r.scenario_id AND l.agent_idx=r.agent_idx AND l.a=r.a1
LEFT JOIN sm q ON q.scenario_id=r.scenario_id AND q.agent_idx=r.agent_idx AND q.a=r.a1+1""")
cte("rund", """
SELECT r.scenario_id, r.agent_idx, r.a0, r.sec/(min(sqrt((r.x-c.x)**2+(r.y-c.y)**2))+1e-6) AS w FROM runs r
JOIN cps c ON c.scenario_id=r.scenario_id GROUP BY r.scenario_id, r.agent_idx, r.a0, r.sec""")
oracle("F10_waiting_period", " UNION ALL ".join(
    f"SELECT scenario_id, agent_idx, {r(f'{f}(w)','waiting_period',4)}, '{c}' AS criterion FROM rund GROUP BY scenario_id, agent_idx"
    for c, f in (("critical", "max"), ("average", "avg"))))
cte("shp", """
WITH b AS (SELECT scenario_id, agent_idx, arg_min(x,t) AS x0, arg_max(x,t) AS x1, arg_min(y,t) AS y0, arg_max(y,t) AS y1,
  arg_min(degrees(heading),t) AS h0, arg_max(degrees(heading),t) AS h1, arg_min(speed,t) AS s0, arg_max(speed,t) AS s1
  FROM sm GROUP BY ALL),
c AS (SELECT *, x1-x0 AS dx, y1-y0 AS dy, radians(h0) AS h, h1-h0 AS dh FROM b),
d AS (SELECT *, dx*cos(h)+dy*sin(h) AS lon, dy*cos(h)-dx*sin(h) AS lat FROM c)
SELECT scenario_id, agent_idx, CAST(CASE WHEN greatest(s0,s1) < 2 AND sqrt(dx*dx+dy*dy) < 5 THEN 0
 WHEN abs(dh) < 30 AND abs(lat) < 5 THEN 1 WHEN abs(dh) < 30 AND lat < 0 THEN 2 WHEN abs(dh) < 30 THEN 3
 WHEN dh < -30 AND lat < 0 AND lon < -5 THEN 4 WHEN dh < -30 AND lat < 0 THEN 5 WHEN lon < -5 THEN 6 ELSE 7 END AS INTEGER)
 AS trajectory_type FROM d""")
oracle("F11_trajectory_type", "SELECT scenario_id, agent_idx, trajectory_type FROM shp")
cte("kh", """
SELECT v.scenario_id, v.agent_idx, v.x, v.y, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY v.scenario_id,
 v.agent_idx) AS n FROM vp v JOIN scen s ON s.scenario_id=v.scenario_id WHERE v.t <= s.now
WINDOW w AS (PARTITION BY v.scenario_id, v.agent_idx ORDER BY v.t)""")
cte("kv", """
SELECT a.scenario_id, a.agent_idx, (b.x-a.x)/(a.n-1) AS vx, (b.y-a.y)/(a.n-1) AS vy FROM kh a JOIN kh b
 ON b.scenario_id=a.scenario_id AND b.agent_idx=a.agent_idx AND a.k=0 AND b.k=b.n-1 AND a.n >= 2""")
_HEADS["kf"] = "(scenario_id, agent_idx, k, sx, sy, p, v)"
cte("kf", """
SELECT scenario_id, agent_idx, k, x, y, 1e0, 1e0 FROM kh WHERE k=0
UNION ALL
SELECT f.scenario_id, f.agent_idx, h.k, f.sx+kv.vx + ((f.p+f.v+1e-5)/(f.p+f.v+1e-5+1e-4))*(h.x-f.sx-kv.vx),
 f.sy+kv.vy + ((f.p+f.v+1e-5)/(f.p+f.v+1e-5+1e-4))*(h.y-f.sy-kv.vy),
 (f.p+f.v+1e-5)*(1-(f.p+f.v+1e-5)/(f.p+f.v+1e-5+1e-4)), (f.v+1e-5)*(1-(f.v+1e-5)/(f.v+1e-5+1e-4))
FROM kf f JOIN kh h ON h.scenario_id=f.scenario_id AND h.agent_idx=f.agent_idx AND h.k=f.k+1
JOIN kv ON kv.scenario_id=f.scenario_id AND kv.agent_idx=f.agent_idx""")
cte("kal", """
SELECT a.scenario_id, a.agent_idx, coalesce(sqrt((f.sx+kv.vx*(u.t-u.now)-u.x)**2+(f.sy+kv.vy*(u.t-u.now)-u.y)**2)
 *(u.t-u.now)/100, -1) AS kalman_difficulty
FROM (SELECT DISTINCT scenario_id, agent_idx FROM sm) a
LEFT JOIN kv ON kv.scenario_id=a.scenario_id AND kv.agent_idx=a.agent_idx
LEFT JOIN (SELECT kf.* FROM kf JOIN kh ON kh.scenario_id=kf.scenario_id AND kh.agent_idx=kf.agent_idx AND kh.k=kf.k
  AND kf.k=kh.n-1) f ON f.scenario_id=a.scenario_id AND f.agent_idx=a.agent_idx AND kv.vx IS NOT NULL
LEFT JOIN (SELECT v.*, s.now FROM vp v JOIN scen s ON s.scenario_id=v.scenario_id WHERE v.t > s.now
  QUALIFY row_number() OVER (PARTITION BY v.scenario_id, v.agent_idx ORDER BY v.t DESC)=1) u
 ON u.scenario_id=a.scenario_id AND u.agent_idx=a.agent_idx""")
oracle("F12_kalman_difficulty", f"SELECT scenario_id, agent_idx, {r('kalman_difficulty')} FROM kal")
cte("ind", """
SELECT f.*, l.sld AS speed_limit_diff, coalesce(w.w,0) AS waiting_period, s.trajectory_type, k.kalman_difficulty
FROM f8_critical f LEFT JOIN (SELECT scenario_id, agent_idx, max(limit_gap) AS sld FROM lg GROUP BY ALL) l
 ON l.scenario_id=f.scenario_id AND l.agent_idx=f.agent_idx
LEFT JOIN (SELECT scenario_id, agent_idx, max(w) AS w FROM rund GROUP BY ALL) w ON w.scenario_id=f.scenario_id
 AND w.agent_idx=f.agent_idx
JOIN shp s ON s.scenario_id=f.scenario_id AND s.agent_idx=f.agent_idx
JOIN kal k ON k.scenario_id=f.scenario_id AND k.agent_idx=f.agent_idx""")
oracle("F16_individual_features", f"""
SELECT scenario_id, agent_idx, agent_type, n_valid, {rs('speed','speed_limit_diff','acceleration','deceleration','jerk')},
 {r('waiting_period',digits=4)}, trajectory_type, {r('kalman_difficulty')} FROM ind""")
oracle("S36_filter_ids", f"""
SELECT i.scenario_id, i.agent_idx, {r('i.speed','speed')} FROM ind i JOIN scen s ON s.scenario_id=i.scenario_id AND s.dataset='beta'""")
oracle("S37_read_branches", f"""
SELECT i.scenario_id, i.agent_idx, {r('i.speed/2','speed')} FROM ind i JOIN scen s ON s.scenario_id=i.scenario_id AND s.dataset='alpha'""")

# --- map and distances --------------------------------------------------------------------------------------------

oracle("M01_static_conflict_points", f"""
WITH c AS (SELECT * FROM mp WHERE feature_class='crosswalk'), g AS (SELECT unnest(range(0,24)) AS m),
w AS (SELECT c.*, g.m, g.m/3e0 - c.point_idx AS u FROM c, g)
SELECT scenario_id, {r('sum(x*k)','x')}, {r('sum(y*k)','y')}, {r('sum(z*k)','z')} FROM (
 SELECT *, CASE WHEN u=0 THEN 1 WHEN m % 3 = 0 THEN 0 ELSE
  (1 + 2*cos(2*pi()*u/8) + 2*cos(4*pi()*u/8) + 2*cos(6*pi()*u/8) + cos(pi()*u))/8 END AS k FROM w)
GROUP BY scenario_id, m""")
oracle("M02_lane_intersections", f"SELECT scenario_id, {rs('x','y')} FROM lint")
oracle("M03_dynamic_conflict_points", f"""
SELECT 'all' AS rule, scenario_id, {rs('x','y')} FROM sig WHERE t=3
UNION ALL SELECT 'strict_three', scenario_id, {rs('x','y')} FROM sig WHERE t=3 AND lane_id < 103""")
oracle("M04_conflict_points", f"""
SELECT scenario_id, kind, {rs('x','y')} FROM
(SELECT * FROM cps0 UNION ALL SELECT scenario_id, 'dynamic', x, y FROM sig WHERE t=3 AND lane_id < 103)""")
cte("ncp", """
SELECT p.scenario_id, p.agent_idx, p.t, min(sqrt((p.x-c.x)**2+(p.y-c.y)**2)) AS distance FROM pts p JOIN cps c
 ON c.scenario_id=p.scenario_id GROUP BY ALL""")
oracle("M05_nearest_conflict", f"SELECT scenario_id, agent_idx, t, {r('distance')} FROM ncp")
oracle("M12_reaches_conflict", "SELECT scenario_id, agent_idx, max(distance) IS NOT NULL AND min(distance) <= 2 AS in_conflict FROM ncp GROUP BY scenario_id, agent_idx")
cte("den", """
SELECT a.scenario_id, a.agent_idx, g.t, coalesce(p.x,0e0) AS x, coalesce(p.y,0e0) AS y FROM agt a
JOIN scen s ON s.scenario_id=a.scenario_id JOIN (SELECT unnest(range(0,40)) AS t) g ON g.t < s.n_steps
LEFT JOIN pts p ON p.scenario_id=a.scenario_id AND p.agent_idx=a.agent_idx AND p.t=g.t""")
cte("dd", """
SELECT a.scenario_id, a.agent_idx, b.agent_idx AS target_idx, min(sqrt((a.x-b.x)**2+(a.y-b.y)**2)) AS distance
FROM den a JOIN den b ON b.scenario_id=a.scenario_id AND b.t=a.t GROUP BY ALL""")
oracle("M09_target_distances", f"""
SELECT d.scenario_id, d.agent_idx, d.target_idx, {r('d.distance','distance')} FROM dd d JOIN agt a ON a.scenario_id=d.scenario_id
 AND a.agent_idx=d.target_idx AND (a.agent_idx=a.ego_idx OR a.difficulty=2)""")
cte("de", "SELECT d.scenario_id, d.agent_idx, d.distance FROM dd d JOIN scen s ON s.scenario_id=d.scenario_id AND s.ego_idx=d.target_idx")
oracle("M10_ego_distances", f"""
WITH v AS (SELECT a.scenario_id, a.agent_idx, min(sqrt((a.x-b.x)**2+(a.y-b.y)**2)) AS d FROM vp a JOIN scen s
 ON s.scenario_id=a.scenario_id JOIN vp b ON b.scenario_id=a.scenario_id AND b.t=a.t AND b.agent_idx=s.ego_idx GROUP BY ALL),
k AS (SELECT DISTINCT a.scenario_id, a.agent_idx FROM vp a JOIN scen s ON s.scenario_id=a.scenario_id
 JOIN vp b ON b.scenario_id=s.scenario_id AND b.agent_idx=s.ego_idx)
SELECT e.scenario_id, e.agent_idx, {r('e.distance','distance')},
 CASE WHEN k.scenario_id IS NULL THEN NULL WHEN v.d IS NULL THEN 1e9 ELSE {r('v.d','z').rsplit(' AS ',1)[0]} END AS valid_distance
FROM de e LEFT JOIN k ON k.scenario_id=e.scenario_id AND k.agent_idx=e.agent_idx
LEFT JOIN v ON v.scenario_id=e.scenario_id AND v.agent_idx=e.agent_idx""")
oracle("S38_entity_counts", """
SELECT s.scenario_id, (SELECT count(*) FROM agt a WHERE a.scenario_id=s.scenario_id) AS num_agents,
 (SELECT count(*) FROM mp a WHERE a.scenario_id=s.scenario_id) AS num_map_points,
 (SELECT count(*) FROM cps a WHERE a.scenario_id=s.scenario_id) AS num_conflict_points,
 (SELECT count(*) FROM sig a WHERE a.scenario_id=s.scenario_id) AS num_stop_points FROM scen s""")

# --- pairs --------------------------------------------------------------------------------------------------------

PT = """CASE WHEN {a}=5 AND {b}=5 THEN 10 WHEN {a} NOT IN (1,2,3,5) OR {b} NOT IN (1,2,3,5) THEN 10 ELSE
 CASE least(CASE {a} WHEN 5 THEN 1 ELSE {a} END, CASE {b} WHEN 5 THEN 1 ELSE {b} END)*10
 + greatest(CASE {a} WHEN 5 THEN 1 ELSE {a} END, CASE {b} WHEN 5 THEN 1 ELSE {b} END)
 WHEN 11 THEN 1 WHEN 12 THEN 2 WHEN 13 THEN 3 WHEN 22 THEN 4 WHEN 23 THEN 5 WHEN 33 THEN 6 END END"""


def ptype(a="type_i", b="type_j"):
    return "CAST(" + PT.format(a=a, b=b) + " AS INTEGER)"


cte("ap", """
SELECT a.scenario_id, a.agent_idx AS i, b.agent_idx AS j, a.agent_type AS type_i, b.agent_type AS type_j, a.ego_idx FROM agt a
JOIN agt b ON b.scenario_id=a.scenario_id AND a.agent_idx < b.agent_idx""")
oracle("P01_ego_pairs", f"SELECT scenario_id, i, j, type_i, type_j, {ptype()} AS pair_type FROM ap WHERE ego_idx IN (i,j)")
oracle("P02_pair_totals", f"""
SELECT scenario_id, {ptype()} AS pair_type, count(*) AS pairs, count(*) FILTER (5 IN (type_i,type_j)) AS with_ego,
 count(*) FILTER (type_i IN (1,5) OR type_j IN (1,5)) AS with_vehicle FROM ap GROUP BY ALL""")

STEP = "t, x, y, z, sqrt(vx*vx+vy*vy)+1e-6 AS v, degrees(heading) AS h, length AS len"
cte("st", f"SELECT scenario_id, agent_idx, {STEP} FROM vp")
cte("pp", """
SELECT a.scenario_id, -1 AS probed, a.agent_idx AS i, b.agent_idx AS j, a.t,
 row_number() OVER (PARTITION BY a.scenario_id, a.agent_idx, b.agent_idx ORDER BY a.t) - 1 AS pt, a.x AS xi, a.y AS yi,
 a.v AS vi, a.h AS hi, a.len AS li, b.x AS xj, b.y AS yj, b.v AS vj, b.h AS hj, b.len AS lj
FROM st a JOIN st b ON b.scenario_id=a.scenario_id AND b.t=a.t AND a.agent_idx < b.agent_idx""")


def pair_ctes(tag: str, rel: str, universe: str) -> None:
    """Metrics of the pairs in `universe` (scenario_id, probed, i, j, type_i, type_j) from shared steps `rel`."""
    key = "scenario_id, probed, i, j"
    on = lambda a, b: " AND ".join(f"{a}.{c}={b}.{c}" for c in ("scenario_id", "probed", "i", "j"))
    cross = lambda o, p, q: (f"(({p[0]}-{o[0]})*({q[1]}-{o[1]})-({p[1]}-{o[1]})*({q[0]}-{o[0]}))")
    A, B, Cc, Dd = ("p.xi", "p.yi"), ("q.xi", "q.yi"), ("p.xj", "p.yj"), ("q.xj", "q.yj")
    sg = lambda o, p, q: f"sign(CASE WHEN abs({cross(o, p, q)}) < 0 THEN 0 ELSE {cross(o, p, q)} END)"

    def inbox(o, p, q):
        return (f"({q[0]} BETWEEN least({o[0]},{p[0]}) AND greatest({o[0]},{p[0]}) AND {q[1]} BETWEEN "
                f"least({o[1]},{p[1]}) AND greatest({o[1]},{p[1]}))")

    hit = (f"({sg(A, B, Cc)}<>{sg(A, B, Dd)} AND {sg(Cc, Dd, A)}<>{sg(Cc, Dd, B)})"
           f" OR ({sg(A, B, Cc)}=0 AND {inbox(A, B, Cc)}) OR ({sg(A, B, Dd)}=0 AND {inbox(A, B, Dd)})"
           f" OR ({sg(Cc, Dd, A)}=0 AND {inbox(Cc, Dd, A)}) OR ({sg(Cc, Dd, B)}=0 AND {inbox(Cc, Dd, B)})")
    cte(f"{tag}_seg", f"SELECT q.scenario_id, q.probed, q.i, q.j, q.pt, {hit} AS hit FROM {rel} p JOIN {rel} q "
                      f"ON {on('p', 'q')} AND p.pt=q.pt-1")
    cte(f"{tag}_step", f"""
WITH s AS (SELECT r.*, sqrt((xi-xj)**2+(yi-yj)**2) AS sep, abs(mod(mod(hj-hi+540,360)+360,360)-180) <= 45 AS al,
  abs(mod(mod(degrees(atan2(yj-yi,xj-xi))-hi+540,360)+360,360)-180) > 90 AS lead_i FROM {rel} r),
g AS (SELECT *, sep - CASE WHEN lead_i THEN li ELSE lj END AS gap, CASE WHEN lead_i THEN vj ELSE vi END AS fv,
  CASE WHEN lead_i THEN vj-vi ELSE vi-vj END AS dv FROM s)
SELECT g.*, CASE WHEN h.hit THEN 1e0 ELSE 0e0 END AS hit, CASE WHEN h.hit OR sep <= 5e-1 THEN 1e0 ELSE 0e0 END AS crash,
 abs(gap/(fv+1e-6)) AS thw, CASE WHEN dv > 0 THEN abs(gap/(dv+1e-6)) ELSE CAST('Infinity' AS DOUBLE) END AS ttc,
 CASE WHEN dv > 0 THEN least(dv*dv/(2*abs(gap)+1e-6),2e1) ELSE 0e0 END AS drac
FROM g LEFT JOIN {tag}_seg h ON {on('h', 'g')} AND h.pt=greatest(g.pt,1)""")
    cte(f"{tag}_cp", f"""
WITH d AS (SELECT a.scenario_id, a.probed, a.i, a.j, a.pt AS ti, b.pt AS s, a.xi AS cx, a.yi AS cy,
  sqrt((a.xi-b.xj)**2+(a.yi-b.yj)**2) AS d FROM {rel} a JOIN {rel} b ON {on('a', 'b')})
SELECT *, s AS tj FROM d WHERE d <= 10 QUALIFY row_number() OVER (PARTITION BY {key}, ti ORDER BY d, s)=1""")
    cte(f"{tag}_ct", f"""
SELECT c.scenario_id, c.probed, c.i, c.j, c.ti, min(abs(sqrt((q.xi-cx)**2+(q.yi-cy)**2)/q.vi
 - sqrt((q.xj-cx)**2+(q.yj-cy)**2)/q.vj)) AS m FROM {tag}_cp c JOIN {rel} q ON {on('c', 'q')} AND q.pt <= least(c.ti,c.tj)
GROUP BY ALL""")
    for crit, lo, hi, tally in (("critical", "min", "max", "sum"), ("average", "avg", "avg", "avg")):
        cte(f"{tag}_{crit}", f"""
WITH a AS (SELECT {key}, count(*) AS n, min(sep) AS ms, avg(vi) AS mi, avg(vj) AS mj, count(*) FILTER (al) AS na,
  {lo}(sep) AS separation, {tally}(hit) AS intersection, {tally}(crash) AS collision, {lo}(thw) FILTER (al) AS thw,
  {lo}(ttc) FILTER (al) AS ttc, {hi}(drac) FILTER (al) AS drac FROM {tag}_step GROUP BY ALL),
m AS (SELECT {key}, {lo}(m) AS mttcp FROM {tag}_ct GROUP BY ALL),
s AS (SELECT u.*, coalesce(a.n,0) AS n_shared, a.ms, separation, intersection, collision, thw, ttc, drac,
  coalesce(m.mttcp, CAST('Infinity' AS DOUBLE)) AS mttcp,
  CASE WHEN u.prefilter AND ((u.type_i=4 AND u.type_j=4) OR a.ms IS NULL OR a.ms > 100) THEN 3 WHEN coalesce(a.n,0) < 2 THEN 2
   WHEN a.ms > 100 THEN 3 WHEN mi < 2 AND mj < 2 THEN 4 WHEN na < 2 THEN 1 ELSE 0 END AS status
  FROM {universe} u LEFT JOIN a ON {on('a', 'u')} LEFT JOIN m ON {on('m', 'u')}),
v AS (SELECT {key}, type_i, type_j, status, n_shared, CASE WHEN status<2 THEN separation END AS separation,
  CASE WHEN status<2 THEN intersection END AS intersection, CASE WHEN status<2 THEN collision END AS collision,
  CASE WHEN status<2 THEN mttcp END AS mttcp,
  CASE status WHEN 0 THEN thw WHEN 1 THEN CAST('Infinity' AS DOUBLE) END AS thw,
  CASE status WHEN 0 THEN ttc WHEN 1 THEN CAST('Infinity' AS DOUBLE) END AS ttc,
  CASE status WHEN 0 THEN drac WHEN 1 THEN 0e0 END AS drac FROM s)
SELECT *, CASE WHEN status<2 THEN least(1/(mttcp+1e-6),1e1) END AS inv_mttcp,
 CASE WHEN status<2 THEN least(1/(thw+1e-6),1e1) END AS inv_thw, CASE WHEN status<2 THEN least(1/(ttc+1e-6),1e1) END AS inv_ttc
FROM v""")


cte("u_all", "SELECT scenario_id, -1 AS probed, i, j, type_i, type_j, ego_idx, true AS prefilter FROM ap")
cte("u_list", "SELECT scenario_id, -1 AS probed, i, j, type_i, type_j, ego_idx, false AS prefilter FROM ap WHERE j = i + 1")
pair_ctes("pa", "pp", "u_all")
pair_ctes("pl", "pp", "u_list")
cte("pe", "SELECT p.* FROM pa_critical p JOIN scen s ON s.scenario_id=p.scenario_id AND s.ego_idx IN (p.i,p.j)")
PF = ("separation", "intersection", "collision", "inv_mttcp", "inv_thw", "inv_ttc", "drac")
PF4 = ("mttcp", "thw", "ttc")


def pair_out(rel: str, where: str = "") -> str:
    return f"SELECT scenario_id, i, j, status, n_shared, {rs(*PF)}, {rs(*PF4, digits=4)} FROM {rel} {where}"


oracle("P20_pair_features_ego", pair_out("pe"))
oracle("P20_pair_features_all", pair_out("pa_critical", "WHERE status <> 3"))
cte("pv", "SELECT p.* FROM pa_average p JOIN scen s ON s.scenario_id=p.scenario_id AND s.ego_idx IN (p.i,p.j)")
oracle("P16_pair_features_average", pair_out("pv"))
oracle("P19_explicit_pairs", pair_out("pl_critical"))
oracle("P06_status_all", """
SELECT scenario_id, CAST(CASE WHEN type_i IN (1,5) OR type_j IN (1,5) THEN status ELSE 5 END AS INTEGER) AS status,
 count(*) AS pairs FROM pa_critical GROUP BY ALL""")

# --- thresholds and categories ------------------------------------------------------------------------------------


def union_features(rel: str, names, type_expr: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT scenario_id, {type_expr} AS type, '{n}' AS feature, CAST({n} AS DOUBLE) AS value FROM {rel} {extra}" for n in names)


IND = ("speed", "speed_limit_diff", "acceleration", "deceleration", "jerk", "waiting_period", "kalman_difficulty")
cte("il", "SELECT * FROM (" + union_features(
    "ind", IND, "CASE agent_type WHEN 1 THEN 'VEHICLE' WHEN 2 THEN 'PEDESTRIAN' ELSE 'CYCLIST' END",
    "WHERE agent_type IN (1,2,3)") + """) WHERE NOT (feature='kalman_difficulty' AND value < 0)
 AND NOT (feature='speed_limit_diff' AND value IS NULL)""")
PN = "CASE " + ptype() + " " + " ".join(f"WHEN {int(p)} THEN '{p.name}'" for p in PairType) + " END"
PAIRF = ("separation", "intersection", "collision", "mttcp", "inv_mttcp", "thw", "inv_thw", "ttc", "inv_ttc", "drac")
for _t, _rel in (("ple", "pe"), ("pla", "pa_critical")):
    cte(_t, "SELECT scenario_id, type, feature, CASE WHEN isinf(value) THEN 1e6 ELSE value END AS value FROM ("
        + union_features(_rel, PAIRF, PN, "WHERE status < 2")
        + f" UNION ALL SELECT scenario_id, {PN}, 'inv_separation', 1/(separation+1e-6) FROM {_rel} WHERE status < 2)")


def threshold_sql(rel: str, keys: str, value: str = "value") -> str:
    pct = lambda p: f"round_even(quantile_cont({value},{p / 100}),2)"
    scan = lambda lo, hi: "[" + ",".join(
        pct(lo + 0.5 * n) for n in range(1, int((hi - lo) * 2) + 1)) + "]"
    return f"""
WITH q AS (SELECT {keys}, {pct(25)} AS a, {pct(75)} AS b, {pct(90)} AS c, {scan(75, 82.5)} AS bs, {scan(90, 95)} AS cs
 FROM {rel} WHERE {value} IS NOT NULL GROUP BY {keys}),
q2 AS (SELECT *, CASE WHEN b=a THEN coalesce((SELECT min(u) FROM (SELECT unnest(bs) AS u) WHERE u > a), b) ELSE b END AS b2 FROM q),
q3 AS (SELECT *, CASE WHEN c=b2 THEN coalesce((SELECT min(u) FROM (SELECT unnest(cs) AS u) WHERE u > b2), c) ELSE c END AS c2 FROM q2)
SELECT {keys}, 0 AS ord, 'LOW/MEDIUM' AS label, a AS value FROM q3 UNION ALL
SELECT {keys}, 1, 'MEDIUM/HIGH', b2 FROM q3 UNION ALL SELECT {keys}, 2, 'HIGH/CRITICAL', c2 FROM q3"""


cte("tl", "SELECT * FROM il UNION ALL SELECT * FROM ple")
cte("th", threshold_sql("tl", "type, feature"))
oracle("A03_category_thresholds", f"SELECT type, feature, ord, label, {r('value',digits=4)} FROM th")
oracle("S30_thresholds_file", f"SELECT type, feature, ord, label, {r('value',digits=4)} FROM th WHERE type IN ('VEHICLE','CYCLIST','PEDESTRIAN')")


def cat_of(value: str, type_expr: str, feature: str) -> str:
    """Correlated lookup; null where the group has no thresholds for the feature."""
    return (f"(SELECT CASE WHEN count(*)=0 THEN NULL ELSE 1e0 + count(*) FILTER (th.value < {value} OR isnan({value})) END "
            f"FROM th WHERE th.type={type_expr} AND th.feature='{feature}')")


TG = "CASE WHEN i.agent_type IN (1,5) THEN 'VEHICLE' WHEN i.agent_type=3 THEN 'CYCLIST' WHEN i.agent_type=2 THEN 'PEDESTRIAN' END"
_cols = []
for _n in IND:
    _v = f"i.{_n}"
    _e = f"CASE WHEN i.agent_type=4 THEN -1e0 ELSE {cat_of(_v, TG, _n)} END"
    if _n == "speed_limit_diff":
        _e = f"CASE WHEN i.{_n} IS NULL THEN NULL ELSE {_e} END"
    if _n == "jerk":
        _e = f"CASE WHEN i.{_n} IS NULL THEN 0e0 ELSE {_e} END"
    if _n == "kalman_difficulty":
        _e = f"CASE WHEN i.{_n} < 0 THEN 0e0 ELSE {_e} END"
    _cols.append(f"{_e} AS {_n}")
cte("ic", f"SELECT i.scenario_id, i.agent_idx, i.agent_type, i.trajectory_type, {', '.join(_cols)} FROM ind i")
oracle("F15_categorize_individual", f"SELECT scenario_id, agent_idx, {', '.join(IND)} FROM ic")
_pn = PN.replace("type_i", "i.type_i").replace("type_j", "i.type_j")
cte("pc", "SELECT i.scenario_id, i.i, i.j, i.status, " + ", ".join(
    f"CASE WHEN i.status < 2 THEN CASE WHEN {_pn}='OTHER' THEN -1e0 ELSE coalesce({cat_of('i.' + n, _pn, n)},-1e0) END END AS {n}"
    for n in PAIRF) + " FROM pe i")
oracle("P18_categorize_pairs", f"SELECT scenario_id, i, j, status, {', '.join(PAIRF)} FROM pc")

# --- scores -------------------------------------------------------------------------------------------------------

PIPE, PROBE = PRESETS["pipeline_default"], PRESETS["probe"]
cte("na", "SELECT scenario_id, count(*) AS n FROM agt GROUP BY 1")
REL = """CASE WHEN agent_idx=ego_idx THEN 1e0 WHEN difficulty=0 THEN 8e-1 WHEN difficulty=1 THEN 9e-1 WHEN difficulty=2 THEN 1e0
 ELSE 0e0 END"""
cte("ag", f"SELECT a.*, {REL} AS rel, na.n FROM agt a JOIN na ON na.scenario_id=a.scenario_id")


def ego_w(dist: str, root: bool, vru: float) -> str:
    d = f"sqrt({dist}+1e-6)" if root else f"({dist}+1e-6)"
    return f"least(1/{d},1/5e-1)*CASE WHEN a.agent_type IN (2,3) THEN {vru} ELSE 1 END"


for _t, _root, _vru in (("we", True, 2.0), ("wp", False, 1.0)):
    cte(_t, f"""
SELECT a.scenario_id, a.agent_idx, CASE WHEN a.n=1 THEN a.rel WHEN a.agent_idx=a.ego_idx THEN 1e0
 ELSE {ego_w('d.distance', _root, _vru)} END AS weight FROM ag a JOIN de d ON d.scenario_id=a.scenario_id AND d.agent_idx=a.agent_idx""")
oracle("W02_ego_weights", f"SELECT scenario_id, agent_idx, {r('weight')} FROM we")
oracle("W01_uniform_weights", "SELECT scenario_id, agent_idx, CASE WHEN n=1 THEN rel ELSE 1e0 END AS weight FROM ag")
oracle("W03_relevant_weights", f"""
WITH d AS (SELECT dd.*, g.rel FROM dd JOIN ag g ON g.scenario_id=dd.scenario_id AND g.agent_idx=dd.target_idx AND g.rel > 0),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY scenario_id, agent_idx ORDER BY distance, target_idx)=1)
SELECT a.scenario_id, a.agent_idx, {r(f"CASE WHEN a.n=1 THEN a.rel WHEN a.agent_idx=a.ego_idx OR b.rel IS NULL THEN 1e0 ELSE b.rel*{ego_w('b.distance', True, 2.0)} END",'weight')}
FROM ag a LEFT JOIN b ON b.scenario_id=a.scenario_id AND b.agent_idx=a.agent_idx""")


def ind_score(cfg) -> str:
    w, c = cfg.weights, cfg.caps
    s = f"CASE WHEN i.speed_limit_diff IS NULL OR isnan(i.speed_limit_diff) THEN 0 ELSE {w.speed_limit_diff}*least({c.speed_limit_diff},i.speed_limit_diff) END"
    for n in ("speed", "acceleration", "deceleration", "waiting_period"):
        s += f" + {getattr(w, n)}*least({getattr(c, n)}::DOUBLE,coalesce(i.{n},{getattr(c, n)}))"
    s += f" + {w.jerk}*least({c.jerk}::DOUBLE,coalesce(i.jerk,{c.jerk}))"
    s += f" + {w.kalman_difficulty}*least({c.kalman_difficulty}::DOUBLE,coalesce(greatest(i.kalman_difficulty,0e0),{c.kalman_difficulty}))"
    shape = " ".join(f"WHEN {int(k)} THEN {v}" for k, v in TRACK_SHAPE_WEIGHTS.items())
    return s + f" + {w.trajectory_type}*CASE i.trajectory_type {shape} END"


def pair_score(cfg, p="p") -> str:
    w, c = cfg.weights, cfg.caps
    s = f"{w.collision}*least({c.collision}::DOUBLE,{p}.collision) + {w.drac}*least({c.drac}::DOUBLE,{p}.drac)"
    for m in ("mttcp", "thw", "ttc"):
        s += f" + {getattr(w, m)}*least(1/({getattr(c, m)}+1e-6),{p}.inv_{m})"
    return s


def agent_score_ctes(tag: str, ind: str, pairs: str, weights: str, cfg) -> None:
    cte(f"{tag}_a", f"""
SELECT w.scenario_id, w.agent_idx, coalesce(w.weight*({ind_score(cfg)}),0) AS score, i.agent_idx IS NOT NULL AS valid
FROM {weights} w LEFT JOIN {ind} i ON i.scenario_id=w.scenario_id AND i.agent_idx=w.agent_idx""")
    cte(f"{tag}_b", f"""
WITH p AS (SELECT p.*, {pair_score(cfg)} AS ps FROM {pairs} p WHERE p.status < 2),
e AS (SELECT scenario_id, i AS agent_idx, ps FROM p UNION ALL SELECT scenario_id, j, ps FROM p),
s AS (SELECT scenario_id, agent_idx, sum(ps) AS ps FROM e GROUP BY ALL)
SELECT w.scenario_id, w.agent_idx, coalesce(w.weight*s.ps,0) AS score, s.ps IS NOT NULL AS valid FROM {weights} w
LEFT JOIN s ON s.scenario_id=w.scenario_id AND s.agent_idx=w.agent_idx
WHERE w.scenario_id IN (SELECT scenario_id FROM {weights} GROUP BY 1 HAVING count(*) > 1)""")
    cte(f"{tag}_c", f"""
SELECT a.scenario_id, a.agent_idx, a.score+coalesce(b.score,0) AS score,
 CASE WHEN b.valid IS NOT NULL THEN a.valid OR b.valid END AS valid FROM {tag}_a a LEFT JOIN {tag}_b b
 ON b.scenario_id=a.scenario_id AND b.agent_idx=a.agent_idx""")


agent_score_ctes("sc", "ind", "pe", "we", PIPE)
for _n, _t in (("W06_individual_scores", "sc_a"), ("W08_interaction_scores", "sc_b"), ("W09_combined_scores", "sc_c")):
    oracle(_n, f"SELECT scenario_id, agent_idx, {r('score')}, valid FROM {_t}")
cte("wu", "SELECT scenario_id, agent_idx, CASE WHEN n=1 THEN rel ELSE 1e0 END AS weight FROM ag")
agent_score_ctes("su", "ind", "pa_critical", "wu", PIPE)
oracle("W08_interaction_scores_uniform", f"SELECT scenario_id, agent_idx, {r('score')}, valid FROM su_b")
cte("asc_", """
SELECT *, 'individual' AS scorer FROM sc_a UNION ALL
SELECT a.scenario_id, a.agent_idx, b.score, b.valid, 'interaction' FROM sc_a a LEFT JOIN sc_b b ON b.scenario_id=a.scenario_id
 AND b.agent_idx=a.agent_idx UNION ALL SELECT *, 'combined' FROM sc_c""")
cte("ssc", """
WITH s AS (SELECT scenario_id, scorer, CASE WHEN count(score) > 0 THEN
  least(greatest(sum(score)/greatest(count(*) FILTER (valid),1),0),200) END AS v FROM asc_ WHERE scorer <> 'combined' GROUP BY ALL)
SELECT scenario_id, scorer, v AS scene_score FROM s UNION ALL
SELECT scenario_id, 'combined', least(greatest(0.5e0*sum(v),0),200) FROM s GROUP BY scenario_id""")
cte("full_", "SELECT scenario_id FROM ssc GROUP BY 1 HAVING count(scene_score) = 3")
oracle("W09_scene_scores", f"SELECT scenario_id, scorer, {r('scene_score')} FROM ssc")
oracle("W10_score_category", """
SELECT scenario_id, agent_idx, scorer, CASE WHEN score IS NULL THEN NULL WHEN score <= 2 THEN 1e0 WHEN score <= 5 THEN 2e0 WHEN score <= 9 THEN 3e0
 ELSE 4e0 END AS category FROM asc_""")


def scene_from_pairs(pairs: str, weights: str, key: str) -> str:
    ks = key.split(", ")
    on = " AND ".join(f"w.{k}=e.{k}" for k in [*ks, "agent_idx"])
    return f"""
WITH e0 AS (SELECT {key}, i AS agent_idx, ps FROM {pairs} UNION ALL SELECT {key}, j, ps FROM {pairs}),
e AS (SELECT {key}, agent_idx, sum(ps) AS ps FROM e0 GROUP BY ALL)
SELECT {', '.join('w.' + k for k in ks)}, least(greatest(coalesce(sum(w.weight*e.ps),0)/greatest(count(e.ps),1),0),200) AS scene_score
FROM {weights} w LEFT JOIN e ON {on} GROUP BY {', '.join('w.' + k for k in ks)}"""


cte("psa", f"SELECT p.scenario_id, p.i, p.j, {pair_score(PROBE)} AS ps FROM pa_critical p WHERE p.status < 2")
cte("psa_s", scene_from_pairs("psa", "we", "scenario_id"))
oracle("W11_scene_score_from_pairs", f"SELECT scenario_id, {r('scene_score')} FROM psa_s")
oracle("W12_missing_features", "SELECT scenario_id FROM scen WHERE scenario_id NOT IN (SELECT scenario_id FROM ind)")
oracle("S32_score_mapping", """
SELECT scenario_id, round(max(scene_score) FILTER (scorer='individual'),3) AS individual,
 round(max(scene_score) FILTER (scorer='interaction'),3) AS interaction,
 round(max(scene_score) FILTER (scorer='combined'),3) AS combined FROM ssc GROUP BY 1""")

# --- probes -------------------------------------------------------------------------------------------------------

cte("ref", """
SELECT v.*, s.now, s.n_steps FROM vp v JOIN scen s ON s.scenario_id=v.scenario_id WHERE v.t <= s.now
QUALIFY row_number() OVER (PARTITION BY v.scenario_id, v.agent_idx ORDER BY v.t DESC)=1""")
cte("mov", "SELECT * FROM ref WHERE abs(vx) >= 1e-4 OR abs(vy) >= 1e-4")
cte("alt", """
SELECT p.scenario_id, p.agent_idx, p.t, p.x, p.y, p.vx, p.vy, p.length, p.heading, p.valid FROM pts p JOIN mov m
 ON m.scenario_id=p.scenario_id AND m.agent_idx=p.agent_idx AND p.t <= m.now
UNION ALL
SELECT m.scenario_id, m.agent_idx, CAST(g.t AS INTEGER), m.x+(g.t-m.t)/1e1*m.vx, m.y+(g.t-m.t)/1e1*m.vy, m.vx, m.vy,
 coalesce(p.length,0e0), m.heading, true FROM mov m JOIN (SELECT unnest(range(0,40)) AS t) g ON g.t > m.now AND g.t < m.n_steps
LEFT JOIN pts p ON p.scenario_id=m.scenario_id AND p.agent_idx=m.agent_idx AND p.t=g.t""")
oracle("C01_constant_velocity", f"SELECT scenario_id, agent_idx, t, {rs('x','y','vx','vy','length')}, valid FROM alt")
oracle("C02_baseline_pair_scores", f"""
SELECT p.scenario_id, p.i, p.j, {r(pair_score(PROBE),'pair_score')} FROM pe p WHERE p.status < 2 AND p.type_i<>4 AND p.type_j<>4""")
cte("prp", """
SELECT s.scenario_id, m.agent_idx AS probed, CASE WHEN m.agent_idx=s.ego_idx THEN a.agent_idx ELSE s.ego_idx END AS other
FROM scen s JOIN mov m ON m.scenario_id=s.scenario_id JOIN agt a ON a.scenario_id=s.scenario_id AND a.agent_idx<>m.agent_idx
WHERE m.agent_idx=s.ego_idx OR a.agent_idx=s.ego_idx""")
oracle("C03_probe_pairs", "SELECT scenario_id, probed, least(probed,other) AS i, greatest(probed,other) AS j FROM prp")
cte("ast", "SELECT scenario_id, agent_idx, t, x, y, sqrt(vx*vx+vy*vy)+1e-6 AS v, degrees(heading) AS h, length AS len FROM alt WHERE valid")
cte("rp", """
SELECT r.scenario_id, r.probed, least(r.probed,r.other) AS i, greatest(r.probed,r.other) AS j, a.t,
 row_number() OVER (PARTITION BY r.scenario_id, r.probed, r.other ORDER BY a.t) - 1 AS pt,
 CASE WHEN r.probed<r.other THEN a.x ELSE b.x END AS xi, CASE WHEN r.probed<r.other THEN a.y ELSE b.y END AS yi,
 CASE WHEN r.probed<r.other THEN a.v ELSE b.v END AS vi, CASE WHEN r.probed<r.other THEN a.h ELSE b.h END AS hi,
 CASE WHEN r.probed<r.other THEN a.len ELSE b.len END AS li, CASE WHEN r.probed<r.other THEN b.x ELSE a.x END AS xj,
 CASE WHEN r.probed<r.other THEN b.y ELSE a.y END AS yj, CASE WHEN r.probed<r.other THEN b.v ELSE a.v END AS vj,
 CASE WHEN r.probed<r.other THEN b.h ELSE a.h END AS hj, CASE WHEN r.probed<r.other THEN b.len ELSE a.len END AS lj
FROM prp r JOIN ast a ON a.scenario_id=r.scenario_id AND a.agent_idx=r.probed
JOIN st b ON b.scenario_id=r.scenario_id AND b.agent_idx=r.other AND b.t=a.t""")
cte("u_pr", """
SELECT r.scenario_id, r.probed, r.other, least(r.probed,r.other) AS i, greatest(r.probed,r.other) AS j, 1 AS type_i, 1 AS type_j,
 false AS prefilter FROM prp r""")
pair_ctes("pr", "rp", "u_pr")
cte("psb", f"SELECT p.scenario_id, p.i, p.j, {pair_score(PROBE)} AS ps FROM pe p WHERE p.status < 2")
cte("dl", f"""
SELECT p.scenario_id, p.probed, CASE WHEN p.i=p.probed THEN p.j ELSE p.i END AS other, p.i, p.j, {pair_score(PROBE)} AS pair_score,
 coalesce(b.ps,0) AS before, {pair_score(PROBE)} - coalesce(b.ps,0) AS delta FROM pr_critical p
LEFT JOIN psb b ON b.scenario_id=p.scenario_id AND b.i=p.i AND b.j=p.j WHERE p.status < 2""")
oracle("C05_probe_deltas", f"SELECT scenario_id, probed, other, {rs('pair_score','before','delta')} FROM dl")
cte("win", """
SELECT * FROM (SELECT scenario_id, probed, max(delta) AS delta FROM dl GROUP BY scenario_id, probed)
WHERE delta >= 1 QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY delta DESC, probed DESC)=1""")
settle("win")
oracle("C06_winning_probe", settled(f"SELECT scenario_id, probed, {r('delta')} FROM win"))
cte("crf", """
WITH f AS (SELECT r.scenario_id, r.probed, r.other, a.t, sqrt((a.x-b.x)**2+(a.y-b.y)**2) AS sep, a.v AS va, b.v AS vb, a.len AS la,
  b.len AS lb, abs(mod(mod(b.h-a.h+540,360)+360,360)-180) <= 45 AS al,
  abs(mod(mod(degrees(atan2(b.y-a.y,b.x-a.x))-a.h+540,360)+360,360)-180) > 90 AS lead
  FROM prp r JOIN scen s ON s.scenario_id=r.scenario_id JOIN ast a ON a.scenario_id=r.scenario_id AND a.agent_idx=r.probed AND a.t >= s.now
  JOIN st b ON b.scenario_id=r.scenario_id AND b.agent_idx=r.other AND b.t=a.t),
g AS (SELECT *, sep - CASE WHEN lead THEN la ELSE lb END AS gap, CASE WHEN lead THEN vb-va ELSE va-vb END AS dv FROM f),
h AS (SELECT *, CASE WHEN dv>0 THEN abs(gap/(dv+1e-6)) END AS ttc, CASE WHEN dv>0 THEN least(dv*dv/(2*abs(gap)+1e-6),20) END AS drac FROM g),
ok AS (SELECT scenario_id, probed, other FROM h GROUP BY ALL HAVING count(*)>=2 AND min(sep)<=100 AND count(*) FILTER (al)>=2),
x AS (SELECT h.*, row_number() OVER (PARTITION BY scenario_id,probed,other ORDER BY ttc NULLS LAST, t) AS rt,
  row_number() OVER (PARTITION BY scenario_id,probed,other ORDER BY drac DESC NULLS LAST, t) AS rd FROM h WHERE al)
SELECT o.scenario_id, o.probed, o.other, CASE WHEN a.ttc IS NOT NULL THEN 'TTC' WHEN b.drac > 0 THEN 'DRAC' END AS metric,
 CASE WHEN a.ttc IS NOT NULL THEN a.t WHEN b.drac > 0 THEN b.t END AS frame FROM ok o
JOIN x a ON a.scenario_id=o.scenario_id AND a.probed=o.probed AND a.other=o.other AND a.rt=1
JOIN x b ON b.scenario_id=o.scenario_id AND b.probed=o.probed AND b.other=o.other AND b.rd=1""")
cte("aff", """
SELECT d.scenario_id, d.probed, d.other, c.metric, c.frame FROM dl d JOIN win w ON w.scenario_id=d.scenario_id AND w.probed=d.probed
JOIN crf c ON c.scenario_id=d.scenario_id AND c.probed=d.probed AND c.other=d.other AND c.metric IS NOT NULL WHERE d.delta >= 1
QUALIFY row_number() OVER (PARTITION BY d.scenario_id ORDER BY c.metric DESC, c.frame, d.other)=1""")
cte("mrg", """
SELECT w.scenario_id, w.probed, p.i, p.j, coalesce(d.pair_score, p.ps) AS ps FROM win w JOIN psb p ON p.scenario_id=w.scenario_id
LEFT JOIN dl d ON d.scenario_id=w.scenario_id AND d.probed=w.probed AND d.i=p.i AND d.j=p.j
UNION ALL SELECT d.scenario_id, d.probed, d.i, d.j, d.pair_score FROM dl d JOIN win w ON w.scenario_id=d.scenario_id AND w.probed=d.probed
WHERE NOT EXISTS (SELECT 1 FROM psb p WHERE p.scenario_id=d.scenario_id AND p.i=d.i AND p.j=d.j)""")
cte("dn", """
WITH z AS (SELECT w.scenario_id, w.probed, n.agent_idx, n.t, coalesce(a.x,n.x) AS x, coalesce(a.y,n.y) AS y FROM win w
 JOIN den n ON n.scenario_id=w.scenario_id LEFT JOIN alt a ON a.scenario_id=n.scenario_id AND a.agent_idx=n.agent_idx
 AND a.t=n.t AND a.agent_idx=w.probed)
SELECT z.scenario_id, z.probed, z.agent_idx, min(sqrt((z.x-e.x)**2+(z.y-e.y)**2)) AS distance FROM z JOIN scen s
 ON s.scenario_id=z.scenario_id JOIN z e ON e.scenario_id=z.scenario_id AND e.t=z.t AND e.agent_idx=s.ego_idx GROUP BY ALL""")
cte("wa", f"""
SELECT d.scenario_id, d.probed, d.agent_idx, CASE WHEN a.n=1 THEN a.rel WHEN a.agent_idx=a.ego_idx THEN 1e0
 ELSE {ego_w('d.distance', False, 1.0)} END AS weight FROM dn d JOIN ag a ON a.scenario_id=d.scenario_id AND a.agent_idx=d.agent_idx""")
cte("after_", scene_from_pairs("mrg", "wa", "scenario_id, probed"))
cte("before_", scene_from_pairs("psb", "wp", "scenario_id"))
cte("probe_", """
SELECT f.scenario_id, f.probed AS probed_agent, f.probed=s.ego_idx AS is_ego, b.scene_score AS score_before, a.scene_score AS
 score_after, f.other AS affected_agent, f.metric, f.frame FROM aff f JOIN scen s ON s.scenario_id=f.scenario_id
JOIN after_ a ON a.scenario_id=f.scenario_id AND a.probed=f.probed JOIN before_ b ON b.scenario_id=f.scenario_id""")
settle("crf", "aff", "mrg", "dn", "wa", "after_", "probe_")
oracle("C08_probes", settled(f"SELECT scenario_id, probed_agent, is_ego, {rs('score_before','score_after')}, affected_agent, metric, frame FROM probe_"))
cte("sum_", """
SELECT CAST(s.scenario_id AS VARCHAR) AS scenario_id, s.dataset, p.probed_agent IS NOT NULL AS found, p.is_ego, p.probed_agent,
 round(p.score_before,6) AS score_before, round(p.score_after,6) AS score_after, round(p.score_after-p.score_before,6) AS score_delta,
 p.affected_agent FROM scen s LEFT JOIN probe_ p ON p.scenario_id=s.scenario_id""")
settle("sum_")
oracle("C11_probe_summary", settled("""
SELECT scenario_id, CASE WHEN found THEN 'yes' ELSE 'no' END AS probe_found, CASE WHEN found THEN 'CONSTANT_VELOCITY' ELSE 'N/A' END
 AS probe_type, CASE WHEN NOT found THEN 'N/A' WHEN is_ego THEN 'yes' ELSE 'no' END AS is_ego_agent,
 coalesce((SELECT CAST(any_value(agent_id) AS VARCHAR) FROM agt a WHERE CAST(a.scenario_id AS VARCHAR)=s.scenario_id AND a.agent_idx=s.probed_agent),'') AS probed_agent_id,
 coalesce((SELECT CAST(any_value(agent_id) AS VARCHAR) FROM agt a WHERE CAST(a.scenario_id AS VARCHAR)=s.scenario_id AND a.agent_idx=s.affected_agent),'') AS affected_agent_ids,
 CASE WHEN found THEN printf('%.6f', score_before) ELSE '' END AS score_before, CASE WHEN found THEN printf('%.6f', score_after) ELSE '' END AS score_after,
 CASE WHEN found THEN printf('%.6f', score_delta) ELSE '' END AS score_delta FROM sum_ s"""))
oracle("S27_upsert", f"""
WITH o AS (SELECT scenario_id, agent_idx, speed, jerk FROM ind),
n AS (SELECT scenario_id, agent_idx, score AS speed FROM asc_ WHERE scorer='interaction'),
u AS (SELECT DISTINCT scenario_id, agent_idx FROM (SELECT scenario_id, agent_idx FROM o UNION ALL SELECT scenario_id, agent_idx FROM n))
SELECT m.mode, u.scenario_id, u.agent_idx, {r("CASE WHEN m.mode='add' THEN coalesce(o.speed,n.speed) ELSE coalesce(n.speed,o.speed) END",'speed')},
 {r('o.jerk','jerk')}
FROM u JOIN (SELECT unnest(['add','update']) AS mode) m ON true
LEFT JOIN o ON o.scenario_id=u.scenario_id AND o.agent_idx=u.agent_idx
LEFT JOIN n ON n.scenario_id=u.scenario_id AND n.agent_idx=u.agent_idx
UNION ALL SELECT 'overwrite', scenario_id, agent_idx, {r('speed')}, NULL FROM n""")
oracle("S28_pending", "SELECT scenario_id FROM scen WHERE scenario_id NOT IN (SELECT scenario_id FROM pe)")
oracle("S29_common_ids", """
SELECT DISTINCT i.scenario_id FROM ind i JOIN pe p ON p.scenario_id=i.scenario_id JOIN sum_ s ON s.scenario_id=CAST(i.scenario_id AS VARCHAR)""")

# --- profiles -----------------------------------------------------------------------------------------------------

oracle("A01_individual_by_type", f"SELECT type, feature, count(value) AS n, {r('avg(value)','mean')} FROM il GROUP BY ALL")
oracle("A02_pairs_by_type", f"SELECT type, feature, count(value) AS n, {r('min(value)','low',4)}, {r('max(value)','high',4)} FROM pla GROUP BY ALL")
oracle("A04_histogram", f"""
WITH v AS (SELECT * FROM il WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT type, feature, CASE WHEN min(value)=max(value) THEN min(value)-5e-1 ELSE min(value) END AS a,
 CASE WHEN min(value)=max(value) THEN max(value)+5e-1 ELSE max(value) END AS b, count(*) AS n FROM v GROUP BY ALL),
g AS (SELECT s.*, CAST(k AS INTEGER) AS bin, (b-a)/20 AS w FROM s, (SELECT unnest(range(0,20)) AS k))
SELECT g.type, g.feature, g.bin, count(v.value) AS count, {r('count(v.value)/(g.n*g.w)','density',4)} FROM g LEFT JOIN v
 ON v.type=g.type AND v.feature=g.feature AND least(greatest(floor((v.value-g.a)/g.w),0),19)=g.bin GROUP BY g.type, g.feature, g.bin, g.n, g.w""")
cte("asv", "SELECT scorer, score FROM asc_ WHERE valid AND score >= 0 AND scenario_id IN (SELECT scenario_id FROM full_)")
cte("sth", threshold_sql("asv", "scorer", "score"))
oracle("A05_score_thresholds", f"SELECT scorer, ord, label, {r('value',digits=4)} FROM sth")
oracle("A06_complete_scenes", """
SELECT scenario_id, count(scene_score) = 3 AS complete FROM ssc GROUP BY 1""")
cte("sp", """
WITH s AS (SELECT scorer AS key, scenario_id, round(scene_score,3) AS v FROM ssc WHERE scenario_id IN (SELECT scenario_id FROM full_)), q AS (SELECT key, quantile_cont(v,0.8) AS c FROM s GROUP BY 1)
SELECT s.key, s.scenario_id, s.v AS scene_score, s.v >= q.c AS out_of_distribution FROM s JOIN q ON q.key=s.key""")
oracle("A07_scene_splits", "SELECT key, scenario_id, scene_score, out_of_distribution FROM sp")
oracle("A07_split_sizes", """
SELECT key, count(*) FILTER (NOT out_of_distribution) AS num_in_distribution, count(*) FILTER (out_of_distribution) AS
 num_out_of_distribution FROM sp GROUP BY 1""")
oracle("A08_jaccard", f"""
WITH o AS (SELECT key, scenario_id FROM sp WHERE out_of_distribution),
p AS (SELECT * FROM (VALUES ('individual','interaction'),('individual','combined'),('interaction','combined')) t(a,b))
SELECT p.a, p.b, {r('(SELECT count(*) FROM (SELECT scenario_id FROM o WHERE key=p.a INTERSECT SELECT scenario_id FROM o WHERE key=p.b))/greatest((SELECT count(*) FROM (SELECT scenario_id FROM o WHERE key=p.a UNION SELECT scenario_id FROM o WHERE key=p.b)),1)','jaccard')} FROM p""")
cte("wd", """
SELECT a.scenario_id, a.agent_idx, CAST(trunc(a.score) AS INTEGER) AS individual, CAST(trunc(b.score) AS INTEGER) AS interaction,
 CAST(trunc(c.score) AS INTEGER) AS combined FROM sc_a a JOIN sc_b b ON b.scenario_id=a.scenario_id AND b.agent_idx=a.agent_idx
JOIN sc_c c ON c.scenario_id=a.scenario_id AND c.agent_idx=a.agent_idx WHERE a.valid AND b.valid""")
oracle("A09_score_grid", "SELECT individual, interaction, count(*) AS agents FROM wd GROUP BY ALL")
oracle("A10_score_grid_by_type", """
SELECT a.agent_type, individual, interaction, combined, count(*) AS agents FROM wd JOIN agt a ON a.scenario_id=wd.scenario_id
 AND a.agent_idx=wd.agent_idx GROUP BY ALL""")

cte("dsv", "SELECT scenario_id, dataset FROM scen UNION ALL SELECT scenario_id, 'all' FROM scen")
cte("spd", """
WITH s AS (SELECT dataset, scorer AS key, x.scenario_id, round(scene_score,3) AS v FROM ssc x JOIN dsv y ON y.scenario_id=x.scenario_id
 WHERE x.scenario_id IN (SELECT scenario_id FROM full_)), q AS (SELECT dataset, key, quantile_cont(v,0.8) AS c FROM s GROUP BY ALL)
SELECT s.dataset, s.key, s.scenario_id, s.v AS scene_score, s.v >= q.c AS out_of_distribution FROM s JOIN q ON q.key=s.key AND q.dataset=s.dataset""")
oracle("S35_splits_per_dataset", "SELECT * FROM spd")
oracle("S35_jaccard_per_dataset", f"""
WITH f AS (SELECT dataset, scenario_id, bool_or(out_of_distribution AND key='individual') AS i, bool_or(out_of_distribution AND key='interaction') AS n,
 bool_or(out_of_distribution AND key='combined') AS c FROM spd GROUP BY ALL),
p AS (SELECT dataset, 'individual' AS a, 'interaction' AS b, count(*) FILTER (i AND n) AS x, count(*) FILTER (i OR n) AS y FROM f GROUP BY 1
 UNION ALL SELECT dataset, 'individual', 'combined', count(*) FILTER (i AND c), count(*) FILTER (i OR c) FROM f GROUP BY 1
 UNION ALL SELECT dataset, 'interaction', 'combined', count(*) FILTER (n AND c), count(*) FILTER (n OR c) FROM f GROUP BY 1)
SELECT dataset, a, b, {r('x/greatest(y,1)','jaccard')} FROM p""")
cte("asd", "SELECT dataset, scorer, score FROM asc_ x JOIN dsv y ON y.scenario_id=x.scenario_id WHERE valid AND score >= 0 AND x.scenario_id IN (SELECT scenario_id FROM full_)")
cte("std", threshold_sql("asd", "dataset, scorer", "score"))
oracle("S35_score_thresholds_per_dataset", f"SELECT dataset, scorer, ord, label, {r('value',digits=4)} FROM std")
oracle("S35_score_grid_per_dataset", "SELECT dataset, individual, interaction, count(*) AS agents FROM wd JOIN dsv y ON y.scenario_id=wd.scenario_id GROUP BY ALL")


def count_cte(name: str, pairs: str) -> list[str]:
    cols = [f"(SELECT count(*) FROM {pairs} p WHERE p.scenario_id=s.scenario_id AND 5 IN (p.type_i,p.type_j)) AS pairs_with_ego_total",
            f"(SELECT count(*) FROM {pairs} p WHERE p.scenario_id=s.scenario_id AND 5 IN (p.type_i,p.type_j) AND p.status<2) AS pairs_with_ego_valid"]
    for a in AgentType:
        cols += [f"(SELECT count(*) FROM agt a WHERE a.scenario_id=s.scenario_id AND a.agent_type={int(a)}) AS agents_total_{a.name}",
                 f"(SELECT count(*) FROM ind a WHERE a.scenario_id=s.scenario_id AND a.agent_type={int(a)}) AS agents_valid_{a.name}"]
    for p in PairType:
        for what, cond in (("total", ""), ("valid", " AND p.status<2")):
            cols.append(f"(SELECT count(*) FROM {pairs} p WHERE p.scenario_id=s.scenario_id AND {ptype('p.type_i', 'p.type_j')}={int(p)}{cond})"
                        f" AS pairs_{what}_{p.name}")
    cte(name, f"SELECT s.scenario_id, s.dataset, {', '.join(cols)} FROM scen s")
    return [c.rsplit(" AS ", 1)[1] for c in cols]


_counted = count_cte("cna", "pa_critical")
count_cte("cne", "pe")
oracle("A11_scenario_counts", "SELECT * FROM cna")
cte("dsc", "SELECT dataset, count(*) AS num_scenarios_counted, " + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _counted) + " FROM cne GROUP BY ROLLUP(dataset)")
oracle("A12_dataset_counts", "SELECT * FROM dsc")
oracle("A13_coverage", """
SELECT s.dataset, count(DISTINCT s.scenario_id) AS present, count(DISTINCT i.scenario_id) AS counted FROM scen s LEFT JOIN ind i
 ON i.scenario_id=s.scenario_id GROUP BY 1""")
cte("cl3", f"SELECT dataset, scenario_id, col, value FROM cne UNPIVOT (value FOR col IN ({', '.join(_counted)}))")
oracle("A14_interquartile_mean", f"""
WITH q AS (SELECT dataset, col, quantile_cont(value,0.25) AS a, quantile_cont(value,0.75) AS b FROM cl3 GROUP BY ALL)
SELECT c.dataset, c.col AS "column", {r('coalesce(avg(c.value) FILTER (c.value BETWEEN q.a AND q.b),0)','iqm')},
 CAST(sum(c.value) AS BIGINT) AS total FROM cl3 c JOIN q ON q.dataset=c.dataset AND q.col=c.col GROUP BY c.dataset, c.col""")
oracle("A15_ego_scoped", "SELECT bool_and(pairs_with_ego_valid = " + "+".join(f"pairs_valid_{p.name}" for p in PairType) + ") AS ego_scoped FROM dsc")
_vrp = [p.name for p in PairType if p not in (PairType.UNSET, PairType.OTHER)]
_whole = "(" + "+".join(f"pairs_valid_{n}" for n in _vrp) + ")"
oracle("A16_composition", " UNION ALL ".join(
    f"SELECT dataset, '{n}' AS type, {r(f'CASE WHEN {_whole} > 0 THEN 1e2*pairs_valid_{n}/{_whole} ELSE 0e0 END', 'share')} FROM dsc WHERE dataset IS NOT NULL"
    for n in _vrp))
oracle("A17_count_quartiles", f"""
SELECT dataset, col AS "column", {', '.join(r(f'quantile_cont(CAST(value AS DOUBLE),{p})', n, 4) for n, p in (('low',0),('q1',0.25),('median',0.5),('q3',0.75),('high',1)))}
FROM cl3 GROUP BY ALL""")
cte("probed_", """
SELECT s.*, CAST(a.agent_id AS VARCHAR) AS probed_agent_id, CAST(b.agent_id AS VARCHAR) AS affected_agent_ids FROM sum_ s
JOIN (SELECT DISTINCT scenario_id, agent_idx, agent_id FROM agt) a ON CAST(a.scenario_id AS VARCHAR)=s.scenario_id AND a.agent_idx=s.probed_agent
LEFT JOIN (SELECT DISTINCT scenario_id, agent_idx, agent_id FROM agt) b ON CAST(b.scenario_id AS VARCHAR)=s.scenario_id AND b.agent_idx=s.affected_agent WHERE found""")
_probed = f"""scenario_id, CASE WHEN is_ego THEN 'yes' ELSE 'no' END AS is_ego_agent, probed_agent_id, {rs('score_before','score_after','score_delta')}, affected_agent_ids,
 CASE WHEN affected_agent_ids IS NULL THEN 0 ELSE 1 END AS n_affected FROM probed_"""
settle("probed_")
oracle("A18_probed_rows", settled(f"SELECT 'yes' AS probe_found, 'CONSTANT_VELOCITY' AS probe_type, {_probed}"))
oracle("A19_probe_outcomes", settled(" UNION ALL ".join(
    f"SELECT dataset, '{n}' AS outcome, count(*) FILTER ({c}) AS scenes, {r(f'1e2*count(*) FILTER ({c})/count(*)', 'share')} FROM sum_ GROUP BY dataset"
    for n, c in (("no_probe", "NOT found"), ("ego", "found AND is_ego"), ("non_ego", "found AND NOT is_ego")))))
oracle("A20_probe_statistics", settled(f"""
SELECT count(*) AS total_scenarios, count(*) FILTER (found) AS n_probed, count(*) FILTER (NOT found) AS n_no_probe,
 {r('round(count(*) FILTER (found)/count(*),4)','probe_rate')}, count(*) FILTER (is_ego) AS n_ego_probe,
 count(*) FILTER (NOT is_ego) AS n_non_ego_probe, {r('avg(score_delta)','delta_mean',4)}, {r('stddev_samp(score_delta)','delta_std')},
 {r('quantile_cont(score_delta,0.5)','delta_median',4)}, {r('min(score_delta)','delta_min')}, {r('max(score_delta)','delta_max')} FROM sum_"""))
oracle("A21_top_probes", f"SELECT 'yes' AS probe_found, 'CONSTANT_VELOCITY' AS probe_type, {_probed} ORDER BY probed_.score_delta DESC, scenario_id LIMIT 5")
oracle("A22_delta_quartiles", f"""
SELECT CASE WHEN is_ego THEN 'yes' ELSE 'no' END AS is_ego_agent, {', '.join(r(f'quantile_cont(score_delta,{p})', n, 4) for n, p in (('low',0),('q1',0.25),('median',0.5),('q3',0.75),('high',1)))}
FROM sum_ WHERE found GROUP BY 1""")
oracle("A22_affected_counts", settled("SELECT CASE WHEN is_ego THEN 'yes' ELSE 'no' END AS is_ego_agent, 1 AS n_affected, count(*) AS scenes FROM sum_ WHERE found GROUP BY 1"))
oracle("A23_percentile_folders", """
WITH c AS (SELECT scenario_id, scene_score AS v FROM ssc WHERE scorer='combined'),
q AS (SELECT quantile_cont(v,0.1) AS a, quantile_cont(v,0.5) AS b, quantile_cont(v,0.8) AS d FROM c)
SELECT s.scenario_id, CASE WHEN c.v IS NULL THEN 'unknown' WHEN c.v < q.a THEN 'percentile_0-10' WHEN c.v < q.b THEN 'percentile_10-50'
 WHEN c.v < q.d THEN 'percentile_50-80' ELSE 'percentile_80-100' END AS folder FROM scen s LEFT JOIN c ON c.scenario_id=s.scenario_id, q""")
oracle("A24_normalized_scores", f"""
WITH c AS (SELECT a.*, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n FROM asc_ a WHERE scorer='combined'
 WINDOW w AS (PARTITION BY scenario_id))
SELECT c.scenario_id, c.agent_idx, {r('CASE WHEN c.agent_idx=s.ego_idx THEN 1e0 ELSE least(greatest(CASE WHEN hi>lo THEN (score-lo)/(hi-lo) ELSE 1e0/n END,5e-2),1e0) END','alpha')}
FROM c JOIN scen s ON s.scenario_id=c.scenario_id""")
oracle("A27_ego_path_ends", f"""
SELECT v.scenario_id, {', '.join(r(f'{f}(v.{c},v.t)', n) for f, c, n in (('arg_min','x','x0'),('arg_min','y','y0'),('arg_max','x','x1'),('arg_max','y','y1')))},
 {r('sqrt((arg_max(v.x,v.t)-arg_min(v.x,v.t))**2+(arg_max(v.y,v.t)-arg_min(v.y,v.t))**2)','displacement')}
FROM vp v JOIN scen s ON s.scenario_id=v.scenario_id AND s.ego_idx=v.agent_idx GROUP BY 1 HAVING count(*) >= 2""")
oracle("A28_score_bound", f"SELECT {r('coalesce(max(score_before)*1.02e0,1e0)','bound')} FROM sum_")
cte("sumd", "SELECT x.* EXCLUDE (dataset), y.dataset FROM sum_ x JOIN dsv y ON CAST(y.scenario_id AS VARCHAR)=x.scenario_id")
settle("sumd")
oracle("S35_probe_statistics_per_dataset", settled(f"""
SELECT dataset, count(*) AS total_scenarios, count(*) FILTER (found) AS n_probed, count(*) FILTER (NOT found) AS n_no_probe,
 {r('round(count(*) FILTER (found)/count(*),4)','probe_rate')}, count(*) FILTER (is_ego) AS n_ego_probe,
 count(*) FILTER (NOT is_ego) AS n_non_ego_probe, {r('avg(score_delta)','delta_mean',4)}, {r('stddev_samp(score_delta)','delta_std')},
 {r('quantile_cont(score_delta,0.5)','delta_median',4)}, {r('min(score_delta)','delta_min')}, {r('max(score_delta)','delta_max')} FROM sumd GROUP BY 1"""))
oracle("S35_delta_quartiles_per_dataset", f"""
SELECT dataset, CASE WHEN is_ego THEN 'yes' ELSE 'no' END AS is_ego_agent, {', '.join(r(f'quantile_cont(score_delta,{p})', n, 4) for n, p in (('low',0),('q1',0.25),('median',0.5),('q3',0.75),('high',1)))}
FROM sumd WHERE found GROUP BY 1, 2""")
oracle("S35_affected_counts_per_dataset", settled("SELECT dataset, CASE WHEN is_ego THEN 'yes' ELSE 'no' END AS is_ego_agent, 1 AS n_affected, count(*) AS scenes FROM sumd WHERE found GROUP BY 1, 2"))
oracle("S35_score_bound_per_dataset", f"SELECT dataset, {r('coalesce(max(score_before)*1.02e0,1e0)','bound')} FROM sumd WHERE found GROUP BY 1")
oracle("S35_folders_per_dataset", """
WITH c AS (SELECT y.scenario_id, y.dataset, x.scene_score AS v FROM dsv y LEFT JOIN ssc x ON x.scenario_id=y.scenario_id AND x.scorer='combined'),
q AS (SELECT dataset, quantile_cont(v,0.1) AS a, quantile_cont(v,0.5) AS b, quantile_cont(v,0.8) AS d FROM c GROUP BY 1)
SELECT c.scenario_id, c.dataset, CASE WHEN c.v IS NULL THEN 'unknown' WHEN c.v < q.a THEN 'percentile_0-10' WHEN c.v < q.b THEN 'percentile_10-50'
 WHEN c.v < q.d THEN 'percentile_50-80' ELSE 'percentile_80-100' END AS folder FROM c JOIN q ON q.dataset=c.dataset""")
cte("tld", "SELECT y.dataset, x.type, x.feature, x.value FROM tl x JOIN dsv y ON y.scenario_id=x.scenario_id")
cte("thd", threshold_sql("tld", "dataset, type, feature"))
oracle("S35_feature_thresholds_per_dataset", f"SELECT dataset, type, feature, ord, label, {r('value',digits=4)} FROM thd")
_named = """(SELECT DISTINCT scenario_id, agent_idx, agent_id FROM agt)"""
oracle("S31_probe_records", settled(f"""
SELECT p.scenario_id, CAST(a.agent_id AS BIGINT) AS probed_agent_id, p.is_ego AS is_ego_agent, 'CONSTANT_VELOCITY' AS probe_type, CAST(b.agent_id AS BIGINT) AS affected_agent_id,
 CAST(p.frame AS INT) AS frame, p.metric, {r('p.score_before','score_before')}, {r('p.score_after','score_after')},
 least(a.agent_id,b.agent_id) || ':' || greatest(a.agent_id,b.agent_id) AS pair, 1 AS n_pairs
FROM probe_ p JOIN {_named} a ON a.scenario_id=p.scenario_id AND a.agent_idx=p.probed_agent JOIN {_named} b ON b.scenario_id=p.scenario_id AND b.agent_idx=p.affected_agent"""))
oracle("S31_altered_points", settled(f"""
SELECT a.scenario_id, a.agent_idx, a.t, {', '.join(r('a.' + c, c) for c in ('x','y','vx','vy','length'))}, a.valid FROM alt a JOIN probe_ p ON p.scenario_id=a.scenario_id AND p.probed_agent=a.agent_idx"""))
oracle("P21_features", f"""
WITH m AS (SELECT scenario_id, agent_idx, count(*) AS pairs, count(*) FILTER (status < 2) AS valid_pairs FROM
 (SELECT scenario_id, i AS agent_idx, status FROM pe UNION ALL SELECT scenario_id, j, status FROM pe) GROUP BY ALL)
SELECT i.scenario_id, i.agent_idx, {', '.join(r('i.' + c, c) for c in ('speed','acceleration','deceleration','jerk'))}, i.trajectory_type,
 {r('i.kalman_difficulty','kalman_difficulty')}, {r('d.distance','distance')}, m.pairs, m.valid_pairs FROM ind i
JOIN de d ON d.scenario_id=i.scenario_id AND d.agent_idx=i.agent_idx LEFT JOIN m ON m.scenario_id=i.scenario_id AND m.agent_idx=i.agent_idx""")
agent_score_ctes("cc", "ic", "pc", "we", PRESETS["combined_categorical"])
cte("ccl", """
SELECT *, 'individual' AS scorer FROM cc_a UNION ALL SELECT *, 'interaction' FROM cc_b""")
cte("ccv", """SELECT scorer, score FROM ccl WHERE valid AND score >= 0
 AND scenario_id IN (SELECT scenario_id FROM we GROUP BY 1 HAVING count(*) > 1)""")
cte("cct", threshold_sql("ccv", "scorer", "score"))
cte("cat_", """
WITH a AS (SELECT c.*, CASE WHEN valid THEN 1e0 + (SELECT count(*) FROM cct t WHERE t.scorer='individual' AND t.value < c.score) ELSE 0e0 END AS k FROM cc_a c),
b AS (SELECT c.*, 1e0 + (SELECT count(*) FROM cct t WHERE t.scorer='interaction' AND t.value < c.score) AS k FROM cc_b c)
SELECT scenario_id, agent_idx, 'individual' AS scorer, k AS score, valid FROM a UNION ALL
SELECT a.scenario_id, a.agent_idx, 'interaction', b.k, b.valid FROM a LEFT JOIN b ON b.scenario_id=a.scenario_id AND b.agent_idx=a.agent_idx UNION ALL
SELECT a.scenario_id, a.agent_idx, 'combined', a.k+coalesce(b.k,0), CASE WHEN b.valid IS NOT NULL THEN a.valid OR b.valid END
 FROM a LEFT JOIN b ON b.scenario_id=a.scenario_id AND b.agent_idx=a.agent_idx""")
oracle("A26_profile_chain", """
SELECT scenario_id, agent_idx, scorer, score, valid FROM cat_""")
oracle("A26_scene_categories", f"""
WITH s AS (SELECT scenario_id, scorer, CASE WHEN count(score) > 0 THEN
  least(greatest(sum(score)/greatest(count(*) FILTER (valid),1),0),200) END AS v FROM cat_ WHERE scorer <> 'combined' GROUP BY ALL)
SELECT scenario_id, scorer, {r('v','scene_score')} FROM s UNION ALL
SELECT scenario_id, 'combined', {r('least(greatest(0.5e0*sum(v),0),200)','scene_score')} FROM s GROUP BY scenario_id""")
oracle("W09_single_agent_scenes", f"""
SELECT scenario_id, agent_idx, scorer, {r('score')}, valid FROM asc_ WHERE scenario_id NOT IN (SELECT scenario_id FROM full_)""")
