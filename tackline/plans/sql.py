"""SQL text shared by the oracles: the same views and expressions in DuckDB's dialect."""

from __future__ import annotations

from tackline.plans.views import MAX_GAP_S, TWA, TWS

R = "6371229.0"


def d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def rnd(x: str, places: int = 6) -> str:
    scale = f"CAST({10**places} AS DOUBLE)"
    return f"(round(({x}) * {scale}) / {scale} + CAST(0 AS DOUBLE))"


def mod360(x: str) -> str:
    return f"(((({x}) % {d(360)}) + {d(360)}) % {d(360)})"


def wrap(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 AND ({x}) < 360 THEN ({x}) ELSE {mod360(x)} END)"


def off(a: str, b: str) -> str:
    m = mod360(f"({a}) - ({b})")
    return f"(CASE WHEN {m} > 180 THEN {d(360)} - {m} ELSE {m} END)"


def dist(a: str, b: str, c: str, e: str) -> str:
    h = f"(power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians(({e}) - ({b})) / 2), 2))"
    return f"({d(2)} * {d(R)} * atan2(sqrt({h}), sqrt(greatest({d(1)} - {h}, {d(0)}))))"


def bearing(a: str, b: str, c: str, e: str) -> str:
    lam = f"radians(({e}) - ({b}))"
    y = f"(sin({lam}) * cos(radians({c})))"
    x = f"(cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos({lam}))"
    return f"(CASE WHEN {dist(a, b, c, e)} >= {d('0.000001')} THEN {wrap(f'degrees(atan2({y}, {x}))')} END)"


def hypot(a: str, b: str) -> str:
    return f"sqrt(({a}) * ({a}) + ({b}) * ({b}))"


FIXES = f"""
ev AS (SELECT event_id AS e, user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS fix_idx, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type, value FROM events),
fixes AS (SELECT track_id, fix_idx, t, e, event_type, value,
  {d(40)} + (track_id * 7) % 20 + fix_idx * {d(0.01)} AS lat, {d(-30)} + (track_id * 11) % 60 + fix_idx * {d(0.02)} AS lon,
  CASE WHEN e % 5 <> 0 THEN ((e * 137) % 3600) / {d(10)} END AS cog, CASE WHEN e % 7 <> 0 THEN ((e * 31) % 1500) / {d(100)} END AS sog,
  {d(4)} + ((e * 17) % 260) / {d(10)} AS tws, ((e * 61) % 3600) / {d(10)} AS twd_from,
  CASE WHEN e % 4 <> 0 THEN {d(4)} + ((e * 23) % 240) / {d(10)} END AS sup_tws, CASE WHEN e % 4 <> 1 THEN ((e * 43) % 3600) / {d(10)} END AS sup_twd,
  CASE WHEN e % 11 <> 0 THEN ((e * 13) % 60) / {d(10)} END AS hs_m, ((e * 29) % 3600) / {d(10)} AS wave_from, {d(2)} + ((e * 19) % 120) / {d(10)} AS wave_period_s,
  CASE WHEN e % 3 <> 0 THEN ((e * 23) % 30) / {d(10)} END AS current_speed, ((e * 41) % 3600) / {d(10)} AS current_toward, CAST(e % 6 AS INTEGER) AS current_dataset
  FROM ev)"""


def merged(source: str = "fixes") -> str:
    """The first fix of a time, and the first given values of those that share it."""
    first = ", ".join(f"(SELECT x.{c} FROM {source} x WHERE x.track_id = f.track_id AND x.t = f.t AND x.{c} IS NOT NULL ORDER BY x.fix_idx LIMIT 1) AS {c}" for c in ("cog", "sog"))
    return f"merged AS (SELECT track_id, t, fix_idx, lat, lon, {first}, tws, twd_from FROM (SELECT *, row_number() OVER (PARTITION BY track_id, t ORDER BY fix_idx) AS rn FROM {source}) f WHERE rn = 1)"


_W = "OVER (PARTITION BY track_id ORDER BY t, fix_idx)"
_ARRIVE = wrap(f"{bearing('lat', 'lon', 'plat', 'plon')} + {d(180)}")
_LEAVE = bearing("lat", "lon", "nlat", "nlon")
_MY, _MX = "(sin(radians(arrive)) + sin(radians(leave)))", "(cos(radians(arrive)) + cos(radians(leave)))"
MOTIONS = (
    FIXES
    + ",\n"
    + merged()
    + f""",
n0 AS (SELECT *, lag(t) {_W} AS pt0, lag(lat) {_W} AS plat0, lag(lon) {_W} AS plon0, lead(t) {_W} AS nt0, lead(lat) {_W} AS nlat0, lead(lon) {_W} AS nlon0 FROM merged),
n1 AS (SELECT *, CASE WHEN t - pt0 <= {MAX_GAP_S} THEN pt0 END AS pt, CASE WHEN t - pt0 <= {MAX_GAP_S} THEN plat0 END AS plat, CASE WHEN t - pt0 <= {MAX_GAP_S} THEN plon0 END AS plon,
  CASE WHEN nt0 - t <= {MAX_GAP_S} THEN nt0 END AS nt, CASE WHEN nt0 - t <= {MAX_GAP_S} THEN nlat0 END AS nlat, CASE WHEN nt0 - t <= {MAX_GAP_S} THEN nlon0 END AS nlon FROM n0),
n2 AS (SELECT *, CASE WHEN pt IS NOT NULL THEN {_ARRIVE} END AS arrive, CASE WHEN nt IS NOT NULL THEN {_LEAVE} END AS leave,
  coalesce({dist("plat", "plon", "lat", "lon")}, {d(0)}) + coalesce({dist("lat", "lon", "nlat", "nlon")}, {d(0)}) AS leg, CAST(coalesce(nt, t) - coalesce(pt, t) AS DOUBLE) AS secs FROM n1),
n3 AS (SELECT *, CASE WHEN arrive IS NOT NULL AND leave IS NOT NULL THEN (CASE WHEN {hypot(_MY, _MX)} > {d("0.000000001")} THEN {wrap(f"degrees(atan2({_MY}, {_MX}))")} END) ELSE coalesce(arrive, leave) END AS dh,
  CASE WHEN secs > 0 THEN leg / secs / ({d(1852)} / {d(3600)}) END AS ds FROM n2),
motions AS (SELECT track_id, t, fix_idx, lat, lon, cog, sog, tws, twd_from, coalesce(cog, dh) AS heading, CASE WHEN cog IS NOT NULL THEN 'given' WHEN dh IS NOT NULL THEN 'derived' END AS heading_origin,
  coalesce(sog, ds) AS speed, CASE WHEN sog IS NOT NULL THEN 'given' WHEN ds IS NOT NULL THEN 'derived' END AS speed_origin FROM n3)"""
)


def compass(e: str, n: str) -> str:
    return mod360(f"degrees(atan2({e}, {n}))")


def tack(h: str, w: str) -> str:
    m = mod360(f"({w}) - ({h})")
    return f"(CASE WHEN {m} > 0 AND {m} < 180 THEN 'starboard' WHEN {m} > 180 THEN 'port' END)"


def north(x: str) -> str:
    return f"(CASE WHEN {rnd(x, 9)} = 360 THEN {d(0)} ELSE {rnd(x, 9)} END)"


SAMPLES = (
    MOTIONS
    + f""",
q0 AS (SELECT m.*, f.e, f.hs_m, f.wave_from, f.wave_period_s, f.current_speed, f.current_toward, f.current_dataset,
  CASE WHEN f.sup_tws IS NOT NULL AND f.sup_twd IS NOT NULL THEN f.sup_tws ELSE m.tws END AS wind_speed, CASE WHEN f.sup_tws IS NOT NULL AND f.sup_twd IS NOT NULL THEN f.sup_twd ELSE m.twd_from END AS wind_from
  FROM motions m JOIN fixes f ON m.track_id = f.track_id AND m.fix_idx = f.fix_idx),
q1 AS (SELECT *, speed * sin(radians(heading)) - current_speed * sin(radians(current_toward)) AS we, speed * cos(radians(heading)) - current_speed * cos(radians(current_toward)) AS wn,
  wind_speed * sin(radians(wind_from + {d(180)})) - current_speed * sin(radians(current_toward)) AS re, wind_speed * cos(radians(wind_from + {d(180)})) - current_speed * cos(radians(current_toward)) AS rn0 FROM q0),
q2 AS (SELECT *, {hypot("we", "wn")} AS b0, {hypot("re", "rn0")} AS s0 FROM q1),
q3 AS (SELECT *, CASE WHEN b0 > {d("0.000000001")} THEN {compass("we", "wn")} END AS h0, CASE WHEN s0 > {d("0.000000001")} THEN {mod360(compass("re", "rn0") + " + 180")} END AS w0 FROM q2),
samples AS (SELECT track_id, fix_idx, t, e, lat, lon, heading, speed, wind_speed, wind_from, hs_m, wave_from, wave_period_s, current_speed, current_toward, current_dataset,
  {rnd(off("heading", "wind_from"), 9)} AS twa, {tack("heading", "wind_from")} AS tack, {rnd("b0")} AS bsp_corrected, {north("h0")} AS heading_corrected, {rnd("s0")} AS tws_corrected, {north("w0")} AS twd_from_corrected,
  {rnd(off("h0", "w0"), 9)} AS twa_corrected, {tack("h0", "w0")} AS tack_corrected, {rnd(off("coalesce(h0, heading)", "wave_from"), 9)} AS wave_angle FROM q3)"""
)
_WATER = "(twa_corrected IS NOT NULL AND tws_corrected IS NOT NULL AND bsp_corrected IS NOT NULL)"
_GROUND = "(twa IS NOT NULL AND wind_speed IS NOT NULL AND speed IS NOT NULL)"
PLACED = (
    SAMPLES
    + f""",
placed AS (SELECT *, CASE WHEN {_WATER} THEN twa_corrected WHEN {_GROUND} THEN twa END AS p_twa, CASE WHEN {_WATER} THEN tws_corrected WHEN {_GROUND} THEN wind_speed END AS p_tws,
  CASE WHEN {_WATER} THEN bsp_corrected WHEN {_GROUND} THEN speed END AS p_bsp FROM samples)"""
)


def bin_sql(x: str, axis: list[float]) -> str:
    low, high = axis[0] - (axis[1] - axis[0]) / 2, axis[-1] + (axis[-1] - axis[-2]) / 2
    steps = " ".join(f"WHEN {x} < {d((a + b) / 2)} THEN {k}" for k, (a, b) in enumerate(zip(axis, axis[1:], strict=False)))
    return f"(CASE WHEN {x} < {d(low)} OR {x} > {d(high)} OR {x} IS NULL THEN NULL {steps} ELSE {len(axis) - 1} END)"


POINTS = PLACED + ",\npoints AS (SELECT track_id, e, p_twa AS twa, p_tws AS tws, p_bsp AS bsp, wave_from, heading, heading_corrected, hs_m, wave_period_s FROM placed WHERE p_twa IS NOT NULL)"
BINNED = POINTS + f",\nbinned AS (SELECT * FROM (SELECT *, {bin_sql('twa', TWA)} AS i, {bin_sql('tws', TWS)} AS j FROM points) WHERE i IS NOT NULL AND j IS NOT NULL AND i <> 0 AND bsp >= 0)"


def axis_values(values: list[float], index: str, name: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(f'({k}, {d(v)})' for k, v in enumerate(values))}) AS v({index}, {name}))"


GRID = f"axis_i AS {axis_values(TWA, 'i', 'twa')}, axis_j AS {axis_values(TWS, 'j', 'tws')}, grid AS (SELECT i, twa, j, tws FROM axis_i CROSS JOIN axis_j)"
NODES = f"""
pts AS (SELECT CAST(p_partkey % 6 AS BIGINT) AS source_id, CAST(30 + 15 * (p_size % 11) AS DOUBLE) AS twa, CAST(4 + 4 * ((p_partkey * 5 + p_size) % 6) AS DOUBLE) AS tws, {d(3)} + ((p_partkey * 13 + p_size * 7) % 700) / {d(100)} AS bsp FROM part),
nodes AS (SELECT source_id, twa, tws, {rnd("avg(bsp)")} AS bsp FROM pts WHERE (source_id * 7 + CAST(twa AS BIGINT) * 3 + CAST(tws AS BIGINT)) % 9 <> 0 GROUP BY 1, 2, 3)"""
#: Each source's nodes read at the grid: between a column's own nearest angles, then between columns.
READ = (
    GRID
    + f""",
span AS (SELECT source_id, min(twa) AS lo_a, max(twa) AS hi_a FROM nodes GROUP BY 1),
cols AS (SELECT DISTINCT source_id, tws FROM nodes),
ask AS (SELECT s.source_id, g.i, g.j, g.twa AS a, g.tws AS s, (SELECT max(c.tws) FROM cols c WHERE c.source_id = s.source_id AND c.tws <= g.tws) AS s0, (SELECT min(c.tws) FROM cols c WHERE c.source_id = s.source_id AND c.tws >= g.tws) AS s1
  FROM span s CROSS JOIN grid g WHERE g.twa >= s.lo_a AND g.twa <= s.hi_a),
sides AS (SELECT source_id, i, j, a, s, s0, s1, s0 AS c FROM ask WHERE s0 IS NOT NULL AND s1 IS NOT NULL UNION SELECT source_id, i, j, a, s, s0, s1, s1 AS c FROM ask WHERE s0 IS NOT NULL AND s1 IS NOT NULL),
near AS (SELECT q.*, (SELECT max(n.twa) FROM nodes n WHERE n.source_id = q.source_id AND n.tws = q.c AND n.twa <= q.a) AS a0, (SELECT min(n.twa) FROM nodes n WHERE n.source_id = q.source_id AND n.tws = q.c AND n.twa >= q.a) AS a1 FROM sides q),
cread AS (SELECT q.source_id, q.i, q.j, q.s, q.s0, q.s1, q.c, q.a0, q.a1, CASE WHEN a0 = a1 THEN x.bsp ELSE x.bsp + (y.bsp - x.bsp) * ((q.a - q.a0) / (q.a1 - q.a0)) END AS v
  FROM near q JOIN nodes x ON x.source_id = q.source_id AND x.tws = q.c AND x.twa = q.a0 JOIN nodes y ON y.source_id = q.source_id AND y.tws = q.c AND y.twa = q.a1),
read AS (SELECT l.source_id, l.i, l.j, CASE WHEN l.s0 = l.s1 THEN l.v ELSE l.v + (h.v - l.v) * ((l.s - l.s0) / (l.s1 - l.s0)) END AS bsp
  FROM cread l JOIN cread h ON l.source_id = h.source_id AND l.i = h.i AND l.j = h.j AND l.c = l.s0 AND h.c = h.s1)"""
)


def bucket_sql(n: int) -> str:
    """The wave bucket of a point, of n around the boat, in single precision as stored."""
    bear = f"CAST({wrap('wave_from - coalesce(heading_corrected, heading)')} AS FLOAT)"
    step, half = f"CAST({360 / n} AS FLOAT)", f"CAST({180 / n} AS FLOAT)"
    turn = f"((CASE WHEN {bear} >= 360 THEN CAST(0 AS FLOAT) ELSE {bear} END) + {half})"
    return f"(CAST(floor((CASE WHEN {turn} >= 360 THEN {turn} - CAST(360 AS FLOAT) ELSE {turn} END) / {step}) AS INTEGER))"
