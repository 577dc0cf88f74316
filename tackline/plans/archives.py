"""Queries of written weather archives, each beside its SQL. Points are the fixes of events."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from tackline.durable import shared_folder
from tackline.functions.canonical import rounded
from tackline.operators import archive
from tackline.operators.weather import Axes
from tackline.plans import sql as S
from tackline.plans import views as V
from tackline.plans.sql import d, rnd

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

AXES = Axes(t0=1_704_067_200, dt=21_600, steps=124, lat0=35.0, dlat=2.0, lats=20, lon0=-40.0, dlon=3.0, lons=30)
EARLY = replace(AXES, steps=60)
BOX = (44.0, 52.0, -20.0, 10.0)

#: Quantities by the same arithmetic in both engines: a multiple of (i, j, step), what it is taken modulo, divided by, less; and where it is missing.
_QUANTITIES = {
    "u10": ((7, 13, 29, 0), 200, 10, 10, (3, 5, 0, 17)), "v10": ((7, 13, 29, 77), 200, 10, 10, (3, 5, 0, 17)), "ucur": ((11, 5, 3, 0), 60, 20, 1, (1, 1, 0, 6)), "vcur": ((5, 17, 7, 9), 60, 20, 1, (1, 2, 1, 11)),
    "hs": ((3, 7, 11, 2), 90, 10, 0, (1, 0, 1, 8)), "period": ((13, 3, 5, 4), 120, 10, 2, (0, 1, 1, 9)), "wave_from": ((31, 17, 7, 0), 360, 1, 0, (2, 1, 0, 9)),
}


def _cells(spark, axes: Axes, shift: int = 0):
    rows = spark.range(axes.steps).toDF("step").join(F.broadcast(spark.range(axes.lats).toDF("i"))).join(F.broadcast(spark.range(axes.lons).toDF("j")))
    line = lambda a, b, c, k: F.col("i") * a + F.col("j") * b + F.col("step") * c + k + shift
    return rows.select("step", "i", "j", *[F.when(line(*m[:3], 0) % m[3] != 0, (line(*x) % n).cast("double") / float(div) - float(less)).alias(q) for q, (x, n, div, less, m) in _QUANTITIES.items()])


def _cells_sql(name: str, axes: Axes, shift: int = 0) -> str:
    line = lambda a, b, c, k: f"(a.range * {a} + b.range * {b} + s.range * {c} + {k + shift})"
    columns = ", ".join(f"CASE WHEN {line(*m[:3], 0)} % {m[3]} <> 0 THEN ({line(*x)} % {n}) / {d(div)} - {d(less)} END AS {q}" for q, (x, n, div, less, m) in _QUANTITIES.items())
    return f"{name} AS (SELECT s.range AS step, a.range AS i, b.range AS j, {columns} FROM range({axes.steps}) s CROSS JOIN range({axes.lats}) a CROSS JOIN range({axes.lons}) b)"


def _source(spark, axes: Axes, shift: int = 0, box=None) -> archive.Source:
    path = f"{shared_folder(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    archive.write(_cells(spark, axes, shift), path)
    return archive.Source(path, axes, box)


def _points(spark, sf_dir):
    return V.fixes(spark, sf_dir).select(F.col("e").alias("point_id"), "t", "lat", "lon")


_POINTS = S.FIXES + ", points AS (SELECT e AS point_id, t, lat, lon FROM fixes)"


def _read_sql(p: str, points: str, cells: str, axes: Axes, columns: dict[str, str]) -> str:
    """CTEs that end in ``p``: point_id and each of the columns (name to expression over a cell)."""
    side = ", ".join(f"sum(k.weight * ({x})) FILTER (({x}) IS NOT NULL) / sum(k.weight) FILTER (({x}) IS NOT NULL) AS {n}" for n, x in columns.items())
    both = ", ".join(f"max(CASE WHEN side = 0 THEN {n} END) AS a_{n}, max(CASE WHEN side = 1 THEN {n} END) AS b_{n}" for n in columns)
    timed = ", ".join(f"CASE WHEN a_{n} IS NOT NULL AND b_{n} IS NOT NULL THEN a_{n} + (b_{n} - a_{n}) * tw WHEN a_{n} IS NOT NULL AND tw <= 0.5 THEN a_{n} WHEN b_{n} IS NOT NULL AND tw >= 0.5 THEN b_{n} END AS {n}" for n in columns)
    return f"""{p}_pt AS (SELECT point_id, (t - {axes.t0}) / {d(axes.dt)} AS ft, (lat - {d(axes.lat0)}) / {d(axes.dlat)} AS fy, (lon - {d(axes.lon0)}) / {d(axes.dlon)} AS fx FROM {points}),
{p}_in AS (SELECT *, least(CAST(floor(ft) AS BIGINT), {axes.steps - 2}) AS s, least(CAST(floor(fy) AS BIGINT), {axes.lats - 2}) AS i, least(CAST(floor(fx) AS BIGINT), {axes.lons - 2}) AS j FROM {p}_pt WHERE ft >= 0 AND ft <= {axes.steps - 1} AND fy >= 0 AND fy <= {axes.lats - 1} AND fx >= 0 AND fx <= {axes.lons - 1}),
{p}_key AS (SELECT point_id, ft - s AS tw, c.side, s + c.side AS step, x.i + c.a AS i, x.j + c.b AS j, (CASE WHEN c.a = 1 THEN fy - x.i ELSE 1 - (fy - x.i) END) * (CASE WHEN c.b = 1 THEN fx - x.j ELSE 1 - (fx - x.j) END) AS weight FROM {p}_in x CROSS JOIN (SELECT x.range AS side, y.range AS a, z.range AS b FROM range(2) x CROSS JOIN range(2) y CROSS JOIN range(2) z) c),
{p}_side AS (SELECT point_id, tw, k.side, {side} FROM {p}_key k JOIN {cells} c ON c.step = k.step AND c.i = k.i AND c.j = k.j WHERE k.weight > 0 AND (k.side = 0 OR k.tw > 0) GROUP BY 1, 2, 3),
{p} AS (SELECT point_id, {timed} FROM (SELECT point_id, tw, {both} FROM {p}_side GROUP BY 1, 2) x)"""


_PLAIN = {q: q for q in _QUANTITIES if q != "wave_from"}
_SEVEN = _PLAIN | {"ws": "sin(radians(wave_from))", "wc": "cos(radians(wave_from))"}
_NEAR = f"lat <= {d(48)}"
_FROM = f"CASE WHEN {S.hypot('ws', 'wc')} >= {d('0.000000001')} THEN {rnd(S.mod360('degrees(atan2(ws, wc))'), 4)} END"


def weather_combined(spark, sf_dir):
    """Seven quantities of one archive in one join, for the fixes of some latitudes: the scan is of their blocks alone."""
    got = archive.combined(_points(spark, sf_dir).where("lat <= 48"), _source(spark, AXES))
    r = lambda c, n=6: rounded(F.col(c), n)
    return got.select("point_id", r("wind.u").alias("wind_u"), r("wind.v").alias("wind_v"), r("current.u").alias("current_u"), r("current.v").alias("current_v"), r("waves.wave_from", 4).alias("wave_from"), r("waves.hs").alias("hs"), r("waves.period").alias("period"), F.col("waves").isNotNull().alias("has_waves"))


ORACLE["weather_combined"] = f"""WITH {_POINTS}, near AS (SELECT * FROM points WHERE {_NEAR}), {_cells_sql("arc", AXES)}, {_read_sql("got", "near", "arc", AXES, _SEVEN)}, w AS (SELECT *, {_FROM} AS wf, u10 IS NOT NULL AND v10 IS NOT NULL AS wind, ucur IS NOT NULL AND vcur IS NOT NULL AS cur FROM got)
SELECT point_id, CASE WHEN wind THEN {rnd("u10")} END AS wind_u, CASE WHEN wind THEN {rnd("v10")} END AS wind_v, CASE WHEN cur THEN {rnd("ucur")} END AS current_u, CASE WHEN cur THEN {rnd("vcur")} END AS current_v, wf AS wave_from, {rnd("hs")} AS hs, {rnd("period")} AS period, wf IS NOT NULL OR hs IS NOT NULL OR period IS NOT NULL AS has_waves
FROM w WHERE coalesce(u10, v10, ucur, vcur, hs, period, wf) IS NOT NULL"""


def weather_switch(spark, sf_dir):
    """Wind of the archive whose days a fix falls into, else of another."""
    got = archive.switched(_points(spark, sf_dir), _source(spark, EARLY), _source(spark, AXES, 5))
    return got.withColumns({c: rounded(c, 6) for c in ("u", "v")})


_WIND = {"u10": "u10", "v10": "v10"}
_EARLY_END = EARLY.t0 + (EARLY.steps - 1) * EARLY.dt
ORACLE["weather_switch"] = f"""WITH {_POINTS}, p0 AS (SELECT * FROM points WHERE t BETWEEN {EARLY.t0} AND {_EARLY_END}), p1 AS (SELECT * FROM points WHERE NOT (t BETWEEN {EARLY.t0} AND {_EARLY_END})), {_cells_sql("arc0", EARLY)}, {_cells_sql("arc1", AXES, 5)},
{_read_sql("got0", "p0", "arc0", EARLY, _WIND)}, {_read_sql("got1", "p1", "arc1", AXES, _WIND)}
SELECT point_id, {rnd("u10")} AS u, {rnd("v10")} AS v, 0 AS dataset FROM got0 WHERE u10 IS NOT NULL AND v10 IS NOT NULL UNION ALL SELECT point_id, {rnd("u10")}, {rnd("v10")}, 1 FROM got1 WHERE u10 IS NOT NULL AND v10 IS NOT NULL"""


def current_regions(spark, sf_dir):
    """Current of a region's archive, then one that cannot be read, then two parts of a third that are summed, then a last one."""
    region, merged, last = _source(spark, EARLY, 0, BOX), _source(spark, EARLY, 3), _source(spark, AXES, 8)
    gone = archive.Source(region.path + "-gone", AXES)
    one = [("ucur", "vcur")]
    got = archive.tiered(_points(spark, sf_dir), [(region, one), (gone, one), (merged, [("ucur", "vcur"), ("u10", "v10")]), (last, one)])
    return got.withColumns({c: rounded(c, 6) for c in ("u", "v")})


_CUR = {"ucur": "ucur", "vcur": "vcur"}
ORACLE["current_regions"] = f"""WITH {_POINTS}, pr AS (SELECT * FROM points WHERE lat BETWEEN {d(BOX[0])} AND {d(BOX[1])} AND lon BETWEEN {d(BOX[2])} AND {d(BOX[3])}), {_cells_sql("arc0", EARLY)}, {_cells_sql("arc2", EARLY, 3)}, {_cells_sql("arc3", AXES, 8)},
{_read_sql("got0", "pr", "arc0", EARLY, _CUR)}, {_read_sql("got2", "points", "arc2", EARLY, _CUR | _WIND)}, {_read_sql("got3", "points", "arc3", AXES, _CUR)},
al AS (SELECT point_id, ucur AS u, vcur AS v, 0 AS tier FROM got0 WHERE ucur IS NOT NULL AND vcur IS NOT NULL UNION ALL SELECT point_id, ucur + u10, vcur + v10, 2 FROM got2 WHERE ucur + u10 IS NOT NULL AND vcur + v10 IS NOT NULL UNION ALL SELECT point_id, ucur, vcur, 3 FROM got3 WHERE ucur IS NOT NULL AND vcur IS NOT NULL)
SELECT point_id, {rnd("u")} AS u, {rnd("v")} AS v, tier FROM al QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY tier) = 1"""

for _f in (weather_combined, weather_switch, current_regions):
    QUERIES[_f.__name__] = _f
