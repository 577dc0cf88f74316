"""Queries of editing, measuring and race tools, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tackline.functions import sailing
from tackline.functions.canonical import rounded
from tackline.functions.text import sail_display
from tackline.operators import edits, measure, polar, races
from tackline.operators.catalogue import IDENTITY
from tackline.plans import sql as S
from tackline.plans import views as V
from tackline.plans.sql import bucket_sql, d, rnd

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return register


def _r6(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: rounded(c, 6) for c in columns})


def _nodes(spark, sf_dir):
    return polar.collect_points(V.polar_points(spark, sf_dir), ["source_id"])


# ---- edits

_PICK = "(CAST(twa AS BIGINT) + CAST(tws AS BIGINT)) % 7 < 3"
_HELD = "held AS (SELECT source_id, twa, tws, bsp / 2 AS bsp FROM nodes WHERE (CAST(twa AS BIGINT) + source_id) % 4 = 0)"


@query(
    "edit_smooth",
    f"""WITH {S.NODES}, {_HELD}, p AS (SELECT *, dense_rank() OVER (PARTITION BY source_id ORDER BY twa) AS i, dense_rank() OVER (PARTITION BY source_id ORDER BY tws) AS j FROM nodes),
s AS (SELECT a.source_id, a.twa, a.tws, {rnd("least(60, sum(b.bsp * (2 - abs(a.i - b.i)) * (2 - abs(a.j - b.j))) / sum((2 - abs(a.i - b.i)) * (2 - abs(a.j - b.j))))")} AS after FROM p a JOIN p b ON a.source_id = b.source_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2, 3)
SELECT s.source_id, s.twa, s.tws, {rnd("h.bsp")} AS before, s.after FROM s LEFT JOIN held h ON h.source_id = s.source_id AND h.twa = s.twa AND h.tws = s.tws WHERE {_PICK.replace("twa AS", "s.twa AS").replace("tws AS", "s.tws AS")} AND h.bsp IS DISTINCT FROM s.after""",
)
def edit_smooth(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    held = nodes.where("(CAST(twa AS BIGINT) + source_id) % 4 = 0").withColumn("bsp", F.col("bsp") / 2)
    return _r6(edits.changes(held, edits.smooth(nodes, nodes.where(_PICK))), "before", "after")


@query(
    "edit_overrides",
    f"""WITH {S.NODES}, {_HELD}, e AS (SELECT source_id, twa, tws, CASE WHEN tws <= 12 THEN {rnd("least(60, bsp * 1.1)")} END AS bsp FROM nodes WHERE {_PICK})
SELECT h.source_id, h.twa, h.tws, {rnd("h.bsp")} AS bsp FROM held h WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source_id = h.source_id AND e.twa = h.twa AND e.tws = h.tws) UNION ALL SELECT source_id, twa, tws, bsp FROM e WHERE bsp IS NOT NULL""",
)
def edit_overrides(spark, sf_dir):
    """Overrides after cells of light wind were scaled and the others reset."""
    nodes = _nodes(spark, sf_dir)
    held = nodes.where("(CAST(twa AS BIGINT) + source_id) % 4 = 0").withColumn("bsp", F.col("bsp") / 2)
    picked = nodes.where(_PICK)
    done = edits.edited(edits.edited(held, edits.scale(nodes, picked.where("tws <= 12"), 10.0)), edits.reset(picked.where("tws > 12")))
    return _r6(done, "bsp")


# ---- measuring


@query(
    "measure_crossings",
    f"""WITH {S.NODES}, e AS (SELECT source_id, tws, max(CASE WHEN twa <= 100 THEN twa END) AS a, min(CASE WHEN twa >= 100 THEN twa END) AS b FROM nodes WHERE twa > 0 AND twa < 360 GROUP BY 1, 2),
v AS (SELECT e.source_id, e.tws, {rnd("CASE WHEN e.a = e.b THEN x.bsp ELSE x.bsp + (y.bsp - x.bsp) * (100 - e.a) / (e.b - e.a) END")} AS bsp FROM e JOIN nodes x ON x.source_id = e.source_id AND x.tws = e.tws AND x.twa = e.a JOIN nodes y ON y.source_id = e.source_id AND y.tws = e.tws AND y.twa = e.b)
SELECT source_id, tws, bsp, row_number() OVER (ORDER BY bsp DESC, source_id, tws) - 1 AS place FROM v""",
)
def measure_crossings(spark, sf_dir):
    return _r6(measure.crossings(polar.curves(_nodes(spark, sf_dir)), 100.0), "bsp").withColumn("place", F.col("place").cast("long"))


_LASSO = [(30.0, 2.0), (90.0, 1.0), (160.0, 4.0), (120.0, 12.0), (60.0, 14.0), (85.0, 6.0)]
_CROSSED = " + ".join(
    f"(CASE WHEN bsp >= {d(min(ya, yb))} AND bsp < {d(max(ya, yb))} AND twa < {d(xa)} + (bsp - {d(ya)}) * {d((xb - xa))} / {d(yb - ya)} THEN 1 ELSE 0 END)" for (xa, ya), (xb, yb) in zip(_LASSO, _LASSO[1:] + _LASSO[:1], strict=True)
)


@query("lasso_summary", f"WITH {S.POINTS} SELECT track_id, count(*) AS points, " + ", ".join(f"{rnd(f'{f}({c})')} AS {n}_{c}" for c in ("twa", "bsp") for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"))) + f" FROM points WHERE ({_CROSSED}) % 2 = 1 GROUP BY track_id")
def lasso_summary(spark, sf_dir):
    rows = V.points(spark, sf_dir).where(measure.inside("twa", "bsp", _LASSO))
    return _r6(measure.selection_summary(rows, ["track_id"], ["twa", "bsp"]), *[f"{n}_{c}" for c in ("twa", "bsp") for n in ("min", "max", "mean")])


_NEARNESS = "least(abs(p.twa - q.twa), 360 - abs(p.twa - q.twa))"


@query(
    "same_wind_in_copies",
    f"""WITH {S.POINTS}, c AS (SELECT * FROM (SELECT e, twa, tws, {bucket_sql(8)} AS copy FROM points) WHERE copy IS NOT NULL),
n AS (SELECT q.e AS asked_id, p.copy, p.e AS id, {_NEARNESS} * {_NEARNESS} / {d(25)} + (p.tws - q.tws) * (p.tws - q.tws) AS score FROM c q JOIN c p ON p.copy <> q.copy AND {_NEARNESS} <= 5 AND abs(p.tws - q.tws) <= 1 WHERE q.e % 40 = 0)
SELECT asked_id, copy, min_by(id, (score, id)) AS id FROM n GROUP BY 1, 2""",
)
def same_wind_in_copies(spark, sf_dir):
    """For every fortieth sample the nearest in wind with each other wave direction."""
    copy = sailing.wave_bucket(8, "from", F.coalesce("heading_corrected", "heading"))
    points = V.points(spark, sf_dir).select(F.col("e").alias("id"), copy.alias("copy"), "twa", "tws").where("copy is not null")
    return measure.same_wind(points, points.where("id % 40 = 0").withColumnRenamed("id", "asked_id"))


# ---- races and catalogues

_SAIL = [("concat(c, '/', c, k)", "concat(c, ' ', k)"), ("concat(lower(c), '-', k)", "concat(c, ' ', k)"), ("'_3'", "''"), ("c", "concat(c, ' ', c)"), ("concat('  X', k, ' ')", "concat(c, ' X', k)"), ("''", "''")]
_CASES = lambda part: "CASE k % 6 " + " ".join(f"WHEN {n} THEN {x[part]}" for n, x in enumerate(_SAIL)) + " END"


@query("sail_display", f"SELECT k, {_CASES(1)} AS shown FROM (SELECT c_custkey AS k, substring(n_name, 1, 3) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def sail_numbers(spark, sf_dir):
    rows = V.certificates(spark, sf_dir).selectExpr("id AS k", "country AS c").selectExpr("k", "c", f"{_CASES(0)} AS number")
    return rows.select("k", sail_display("number", "c").alias("shown"))


@query(
    "team_divisions",
    """WITH tags AS (SELECT n_nationkey AS tag_id, n_name AS name, CASE WHEN n_nationkey % 4 <> 0 THEN (n_nationkey * 7) % 5 END AS sort, CASE WHEN n_nationkey % 5 = 1 THEN 100 END AS start, CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS visible FROM nation),
worn AS (SELECT DISTINCT s_suppkey AS team_id, (s_suppkey * k) % 25 AS tag_id FROM supplier CROSS JOIN (VALUES (1), (2), (3)) AS v(k)), t AS (SELECT w.team_id, g.* FROM worn w JOIN tags g ON g.tag_id = w.tag_id WHERE visible IS NULL OR visible <> 0),
u AS (SELECT *, max(start) OVER (PARTITION BY team_id) AS any_start FROM t)
SELECT team_id, string_agg(name, ', ' ORDER BY sort NULLS LAST, tag_id) AS division FROM u WHERE any_start IS NULL OR start IS NOT NULL GROUP BY team_id""",
)
def team_divisions(spark, sf_dir):
    tags = V.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS tag_id", "n_name AS name", "CASE WHEN n_nationkey % 4 <> 0 THEN (n_nationkey * 7) % 5 END AS sort", "CASE WHEN n_nationkey % 5 = 1 THEN 100 END AS start", "CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS show")
    teams = V.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS team_id", "array(s_suppkey % 25, (s_suppkey * 2) % 25, (s_suppkey * 3) % 25) AS tags")
    return races.divisions(teams, tags)


_STATUS = "CASE WHEN l_partkey % 40 = 0 THEN 'racing' WHEN l_partkey % 3 = 0 THEN ' dnf ' ELSE 'Finished' END"


@query(
    "race_finished",
    f"""WITH b AS (SELECT l_orderkey AS event_id, l_linenumber * 100 AS finish, {_STATUS} AS status FROM lineitem), ev AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 9 = 0 THEN 900 ELSE 10 END AS start FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)
SELECT event_id, start <= 600 AND coalesce((SELECT bool_and(finish <= 600 AND status <> 'racing') FROM b WHERE b.event_id = ev.event_id), FALSE) AS finished FROM ev""",
)
def race_finished(spark, sf_dir):
    boats = V.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS event_id", "CAST(NULL AS INT) AS start", "l_linenumber * 100 AS finish", f"{_STATUS} AS status")
    events = V.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").selectExpr("o_orderkey AS event_id", "CASE WHEN o_orderkey % 9 = 0 THEN 900 ELSE 10 END AS start", "CAST(NULL AS INT) AS stop")
    return races.finished(events, boats, 600)


_TURNED = S.mod360(f"lon + {d(360)} + {d(180)}") + f" - {d(180)}"


@query("region_counts", f"WITH {S.FIXES}, turned AS (SELECT track_id, lat, CASE WHEN track_id % 2 = 0 AND lon + {d(360)} >= 180 THEN {_TURNED} ELSE lon END AS lon FROM fixes) SELECT track_id, CAST(sum(CASE WHEN lat BETWEEN 40 AND 65.1 AND lon BETWEEN -20 AND 13.1 THEN 1 ELSE 0 END) AS BIGINT) AS shelf, CAST(sum(CASE WHEN lat BETWEEN 26.1 AND 56.1 AND lon BETWEEN -19.1 AND 5.1 THEN 1 ELSE 0 END) AS BIGINT) AS biscay FROM turned GROUP BY track_id")
def region_counts(spark, sf_dir):
    rows = V.fixes(spark, sf_dir).withColumn("lon", F.when(F.col("track_id") % 2 == 0, F.col("lon") + 360.0).otherwise(F.col("lon")))
    return rows.groupBy("track_id").agg(F.count_if(races.in_region("lat", "lon", races.NORTH_WEST_SHELF)).alias("shelf"), F.count_if(races.in_region("lat", "lon", races.IBERIA_BISCAY_IRELAND)).alias("biscay"))


_TWINS = "CAST(c_custkey AS BIGINT) AS id, substring(n_name, 1, 3) AS country, CAST(c_custkey % 20 AS VARCHAR) AS sail_no, c_mktsegment AS name, CASE WHEN c_custkey % 13 <> 0 THEN 'm' END AS model, CAST(1990 + c_custkey % 2 AS INTEGER) AS year, CAST(NULL AS INTEGER) AS certificate_year"
_SAME = " AND ".join(f"s.{c} IS NOT DISTINCT FROM e.{c}" for c in IDENTITY)


@query(
    "catalogue_overlay",
    f"""WITH x AS (SELECT {_TWINS} FROM customer JOIN nation ON c_nationkey = n_nationkey), e AS (SELECT *, row_number() OVER (PARTITION BY {", ".join(IDENTITY)} ORDER BY id) AS k FROM x WHERE id % 3 <> 0), s0 AS (SELECT *, id % 5 = 0 AS withdrawn FROM x WHERE id % 3 = 0),
s AS (SELECT *, row_number() OVER (PARTITION BY {", ".join(IDENTITY)} ORDER BY id) AS k FROM s0 WHERE NOT withdrawn), m AS (SELECT e.id AS embedded_id, s.id AS scraped_id FROM e LEFT JOIN s ON e.k = 1 AND s.k = 1 AND {_SAME})
SELECT embedded_id, scraped_id, FALSE AS withdrawn FROM m UNION ALL SELECT NULL, id, withdrawn FROM s0 WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.scraped_id = s0.id)""",
)
def catalogue_overlay(spark, sf_dir):
    both = V.table(spark, sf_dir, "customer").join(V.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = both.select(
        F.col("c_custkey").cast("long").alias("id"), F.substring("n_name", 1, 3).alias("country"), (F.col("c_custkey") % 20).cast("string").alias("sail_no"), F.col("c_mktsegment").alias("name"),
        F.when(F.col("c_custkey") % 13 != 0, "m").alias("model"), (1990 + F.col("c_custkey") % 2).cast("int").alias("year"), F.lit(None).cast("int").alias("certificate_year"),
    )
    scraped = rows.where("id % 3 = 0").withColumn("withdrawn", F.col("id") % 5 == 0).withColumnRenamed("id", "scraped_id")
    return races.overlaid(rows.where("id % 3 <> 0").withColumnRenamed("id", "embedded_id"), scraped)
