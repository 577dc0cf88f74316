"""Whole races put together from their parts, and race files written from table rows and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tackline.functions.canonical import rounded
from tackline.operators import races
from tackline.plans import sql as S
from tackline.plans import views as V
from tackline.plans.sql import d, rnd
from tackline.sources import race_files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_START = 1_704_067_200


def race_assembly(spark, sf_dir):
    """Customers as boats, nations as their classes, regions as runs; events as fixes, reports, arrivals and times of hiding."""
    boats = V.table(spark, sf_dir, "customer").selectExpr("c_custkey AS boat_id", "CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS class_id")
    classes = V.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS class_id", "CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS name", "CASE WHEN n_nationkey % 7 <> 0 THEN n_regionkey END AS run_id")
    runs = V.table(spark, sf_dir, "region").selectExpr("r_regionkey AS run_id", f"CASE WHEN r_regionkey <> 2 THEN {_START} + r_regionkey * 3600 END AS start")
    f = V.fixes(spark, sf_dir).withColumnRenamed("track_id", "boat_id")
    code = F.expr("element_at(array('RAC', 'STA', 'ARV', 'RET', 'ABD', 'XYZ', null), CAST(e % 7 + 1 AS INT))")
    reports = f.where("event_type = 'purchase'").select("boat_id", F.col("e").alias("seq"), "t", code.alias("code"))
    ends = lambda k: f.where(f"e % 150 = {k}").select("boat_id", "t")
    return races.assembled(boats, f.where("event_type <> 'purchase'"), reports, classes, runs, ends(3), ends(4), _START - 600)


ORACLE["race_assembly"] = f"""WITH {S.FIXES}, b AS (SELECT c_custkey AS boat_id, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS class_id FROM customer), f AS (SELECT * FROM fixes WHERE event_type <> 'purchase'),
rep AS (SELECT track_id, e, t, CASE e % 7 WHEN 0 THEN 'RACING' WHEN 1 THEN 'RACING' WHEN 2 THEN 'FINISHED' WHEN 3 THEN 'RETIRED' WHEN 4 THEN 'RETIRED' WHEN 5 THEN 'XYZ' END AS status FROM fixes WHERE event_type = 'purchase'),
lr AS (SELECT track_id, status FROM rep QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY e DESC) = 1), n AS (SELECT track_id, count(*) AS fixes, max(t) AS last FROM f WHERE track_id IN (SELECT boat_id FROM b) GROUP BY 1),
arr AS (SELECT track_id, max(t) AS t FROM fixes WHERE e % 150 = 3 GROUP BY 1), hid AS (SELECT track_id, max(t) AS t FROM fixes WHERE e % 150 = 4 GROUP BY 1), st AS (SELECT max(last) AS stop FROM n), li AS (SELECT t AS line FROM rep ORDER BY e DESC LIMIT 1)
SELECT b.boat_id, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS division, CASE WHEN arr.t IS NOT NULL THEN 'FINISHED' ELSE lr.status END AS status, coalesce(CASE WHEN r_regionkey <> 2 THEN {_START} + r_regionkey * 3600 END, {_START - 600}) AS start, coalesce(arr.t, hid.t, stop, line) AS finish, coalesce(n.fixes, 0) AS fixes
FROM b LEFT JOIN nation ON n_nationkey = class_id LEFT JOIN region ON r_regionkey = CASE WHEN n_nationkey % 7 <> 0 THEN n_regionkey END LEFT JOIN lr ON lr.track_id = boat_id LEFT JOIN n ON n.track_id = boat_id LEFT JOIN arr ON arr.track_id = boat_id LEFT JOIN hid ON hid.track_id = boat_id CROSS JOIN st LEFT JOIN li ON TRUE"""


def _race_texts(spark, sf_dir):
    """A file a track: columns in an order that differs from file to file, some without names, some faulty."""
    f = V.fixes(spark, sf_dir)
    num = lambda c: f"coalesce(CAST({c} AS STRING), 'null')"
    head = f"CAST(lon AS STRING), ',', CAST(lat AS STRING), ',0,', CASE WHEN track_id % 13 = 5 AND fix_idx = 1 THEN 'null' WHEN e % 2 = 0 THEN concat('\"', CAST(t * 1000 + 250 AS STRING), '\"') ELSE CAST(t * 1000 + 250 AS STRING) END"
    vertex = f"CASE WHEN track_id % 3 = 0 THEN concat('[', {head}, ',', {num('sog')}, ',', {num('cog')}, ']') WHEN track_id % 3 = 1 THEN concat('[', {head}, ',', CAST(tws AS STRING), ',', {num('cog')}, ',', CAST(twd_from AS STRING), ',', {num('sog')}, ']') ELSE concat('[', {head}, ',9,9,', {num('cog')}, ']') END"
    lines = f.selectExpr("track_id", "fix_idx", f"{vertex} AS v").groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fix_idx", "v"))), lambda x: x["v"]), ",").alias("all"))
    detail = """CASE WHEN track_id % 3 = 1 THEN ',"detail":{"sog":7,"cog":5,"trueWindSpeed":4,"TWD":6}' WHEN track_id % 3 = 2 THEN ',"detail":{"cog":6}' ELSE '' END"""
    kind = "CASE WHEN track_id % 17 = 3 THEN 'Point' ELSE 'LineString' END"
    text = f"""concat('{{"type":"FeatureCollection","features":[{{"type":"Feature","properties":{{"id":"other"}},"geometry":{{"type":"Point","coordinates":[0,0]}}}},{{"type":"Feature","properties":{{"vesselParticipantId":"p', CAST(track_id AS STRING), '"', {detail}, '}},"geometry":{{"type":"', {kind}, '","coordinates":[', all, ']}}}}]}}')"""
    return lines.selectExpr("track_id AS file", f"CASE WHEN track_id % 19 = 2 THEN '{{' ELSE {text} END AS text")


def race_geojson(spark, sf_dir):
    """Race files read for two in three of their participants, and what is wrong with files."""
    texts = _race_texts(spark, sf_dir)
    who = texts.where("file % 4 <> 0").select(F.concat(F.lit("p"), F.col("file").cast("string")).alias("participant"))
    got = race_files.read_race(texts, who.union(who))
    return got.withColumnRenamed("at", "vertex").withColumns({c: rounded(c, 6) for c in ("lat", "lon", "cog", "sog", "tws", "twd_from")})


ORACLE["race_geojson"] = f"""WITH {S.FIXES}, x AS (SELECT *, track_id % 3 AS m, CASE WHEN track_id % 19 = 2 THEN 'not JSON' WHEN track_id % 4 = 0 THEN 'none' WHEN track_id % 17 = 3 THEN 'no line' WHEN track_id % 13 = 5 AND max(fix_idx) OVER (PARTITION BY track_id) >= 1 THEN 'no place and time' END AS problem FROM fixes)
SELECT track_id AS file, 'p' || track_id AS participant, CAST(fix_idx AS INTEGER) AS vertex, t, {rnd("lat")} AS lat, {rnd("lon")} AS lon, {rnd("cog")} AS cog, CASE WHEN m <> 2 THEN {rnd("sog")} END AS sog, CASE WHEN m = 1 THEN {rnd("tws")} END AS tws, CASE WHEN m = 1 THEN {rnd("twd_from")} END AS twd_from, CAST(NULL AS VARCHAR) AS problem FROM x WHERE problem IS NULL
UNION ALL SELECT DISTINCT track_id, NULL, NULL, NULL, CAST(NULL AS DOUBLE), NULL, NULL, NULL, NULL, NULL, problem FROM x WHERE problem <> 'none'"""

def _kml_texts(spark, sf_dir):
    """A file for some tracks each, a placemark a track; some with a time less, a time or place that is none, or cut short."""
    f = V.fixes(spark, sf_dir)
    when = "CASE WHEN track_id % 43 = 4 AND fix_idx = 0 THEN 'soon' ELSE date_format(timestamp_seconds(t), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END"
    coord = "concat(CASE WHEN track_id % 47 = 6 AND fix_idx = 0 THEN '400' ELSE CAST(lon + 200 AS STRING) END, ',', CAST(lat AS STRING), ',0')"
    lists = f.selectExpr("track_id", "fix_idx", f"CASE WHEN track_id % 41 = 5 AND fix_idx = 0 THEN '' ELSE concat('<when>', {when}, '</when>') END AS w", f"concat('<gx:coord>', {coord}, '</gx:coord>') AS c")
    marks = lists.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("fix_idx", "w", "c"))).alias("l"))
    one = F.concat(F.lit("<Placemark><name> Boat &amp; "), F.col("track_id").cast("string"), F.lit("</name><styleUrl>#s</styleUrl><gx:Track>"), F.array_join("l.w", ""), F.array_join("l.c", "\n"), F.lit("</gx:Track></Placemark>"))
    files = marks.select((F.col("track_id") % 60).alias("file"), F.struct("track_id", one.alias("m")).alias("m")).groupBy("file").agg(F.array_sort(F.collect_list("m")).alias("m"))
    end = F.when(F.col("file") % 17 == 3, "</Document>").otherwise("</Document></kml>")
    return files.select("file", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>'), F.array_join("m.m", ""), end).alias("text"))


def kml_tracks(spark, sf_dir):
    """KML files read, or what is wrong with them."""
    got = race_files.read_kml(_kml_texts(spark, sf_dir))
    return got.withColumns({c: rounded(c, 6) for c in ("lat", "lon")})


ORACLE["kml_tracks"] = f"""WITH {S.FIXES}, x AS (SELECT *, track_id % 60 AS file, dense_rank() OVER (PARTITION BY track_id % 60 ORDER BY track_id) - 1 AS pm, CASE WHEN track_id % 43 = 4 AND track_id % 41 <> 5 THEN 'no time' WHEN track_id % 47 = 6 THEN 'no place' WHEN track_id % 41 = 5 THEN 'times and places differ in number' END AS f FROM fixes),
p AS (SELECT file, CASE WHEN file % 17 = 3 THEN 'not XML' ELSE min_by(f, pm) FILTER (f IS NOT NULL) END AS problem FROM x GROUP BY file)
SELECT x.file, CAST(pm AS INTEGER) AS placemark, 'Boat & ' || track_id AS name, CAST(fix_idx AS INTEGER) AS k, t, {rnd("round(lat * " + d(100000) + ") / " + d(100000))} AS lat, {rnd(S.mod360("round((lon + " + d(200) + ") * " + d(100000) + ") / " + d(100000) + " + 180") + " - 180")} AS lon, CAST(NULL AS VARCHAR) AS problem FROM x JOIN p ON p.file = x.file WHERE p.problem IS NULL
UNION ALL SELECT file, NULL, NULL, NULL, NULL, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), problem FROM p WHERE problem IS NOT NULL"""

for _f in (race_assembly, race_geojson, kml_tracks):
    QUERIES[_f.__name__] = _f
