"""Certificates written as lists of JSON from table rows, and read back."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tackline.plans import views as V
from tackline.sources import certificates as reader

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

TWA, TWS = [52, 60, 75, 90, 110, 150], [6, 8, 10, 14, 20]
#: What is wrong with which certificate, by c_custkey modulo a number; the first that holds counts.
_FAULTS = [(19, 1, "no reference number"), (23, 2, "no allowances"), (29, 3, "WindSpeeds is not increasing"), (31, 4, "wrong length of R60"), (37, 5, "no time allowance in Beat"), (41, 6, "no boat speed in R75"), (43, 7, "not a number in GybeAngle"), (47, 8, "no list R110")]


def _seconds(a: int, s: int) -> str:
    return f"(120 + (c_custkey * 13 + {a} * 7 + {s} * 31) % 900)"


#: Certificates of one document.
PAGE = 2_000


def _documents(spark, sf_dir):
    """A nation's certificates in order of their keys, in lists of PAGE; one nation's is a single one, as it is cut short."""
    fault = lambda k: f"(c_custkey % {_FAULTS[k][0]} = {_FAULTS[k][1]})"
    row = lambda a, n=len(TWS): "concat('[', " + ", ',', ".join(f"CAST({_seconds(a, s)} AS STRING)" for s in TWS[:n]) + ", ']')"
    table = ", ".join(f"'\"R{a}\":', {f'CASE WHEN {fault(3)} THEN {row(a, 4)} ELSE {row(a)} END' if a == 60 else row(a).replace(_seconds(a, 8), f'CASE WHEN {fault(5)} THEN 1 ELSE {_seconds(a, 8)} END') if a == 75 else row(a)}, ','" for a in TWA if a != 110)
    last = f"CASE WHEN {fault(7)} THEN '' ELSE concat('\"R110\":', {row(110)}, ',') END"
    text = f"""concat('{{', CASE WHEN {fault(0)} THEN '' ELSE concat('"RefNo":"R', CAST(c_custkey AS STRING), '",') END, '"YachtName":"', c_name, '","Class":', to_json(named_struct('x', c_mktsegment)), ',"Allowances":',
 CASE WHEN {fault(1)} THEN 'null' ELSE concat('{{"WindAngles":[{",".join(map(str, TWA))}],"WindSpeeds":', CASE WHEN {fault(2)} THEN '[6,8,8,14,20]' ELSE '[{",".join(map(str, TWS))}]' END, ',', {table}, {last}, '"BeatAngle":[44.5,43,42,41.25,40],"Beat":', CASE WHEN {fault(4)} THEN '[600,500,"450",400,390]' ELSE {row(1)} END,
 ',"GybeAngle":', CASE WHEN {fault(6)} THEN '[140,145,150,null,170]' ELSE '[140,145,150,160,170]' END, ',"Run":', {row(2)}, '}}') END, '}}')"""
    c = V.table(spark, sf_dir, "customer").join(V.table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    # places are counted before texts are made
    c = c.select("c_custkey", "c_name", "c_mktsegment", "n_name", (F.row_number().over(Window.partitionBy("n_name").orderBy("c_custkey")) - 1).alias("at"))
    one = c.selectExpr("n_name AS country", f"CASE WHEN n_name IN ('CHINA', 'FRANCE') THEN 0 ELSE CAST(floor(at / {PAGE}) AS INT) END AS page", "c_custkey", f"{text} AS one")
    # a number of tasks of its own: texts shuffle small and are read long
    one = one.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "country", "page")
    listed = one.groupBy("country", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "one"))), lambda x: x["one"]), ",").alias("all"))
    # one document is cut short, and one has no list
    text = F.when(F.col("country") == "CHINA", F.concat(F.lit('{"rms":['), "all")).when(F.col("country") == "FRANCE", F.lit('{"certificates":[]}')).otherwise(F.concat(F.lit('﻿{"rms":['), "all", F.lit("]}")))
    return listed.select("country", F.lit(2025).alias("year"), (F.col("page") * PAGE).alias("first"), text.alias("text"))


_CUST = "c AS (SELECT c_custkey, c_name, n_name AS country, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) - 1 AS place, CASE " + " ".join(f"WHEN c_custkey % {m} = {r} THEN '{what}'" for m, r, what in sorted(_FAULTS, key=lambda f: ["no ref", "no allo", "WindSp", "wrong length of R60", "no boat", "no list R110", "no time", "not a"].index(next(p for p in ["no ref", "no allo", "WindSp", "wrong length of R60", "no boat", "no list R110", "no time", "not a"] if f[2].startswith(p))))) + " END AS problem FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT IN ('CHINA', 'FRANCE'))"
_AXES = f"a AS (SELECT unnest({TWA}) AS twa), s AS (SELECT unnest({TWS}) AS tws)"


def certificates_json(spark, sf_dir):
    """The speed tables of good certificates."""
    return reader.table_cells(reader.read(_documents(spark, sf_dir)))


ORACLE["certificates_json"] = f"WITH {_CUST}, {_AXES} SELECT 'R' || c_custkey AS ref_no, CAST(twa AS DOUBLE) AS twa, CAST(tws AS DOUBLE) AS tws, round(3600 / CAST(120 + (c_custkey * 13 + twa * 7 + tws * 31) % 900 AS DOUBLE), 2) AS bsp FROM c CROSS JOIN a CROSS JOIN s WHERE problem IS NULL"


def certificates_optimum(spark, sf_dir):
    """The best angles of good certificates."""
    return reader.optimum_points(reader.read(_documents(spark, sf_dir)))


_BEST = "b AS (SELECT * FROM (VALUES (6, 44.5, 140), (8, 43, 145), (10, 42, 150), (14, 41.25, 160), (20, 40, 170)) AS v(tws, up, down))"
ORACLE["certificates_optimum"] = f"WITH {_CUST}, {_BEST} SELECT 'R' || c_custkey AS ref_no, CAST(tws AS DOUBLE) AS tws, CAST(CASE WHEN k = 1 THEN up ELSE down END AS DOUBLE) AS twa, round(3600 / CAST(120 + (c_custkey * 13 + k * 7 + tws * 31) % 900 AS DOUBLE), 2) AS vmg, k = 1 AS upwind FROM c CROSS JOIN b CROSS JOIN (VALUES (1), (2)) AS q(k) WHERE problem IS NULL"


def certificate_problems(spark, sf_dir):
    """What is wrong with the others, and with whole documents."""
    return reader.read(_documents(spark, sf_dir)).where("problem is not null").select("country", "place", "ref_no", "problem")


ORACLE["certificate_problems"] = f"WITH {_CUST} SELECT country, CAST(place AS INTEGER) AS place, CASE WHEN c_custkey % 19 <> 1 THEN 'R' || c_custkey END AS ref_no, problem FROM c WHERE problem IS NOT NULL UNION ALL SELECT n_name, NULL, NULL, CASE WHEN n_name = 'CHINA' THEN 'not JSON' ELSE 'no list of certificates' END FROM nation WHERE n_name IN ('CHINA', 'FRANCE') AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey)"

for _f in (certificates_json, certificates_optimum, certificate_problems):
    QUERIES[_f.__name__] = _f
