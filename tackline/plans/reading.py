"""Queries that write table rows as files' texts and read them back, each beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from tackline.durable import shared_folder
from tackline.functions.canonical import rounded
from tackline.operators import polar, weather
from tackline.plans import sql as S
from tackline.plans import views as V
from tackline.plans.sql import d, rnd
from tackline.sources import polar_files, times, track_files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return register


def _r6(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: rounded(c, 6) for c in columns})


# ---- polar files

_SPEEDS = [4, 8, 12, 16, 20, 24]


@query("polar_files_read", f"WITH {S.NODES} SELECT concat('source-', source_id) AS path, twa, tws, {rnd(f'round(bsp * 100) / {d(100)}')} AS bsp FROM nodes")
def polar_files_read(spark, sf_dir):
    """Six files: tables split by tabs, semicolons (with decimal commas) and commas, and lines of pairs, one of them UTF-16."""
    nodes = polar.collect_points(V.polar_points(spark, sf_dir), ["source_id"])
    cents = F.round(F.col("bsp") * 100).cast("long")
    point = F.when(F.col("source_id") == 2, ",").otherwise(".")
    nodes = nodes.select("source_id", F.col("twa").cast("int").cast("string").alias("a"), F.col("twa").alias("order"), F.col("tws").cast("int").alias("s"), F.concat(F.floor(cents / 100).cast("string"), point, F.lpad((cents % 100).cast("string"), 2, "0")).alias("v"))
    sep = F.when(F.col("source_id") == 0, "\t").when(F.col("source_id") == 2, ";").otherwise(",")
    rows = nodes.where("source_id % 2 = 0").groupBy("source_id", "order", "a").agg(*[F.coalesce(F.max(F.when(F.col("s") == s, F.col("v"))), F.lit("")).alias(f"s{s}") for s in _SPEEDS])
    rows = rows.select("source_id", "order", F.array_join(F.array("a", *[f"s{s}" for s in _SPEEDS]), "|").alias("line"))
    head = rows.select("source_id").distinct().select("source_id", F.lit(-1.0).alias("order"), F.lit("|".join(["TWA/TWS", *map(str, _SPEEDS)])).alias("line"))
    tables = rows.unionByName(head).withColumn("line", F.replace("line", F.lit("|"), sep)).withColumn("end", F.lit("\n"))
    pairs = nodes.where("source_id % 2 = 1").groupBy("source_id", "s").agg(F.array_sort(F.collect_list(F.struct("order", "a", "v"))).alias("p"))
    pairs = pairs.select("source_id", F.col("s").cast("double").alias("order"), F.concat_ws("\t", F.col("s").cast("string"), F.flatten(F.transform("p", lambda x: F.array(x["a"], x["v"])))).alias("line"), F.lit("\r\n").alias("end"))
    texts = tables.unionByName(pairs).groupBy("source_id", "end").agg(F.array_sort(F.collect_list(F.struct("order", "line"))).alias("l"))
    text = F.array_join(F.col("l.line"), "|")
    text = F.concat(F.when(F.col("source_id") % 2 == 1, F.concat(F.lit("! a note"), F.col("end"))).otherwise(""), F.replace(text, F.lit("|"), F.col("end")))
    content = F.when(F.col("source_id") == 5, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).otherwise(F.encode(text, "UTF-8"))
    cells, _ = polar_files.polars_of(texts.select(F.concat(F.lit("source-"), F.col("source_id").cast("string")).alias("path"), content.alias("content")))
    return _r6(cells, "bsp")


#: (text of a file, line and name of what is wrong with it) by the remainder of a part's key.
_FAULTS = [
    ("twa;6;8|45;5.1;6.1", None, None),
    ("twa;6;8|45;-5.1;6.1", 2, "negative"),
    ("twa;6;8|45;5.1;66", 2, "too-fast"),
    ("twa;6;8|45;abc;6", 2, "not-a-number"),
    ("notes on a boat", 1, "unknown-format"),
    ("! only a note", None, "no-speeds"),
    ("! first|8 45 6 90", 2, "missing-bsp"),
    ("twa;6;8|400;5;", 2, "angle-out-of-range"),
    ("twa;6;8|45;5;6|60;5;6;7", 3, "too-many-cells"),
]
_FAULT_SQL = ", ".join(f"({k}, {'CAST(NULL AS INTEGER)' if line is None else line}, '{name}')" for k, (_, line, name) in enumerate(_FAULTS) if name)


@query("polar_file_problems", f"SELECT concat('part-', p_partkey) AS path, f.line, f.problem FROM part JOIN (VALUES {_FAULT_SQL}) AS f(k, line, problem) ON p_partkey % {len(_FAULTS)} = f.k")
def polar_file_problems(spark, sf_dir):
    texts = F.array(*[F.lit(t.replace("|", "\n")) for t, _, _ in _FAULTS])
    files = V.table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("path"), F.encode(F.get(texts, (F.col("p_partkey") % len(_FAULTS)).cast("int")), "UTF-8").alias("content"))
    return polar_files.polars_of(files)[1].select("path", "line", "problem")


# ---- track files


def _stamp(t, form: str = "yyyy-MM-dd'T'HH:mm:ss"):
    return F.date_format(F.timestamp_seconds(t), form)


@query(
    "times_read",
    f"""WITH {S.FIXES} SELECT e, CASE e % 8 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t - t % 60 WHEN 3 THEN t WHEN 4 THEN t WHEN 5 THEN t - t % 86400 END AS t,
t - t % 60 AS custom, t AS named FROM fixes""",
)
def times_read(spark, sf_dir):
    """Dates with zones, slashes, days alone, seconds, milliseconds and what is no time; a custom format; months by name."""
    t, k = F.col("t"), F.col("e") % 8
    written = (
        F.when(k == 0, F.concat(_stamp(t), F.lit("Z"))).when(k == 1, F.concat(_stamp(t + 7_200), F.lit("+02:00"))).when(k == 2, _stamp(t, "yyyy/M/d HH:mm")).when(k == 3, t.cast("string"))
        .when(k == 4, (t * 1000).cast("string")).when(k == 5, _stamp(t, "yyyy-MM-dd")).when(k == 6, "yesterday").otherwise("2024-13-01T00:00:00Z")
    )
    rows = V.fixes(spark, sf_dir).select("e", written.alias("x"), _stamp(t, "dd.MM.yy HH:mm").alias("y"), _stamp(t, "d MMMM yyyy HH:mm:ss").alias("z"))
    return rows.select("e", times.seconds("x").alias("t"), times.seconds("y", "%d.%m.%y %H:%M").alias("custom"), times.seconds("z", "%d %b %Y %H:%M:%S").alias("named"))


_FAR = S.wrap(f"lon + {d(180)}") + f" - {d(180)}"


@query(
    "csv_read",
    f"""WITH {S.FIXES}, x AS (SELECT *, CASE WHEN e % 19 = 0 THEN {d(95)} ELSE lat END AS la, CASE WHEN lon < 0 AND e % 2 = 1 THEN lon + 360 ELSE lon END AS far,
 CASE WHEN e % 23 = 0 THEN {d(500)} ELSE sog END * ({d(1000)} / {d(1852)}) AS kn, tws * ({d(3600)} / {d(1852)}) AS wind FROM fixes)
SELECT concat('Yawl "', track_id, '", grey') AS boat, CASE WHEN e % 17 <> 0 THEN t END AS t, {rnd("la")} AS lat, {rnd(_FAR.replace("lon", "far"))} AS lon, {rnd("cog")} AS cog, {rnd("CASE WHEN kn <= 100 THEN kn END")} AS sog, {rnd("wind")} AS tws, {rnd(S.wrap("twd_from"))} AS twd_from,
 CASE WHEN e % 17 = 0 THEN 'bad-time' WHEN la > 90 THEN 'bad-position' END AS problem FROM x""",
)
def csv_read(spark, sf_dir):
    """Every fix written as CSV, with units in the header, quotes in names and rows that are wrong, and read with a guessed mapping."""
    e = F.col("e")
    rows = V.fixes(spark, sf_dir).select(
        F.when(e % 17 == 0, "n/a").otherwise(F.concat(_stamp("t"), F.lit("Z"))).alias("Time"), F.when(e % 19 == 0, 95.0).otherwise(F.col("lat")).alias("Latitude"), F.when((F.col("lon") < 0) & (e % 2 == 1), F.col("lon") + 360).otherwise(F.col("lon")).alias("Longitude"),
        F.col("cog").alias("COG"), F.when(e % 23 == 0, 500.0).otherwise(F.col("sog")).alias("SOG (km/h)"), F.col("tws").alias("TWS [m/s]"), F.when(e % 3 == 0, F.col("twd_from") - 360.0).otherwise(F.col("twd_from")).alias("TWD"),
        F.concat(F.lit('Yawl "'), F.col("track_id").cast("string"), F.lit('", grey')).alias("Boat"),
    )
    path = f"{shared_folder(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    rows.write.csv(path, header=True, quote='"', escape='"')
    return _r6(track_files.read_csv(spark, path).drop("file"), "lat", "lon", "cog", "sog", "tws", "twd_from")


_NONE = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("cog", "sog", "tws", "twd_from"))


@query(
    "geojson_read",
    f"""WITH {S.FIXES}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, fix_idx) - 1 AS place FROM fixes)
SELECT CAST(track_id AS VARCHAR) AS file, 0 AS feature, 0 AS line, CAST(place AS INTEGER) AS "at", concat('Ketch ', track_id) AS boat, t, {rnd("lat")} AS lat, {rnd("lon")} AS lon, {d(90)} AS cog, {rnd("sog")} AS sog, CAST(NULL AS DOUBLE) AS tws, CAST(NULL AS DOUBLE) AS twd_from, CAST(NULL AS VARCHAR) AS problem FROM n
UNION ALL SELECT CAST(track_id AS VARCHAR), 2, 0, 0, NULL, t, {rnd("lat")}, {rnd("lon")}, NULL, NULL, {rnd("tws")}, {rnd("twd_from")}, NULL FROM n WHERE place = 0
UNION ALL SELECT CAST(track_id AS VARCHAR), 3, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'times-mismatch' FROM n WHERE place = 0 AND track_id % 3 = 0""",
)
def geojson_read(spark, sf_dir):
    """A collection a track: its line, a feature without a place, its first fix as a point, and a line whose times do not match."""
    fix = F.struct("t", "fix_idx", "lat", "lon", "sog", "tws", "twd_from")
    tracks = V.fixes(spark, sf_dir).groupBy("track_id").agg(F.array_sort(F.collect_list(fix)).alias("x"))
    first, text = F.get("x", F.lit(0)), lambda c: F.to_json(F.array(c) if isinstance(c, str) else c)
    places, stamps = F.to_json(F.transform("x", lambda p: F.array(p["lon"], p["lat"]))), F.to_json(F.transform("x", lambda p: F.concat(_stamp(p["t"]), F.lit("Z"))))
    feature = lambda kind, place, *properties: F.concat(F.lit('{"type":"Feature","geometry":{"type":"' + kind + '","coordinates":'), place, F.lit('},"properties":{'), *properties, F.lit("}}"))
    line = feature("LineString", places, F.lit('"Boat":"Ketch '), F.col("track_id").cast("string"), F.lit('","coordTimes":'), stamps, F.lit(',"COG":90,"SOG":'), text(F.col("x.sog")))
    point = feature("Point", F.to_json(F.array(first["lon"], first["lat"])), F.lit('"time":'), first["t"].cast("string"), F.lit(',"TWS":'), first["tws"].cast("string"), F.lit(',"WindDirection":'), first["twd_from"].cast("string"))
    short = feature("LineString", F.lit("[[1,2],[3,4]]"), F.lit('"times":[5]'))
    nowhere = F.lit('{"type":"Feature","geometry":null,"properties":{}}')
    features = F.concat_ws(",", line, nowhere, point, F.when(F.col("track_id") % 3 == 0, short))
    texts = tracks.select(F.col("track_id").cast("string").alias("file"), F.concat(F.lit('{"type":"FeatureCollection","features":['), features, F.lit("]}")).alias("text"))
    return _r6(track_files.read_geojson(texts), "lat", "lon", "cog", "sog", "tws", "twd_from")


@query("positions_binary", f"WITH {S.FIXES} SELECT concat('file-', track_id % 20) AS file, CAST(track_id AS BIGINT) AS team, t, {rnd(f'round(lat * 100000) / {d(100000)}', 5)} AS lat, {rnd(f'round(lon * 100000) / {d(100000)}', 5)} AS lon FROM fixes")
def positions_binary(spark, sf_dir):
    """Twenty files of teams, newest moment first, whole where the step back in time is too long for a delta.

    A file counts teams and a team's moments in 16 bits. Those that need more go on in further files, whose names tell
    what to add: "file-3/1" holds teams from 65,536 on, "file-3/0/1" moments from a team's 65,536th on.
    """
    reference, most = 1_700_000_000, 65_535
    w = Window.partitionBy("track_id").orderBy(F.desc("t"), F.desc("fix_idx"))
    e5 = lambda c: F.round(F.col(c) * 100_000).cast("long")
    rows = V.fixes(spark, sf_dir).select(F.col("track_id").cast("long").alias("track_id"), "t", "fix_idx", e5("lat").alias("la"), e5("lon").alias("lo"))
    rows = rows.withColumns({"k": F.row_number().over(w), "back": F.lag("t").over(w) - F.col("t"), "dla": F.col("la") - F.lag("la").over(w), "dlo": F.col("lo") - F.lag("lo").over(w)})
    rows = rows.withColumns({"high": F.floor(F.col("track_id") / (most + 1)).cast("long"), "part": F.floor((F.col("k") - 1) / most).cast("long")})
    digits = lambda x, n: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << 4 * n) - 1))), n, "0")
    small = F.coalesce((F.col("back") <= 32_767) & (F.abs("dla") <= 32_767) & (F.abs("dlo") <= 32_767), F.lit(False)) & ((F.col("k") - 1) % most != 0)
    moment = F.when(small, F.concat(digits(F.col("back") + 32_768, 4), digits(F.col("dla"), 4), digits(F.col("dlo"), 4))).otherwise(F.concat(digits(F.col("t") - reference, 8), digits(F.col("la"), 8), digits(F.col("lo"), 8)))
    teams = rows.withColumn("m", moment).groupBy("track_id", "high", "part").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("x"))
    team = F.concat(digits(F.col("track_id"), 4), digits(F.size("x").cast("long"), 4), F.array_join(F.col("x.m"), ""))
    further = F.when((F.col("high") != 0) | (F.col("part") != 0), F.concat(F.lit("/"), F.col("high").cast("string"), F.when(F.col("part") != 0, F.concat(F.lit("/"), F.col("part").cast("string"))).otherwise(""))).otherwise("")
    path = F.concat(F.lit("file-"), (F.col("track_id") % 20).cast("string"), further)
    files = teams.select(path.alias("path"), "track_id", team.alias("team")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("track_id", "team"))).alias("x"))
    content = F.unhex(F.concat(F.lit(f"00{reference:08X}"), F.array_join(F.col("x.team"), "")))
    got = track_files.resolved(track_files.binary_moments(files.select("path", content.alias("content"))))
    names = F.split("file", "/")
    high = F.coalesce(F.get(names, F.lit(1)).cast("long"), F.lit(0))
    return got.select(F.get(names, F.lit(0)).alias("file"), (F.col("team") + high * (most + 1)).alias("team"), "t", *[rounded(c, 5).alias(c) for c in ("lat", "lon")])


# ---- weather parts


@query("vector_sum", f"WITH {S.FIXES} SELECT e AS point_id, {rnd('current_speed + hs_m + wave_period_s')} AS value FROM fixes WHERE current_speed IS NOT NULL AND hs_m IS NOT NULL")
def vector_sum(spark, sf_dir):
    names = ["current_speed", "hs_m", "wave_period_s"]
    parts = V.fixes(spark, sf_dir).select(F.col("e").alias("point_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("var"), F.col(n).alias("value")) for n in names])).alias("p")).select("point_id", "p.*").where("value is not null")
    return _r6(weather.vector_sum(parts, names), "value")
