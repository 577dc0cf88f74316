"""Named queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tackline.durable import checkpointed
from tackline.functions import sailing
from tackline.functions.canonical import degrees, knots, rounded
from tackline.functions.geo import distance_m
from tackline.functions.text import compact, fold, joined_words, model_key
from tackline.operators import blend, catalogue, compare, export, filters, polar, tracks, weather
from tackline.plans import archives, certificates, racing, reading, searching, tools
from tackline.plans import sql as S
from tackline.plans import views as V
from tackline.plans.sql import bucket_sql, d, rnd

QUERIES: dict = {**reading.QUERIES, **tools.QUERIES, **searching.QUERIES, **archives.QUERIES, **certificates.QUERIES, **racing.QUERIES}
ORACLE: dict[str, str] = {**reading.ORACLE, **tools.ORACLE, **searching.ORACLE, **archives.ORACLE, **certificates.ORACLE, **racing.ORACLE}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def _r6(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: rounded(c, 6) for c in columns})


# ---- tracks


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes at quarter days, so that many share a time."""
    return V.fixes(spark, sf_dir).withColumn("t", F.col("t") - F.pmod(F.col("t"), F.lit(21_600)))


_COARSE = S.FIXES + ", coarse AS (SELECT track_id, fix_idx, t - t % 21600 AS t, lat, lon, cog, sog, CASE WHEN e % 3 <> 0 THEN tws END AS tws, CASE WHEN e % 5 <> 1 THEN twd_from END AS twd_from FROM fixes)"


@query(
    "fix_normalise_merge",
    f"""WITH {_COARSE}, k AS (SELECT *, row_number() OVER (PARTITION BY track_id, t ORDER BY fix_idx) AS rn, row_number() OVER (PARTITION BY track_id, t ORDER BY CASE WHEN cog IS NULL THEN 1 ELSE 0 END, fix_idx) AS rc,
 row_number() OVER (PARTITION BY track_id, t ORDER BY CASE WHEN sog IS NULL THEN 1 ELSE 0 END, fix_idx) AS rs, row_number() OVER (PARTITION BY track_id, t ORDER BY CASE WHEN tws IS NULL OR twd_from IS NULL THEN 1 ELSE 0 END, fix_idx) AS rw FROM coarse)
SELECT track_id, t, max(CASE WHEN rn = 1 THEN fix_idx END) AS fix_idx, {rnd("max(CASE WHEN rn = 1 THEN lat END)")} AS lat, {rnd("max(CASE WHEN rn = 1 THEN lon END)")} AS lon, max(CASE WHEN rc = 1 THEN cog END) AS cog, max(CASE WHEN rs = 1 THEN sog END) AS sog,
 max(CASE WHEN rw = 1 THEN tws END) AS tws, max(CASE WHEN rw = 1 THEN twd_from END) AS twd_from FROM k GROUP BY track_id, t""",
)
def fix_normalise_merge(spark, sf_dir):
    rows = _coarse(spark, sf_dir).withColumns({"tws": F.when(F.col("e") % 3 != 0, F.col("tws")), "twd_from": F.when(F.col("e") % 5 != 1, F.col("twd_from"))})
    return _r6(tracks.normalise(rows), "lat", "lon")


@query(
    "import_report",
    f"""WITH {_COARSE}, f AS (SELECT *, CASE WHEN fix_idx % 10 = 3 THEN t - 500000 ELSE t END AS u FROM coarse), b AS (SELECT *, lag(u) OVER (PARTITION BY track_id ORDER BY fix_idx) AS pu FROM f)
SELECT track_id, count(*) AS fixes, count(*) - count(DISTINCT u) AS duplicates, CAST(sum(CASE WHEN u < pu THEN 1 ELSE 0 END) AS BIGINT) AS out_of_order, count(cog) AS given_headings, count(sog) AS given_speeds,
 CAST(sum(CASE WHEN tws IS NOT NULL AND twd_from IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS wind_pairs FROM b GROUP BY track_id""",
)
def import_report(spark, sf_dir):
    rows = _coarse(spark, sf_dir).withColumns({"tws": F.when(F.col("e") % 3 != 0, F.col("tws")), "twd_from": F.when(F.col("e") % 5 != 1, F.col("twd_from")), "t": F.when(F.col("fix_idx") % 10 == 3, F.col("t") - 500_000).otherwise(F.col("t"))})
    return tracks.import_report(rows)


@query("motion_derive", f"WITH {S.MOTIONS} SELECT track_id, t, {rnd('heading')} AS heading, heading_origin, {rnd('speed')} AS speed, speed_origin FROM motions")
def motion_derive(spark, sf_dir):
    return _r6(V.motions(spark, sf_dir), "heading", "speed").select("track_id", "t", "heading", "heading_origin", "speed", "speed_origin")


@query("relate_ground", f"WITH {S.SAMPLES} SELECT track_id, t, {rnd('twa')} AS twa, tack, {rnd('wind_speed')} AS wind_speed, {rnd('wave_angle')} AS wave_angle FROM samples")
def relate_ground(spark, sf_dir):
    return _r6(V.samples(spark, sf_dir), "twa", "wind_speed", "wave_angle").select("track_id", "t", "twa", "tack", "wind_speed", "wave_angle")


_CORRECTED = ["bsp_corrected", "heading_corrected", "tws_corrected", "twd_from_corrected", "twa_corrected"]


@query("relate_corrected", f"WITH {S.SAMPLES} SELECT track_id, t, {', '.join(f'{rnd(c)} AS {c}' for c in _CORRECTED)}, tack_corrected FROM samples WHERE current_speed IS NOT NULL")
def relate_corrected(spark, sf_dir):
    return _r6(V.samples(spark, sf_dir), *_CORRECTED).where("current_speed IS NOT NULL").select("track_id", "t", *_CORRECTED, "tack_corrected")


_AE, _AN = "(wind_speed * sin(radians(wind_from - heading)))", "(wind_speed * cos(radians(wind_from - heading)) + speed)"
_AWA = f"(CASE WHEN {S.hypot(_AE, _AN)} > {d('0.000000001')} THEN {rnd(S.mod360(f'degrees(atan2({_AE}, {_AN})) + heading - coalesce(heading_corrected, heading)'), 9)} END)"


@query("apparent_wind", f"WITH {S.SAMPLES} SELECT track_id, t, {rnd(_AWA)} AS awa FROM samples")
def apparent_wind(spark, sf_dir):
    return V.samples(spark, sf_dir).select("track_id", "t", rounded(sailing.apparent_wind_angle(True), 6).alias("awa"))


_HOUR = f"(((((t % 86400) + 86400) % 86400 + lon * {d(240)}) % {d(86400)} + {d(86400)}) % {d(86400)} / {d(3600)})"


@query("day_band_counts", f"WITH {S.FIXES}, h AS (SELECT {_HOUR} AS h FROM fixes) SELECT CASE WHEN h >= 21 OR h < 5 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 17 THEN 'afternoon' ELSE 'evening' END AS band, count(*) AS n FROM h GROUP BY 1")
def day_band_counts(spark, sf_dir):
    return V.fixes(spark, sf_dir).groupBy(sailing.day_band("t", "lon").alias("band")).agg(F.count("*").alias("n"))


@query("leg_distance", f"WITH {S.FIXES}, l AS (SELECT track_id, {S.dist('lat', 'lon', 'lead(lat) OVER (PARTITION BY track_id ORDER BY t, fix_idx)', 'lead(lon) OVER (PARTITION BY track_id ORDER BY t, fix_idx)')} AS m FROM fixes) SELECT track_id, count(m) AS legs, {rnd('sum(m) / 1852', 3)} AS miles FROM l GROUP BY track_id")
def leg_distance(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("track_id").orderBy("t", "fix_idx")
    rows = V.fixes(spark, sf_dir).withColumn("m", distance_m("lat", "lon", F.lead("lat").over(w), F.lead("lon").over(w)))
    return rows.groupBy("track_id").agg(F.count("m").alias("legs"), rounded(F.sum("m") / 1852.0, 3).alias("miles"))


@query(
    "lon_unwrap",
    f"""WITH {S.FIXES}, p AS (SELECT track_id, fix_idx, t, ((fix_idx * 97 + track_id * 31) % 360) - {d(180)} AS lon FROM fixes), s AS (SELECT *, lon - lag(lon) OVER (PARTITION BY track_id ORDER BY t, fix_idx) AS step FROM p)
SELECT track_id, fix_idx, {rnd(f"sum(coalesce(step - {d(360)} * floor((step + {d(180)}) / {d(360)}), lon)) OVER (PARTITION BY track_id ORDER BY t, fix_idx ROWS UNBOUNDED PRECEDING)")} AS line_lon FROM s""",
)
def lon_unwrap(spark, sf_dir):
    rows = V.fixes(spark, sf_dir).withColumn("lon", F.expr("((fix_idx * 97 + track_id * 31) % 360) - 180D"))
    return _r6(tracks.unwrapped_longitude(rows), "line_lon").select("track_id", "fix_idx", "line_lon")


@query(
    "preview_downsample",
    f"""WITH {S.FIXES}, k AS (SELECT track_id, lat, lon, row_number() OVER (PARTITION BY track_id ORDER BY t, fix_idx) - 1 AS k, count(*) OVER (PARTITION BY track_id) AS n FROM fixes), m AS (SELECT *, CASE WHEN n < 16 THEN n ELSE 16 END AS m FROM k),
w AS (SELECT DISTINCT track_id, n, m, i FROM m CROSS JOIN (SELECT CAST(range AS BIGINT) AS i FROM range(16)) r WHERE i < m)
SELECT w.track_id, w.i AS position, round(m.lat * {d(10000)}) AS lat_e4, round(m.lon * {d(10000)}) AS lon_e4 FROM w JOIN m ON m.track_id = w.track_id AND m.k = (w.i * (w.n - 1)) // greatest(w.m - 1, 1)""",
)
def preview_downsample(spark, sf_dir):
    return tracks.preview(V.fixes(spark, sf_dir), 16)


# ---- filters


def _kept(f: filters.SampleFilters, corrected: bool = True):
    def run(spark, sf_dir):
        return filters.mark(V.samples_for_neighbours(spark, sf_dir), f, corrected, V.MAX_GAP_S, V.chunk_s(spark, sf_dir)).where("not filtered").select("track_id", "t", "fix_idx")

    return run


def _kept_sql(where: str, more: str = "", source: str = "samples") -> str:
    return f"WITH {S.SAMPLES}{more} SELECT track_id, t, fix_idx FROM {source} WHERE {where}"


_BW = "OVER (PARTITION BY track_id ORDER BY t, fix_idx)"


def _change_sql(metrics: dict[str, tuple[str, bool, float]]) -> tuple[str, str]:
    """CTEs that add a flag for each metric, and the condition that none is set."""
    cols = ", ".join(f"{x} AS m_{k}" for k, (x, _, _) in metrics.items())
    pairs = ", ".join(f"lag(m_{k}) {_BW} AS l_{k}" for k in metrics)
    far = " OR ".join(f"({_gap(k, circular)} > {d(limit)})" for k, (_, circular, limit) in metrics.items())
    more = f", c0 AS (SELECT *, {cols} FROM samples), c1 AS (SELECT *, {pairs}, lag(t) {_BW} AS l_t FROM c0), c2 AS (SELECT *, CASE WHEN t - l_t <= {V.MAX_GAP_S} AND ({far}) THEN 1 ELSE 0 END AS f FROM c1), c3 AS (SELECT *, coalesce(lead(f) {_BW}, 0) AS g FROM c2)"
    return more, "f = 0 AND g = 0"


def _gap(k: str, circular: bool) -> str:
    x = f"abs(m_{k} - l_{k})"
    return f"least({x}, {d(360)} - {x})" if circular else x


_H = "coalesce(heading_corrected, heading)"
_MORE, _STEADY = _change_sql({"h": (_H, True, 30)})
_FAST = "coalesce(bsp_corrected, speed) >= 1"
QUERIES["filter_default"] = _kept(filters.SampleFilters())
ORACLE["filter_default"] = _kept_sql(f"{_FAST} AND {_STEADY}", _MORE, "c3")
_MORE4, _STEADY4 = _change_sql({"h": (_H, True, 120), "a": (_AWA, True, 120), "s": ("coalesce(tws_corrected, wind_speed)", False, 15), "d": ("coalesce(twd_from_corrected, wind_from)", True, 120)})
QUERIES["filter_change_all"] = _kept(filters.SampleFilters(min_bsp_kn=None, max_heading_change_deg=120.0, max_awa_change_deg=120.0, max_wind_speed_change_kn=15.0, max_wind_direction_change_deg=120.0))
ORACLE["filter_change_all"] = _kept_sql(_STEADY4, _MORE4, "c3")

_NONE = {"min_bsp_kn": None, "max_heading_change_deg": None}
QUERIES["filter_ranges"] = _kept(filters.SampleFilters(**_NONE, max_bsp_kn=18.0, tws_kn=(5.0, 25.0), twa_deg=(20.0, None), wave_height_m=(None, 5.0), heading_deg=(300.0, 200.0), twd_deg=(10.0, 350.0), vmg_kn=(-12.0, 12.0)))
_PTWA = f"CASE WHEN {S._WATER} THEN twa_corrected WHEN {S._GROUND} THEN twa END"
_PTWS = f"CASE WHEN {S._WATER} THEN tws_corrected WHEN {S._GROUND} THEN wind_speed END"
_PBSP = f"CASE WHEN {S._WATER} THEN bsp_corrected WHEN {S._GROUND} THEN speed END"
ORACLE["filter_ranges"] = _kept_sql(
    f"coalesce(bsp_corrected, speed) <= 18 AND coalesce({_PTWS}, wind_speed) BETWEEN 5 AND 25 AND coalesce({_PTWA}, twa) >= 20 AND hs_m <= 5 AND {S.wrap(f'{_H} - {d(300)}')} <= {S.wrap(d(-100))} AND {S.wrap(f'coalesce(twd_from_corrected, wind_from) - {d(10)}')} <= 340 AND ({_PBSP}) * cos(radians({_PTWA})) BETWEEN -12 AND 12"
)
QUERIES["filter_wave_dirs"] = _kept(filters.SampleFilters(**_NONE, wave_sectors=("bow", "beam"), wave_absolute=(200.0, 100.0), wave_cog=(20.0, 150.0)))
ORACLE["filter_wave_dirs"] = _kept_sql(f"wave_angle >= 30 AND wave_angle < 120 AND {S.wrap(f'wave_from - {d(200)}')} <= 260 AND {S.off('heading', 'wave_from')} BETWEEN 20 AND 150")
QUERIES["filter_unknowns"] = _kept(filters.SampleFilters(**_NONE, exclude_unknown_wave=True, exclude_unknown_current=True, current_speed_kn=(0.5, None)))
ORACLE["filter_unknowns"] = _kept_sql("hs_m IS NOT NULL AND wave_from IS NOT NULL AND current_speed IS NOT NULL AND current_toward IS NOT NULL AND current_speed >= 0.5")
QUERIES["filter_time_window"] = _kept(filters.SampleFilters(**_NONE, time_window=(1_704_500_000, 1_706_000_000)))
ORACLE["filter_time_window"] = _kept_sql("t >= 1704500000 AND t <= 1706000000")
QUERIES["filter_tacks"] = _kept(filters.SampleFilters(**_NONE, exclude_tacks=True))
_SIDE = "CASE WHEN twa_corrected IS NOT NULL THEN tack_corrected ELSE tack END"
ORACLE["filter_tacks"] = f"""WITH {S.SAMPLES}, k0 AS (SELECT *, {_SIDE} AS side, {_PTWA} AS place FROM samples), k1 AS (SELECT *, sum(CASE WHEN side IS NULL AND place IS NULL THEN 1 ELSE 0 END) {_BW} AS part FROM k0),
sided AS (SELECT *, lag(side) OVER (PARTITION BY track_id, part ORDER BY t, fix_idx) AS ps, lag(t) OVER (PARTITION BY track_id, part ORDER BY t, fix_idx) AS pt, lead(side) OVER (PARTITION BY track_id, part ORDER BY t, fix_idx) AS ns, lead(t) OVER (PARTITION BY track_id, part ORDER BY t, fix_idx) AS nt FROM k1 WHERE side IS NOT NULL),
hit AS (SELECT track_id, t, fix_idx FROM sided WHERE (ps <> side AND t - pt <= {V.MAX_GAP_S}) OR (ns <> side AND nt - t <= {V.MAX_GAP_S}))
SELECT s.track_id, s.t, s.fix_idx FROM samples s WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.track_id = s.track_id AND h.fix_idx = s.fix_idx)"""


@query("wave_ranges", f"WITH {S.SAMPLES} SELECT track_id, t, fix_idx FROM samples WHERE CAST(hs_m AS FLOAT) >= CAST({d(0.7)} AS FLOAT) AND CAST({S.off('wave_from', _H)} AS FLOAT) <= CAST({d(150)} AS FLOAT) AND CAST(wave_period_s AS FLOAT) >= CAST({d(3.3)} AS FLOAT)")
def wave_ranges(spark, sf_dir):
    return V.samples(spark, sf_dir).where(~filters.wave_ranges_exclude((0.7, None), (None, 150.0), (3.3, None), True)).select("track_id", "t", "fix_idx")


@query("exclude_samples", f"WITH {S.SAMPLES} SELECT track_id, t, fix_idx FROM samples s WHERE NOT EXISTS (SELECT 1 FROM fixes f WHERE f.event_type = 'purchase' AND f.track_id = s.track_id AND f.fix_idx = s.fix_idx)")
def exclude_samples(spark, sf_dir):
    gone = V.fixes(spark, sf_dir).where("event_type = 'purchase'")
    return filters.without(V.samples(spark, sf_dir), gone, ["track_id", "fix_idx"]).select("track_id", "t", "fix_idx")


@query("filter_no_tide", f"WITH {S.SAMPLES} SELECT current_dataset, count(*) AS n FROM samples WHERE current_dataset NOT IN (1, 4) GROUP BY 1")
def filter_no_tide(spark, sf_dir):
    datasets = spark.createDataFrame([(0, True), (1, False), (2, None), (3, True), (4, False)], "dataset int, has_tide boolean")
    return filters.without_tide(V.samples(spark, sf_dir), datasets).where("not no_tide").groupBy("current_dataset").agg(F.count("*").alias("n"))


# ---- segments


def _segment(statistic: str):
    def run(spark, sf_dir):
        return polar.segment(V.points(spark, sf_dir), V.TWA, V.TWS, statistic, 5).withColumnRenamed("n", "samples")

    return run


for _name, _agg in (("p90", "quantile_cont(bsp, 0.9)"), ("p75", "quantile_cont(bsp, 0.75)"), ("median", "quantile_cont(bsp, 0.5)"), ("mean", "avg(bsp)")):
    QUERIES[f"segment_{_name}"] = _segment(_name)
    ORACLE[f"segment_{_name}"] = f"WITH {S.BINNED} SELECT i, j, count(*) AS samples, {rnd('stddev_samp(bsp)')} AS spread, CASE WHEN count(*) >= 5 THEN {rnd(_agg)} END AS bsp FROM binned GROUP BY i, j"


@query("segment_by_track", f"WITH {S.BINNED} SELECT track_id, i, j, count(*) AS n, {rnd('stddev_samp(bsp)')} AS spread, CASE WHEN count(*) >= 2 THEN {rnd('quantile_cont(bsp, 0.9)')} END AS bsp FROM binned GROUP BY track_id, i, j")
def segment_by_track(spark, sf_dir):
    return polar.segment(V.points(spark, sf_dir), V.TWA, V.TWS, "p90", 2, ("track_id",))


@query("segment_asymmetric", f"WITH {S.PLACED}, a AS (SELECT CASE WHEN {_SIDE} = 'port' THEN {d(360)} - p_twa ELSE p_twa END AS a, p_tws, p_bsp FROM placed WHERE p_twa IS NOT NULL), b AS (SELECT {S.bin_sql('a', [30.0 * k for k in range(13)])} AS i, {S.bin_sql('p_tws', V.TWS)} AS j, p_bsp AS bsp FROM a) SELECT i, j, count(*) AS n, {rnd('stddev_samp(bsp)')} AS spread, CASE WHEN count(*) >= 5 THEN {rnd('avg(bsp)')} END AS bsp FROM b WHERE i NOT IN (0, 12) AND j IS NOT NULL GROUP BY i, j")
def segment_asymmetric(spark, sf_dir):
    side = F.when(F.col("twa_corrected").isNotNull(), F.col("tack_corrected")).otherwise(F.col("tack"))
    rows = V.placed(spark, sf_dir).select(F.when(side == "port", 360.0 - F.col("p_twa")).otherwise(F.col("p_twa")).alias("twa"), F.col("p_tws").alias("tws"), F.col("p_bsp").alias("bsp"))
    return polar.segment(rows, [30.0 * k for k in range(13)], V.TWS, "mean", 5)


@query(
    "priority_groups",
    f"""WITH {S.BINNED}, g AS (SELECT i, j, 0 AS grp FROM binned WHERE hs_m <= 1.5 UNION ALL SELECT i, j, 1 FROM binned WHERE hs_m <= 3 UNION ALL SELECT i, j, 2 FROM binned), n AS (SELECT i, j, grp FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30), c AS (SELECT i, j, min(grp) AS grp FROM n GROUP BY 1, 2)
SELECT c.i, c.j, c.grp, count(*) AS n, {rnd("quantile_cont(b.bsp, 0.9)")} AS bsp FROM c JOIN binned b ON b.i = c.i AND b.j = c.j AND ((c.grp = 0 AND b.hs_m <= 1.5) OR (c.grp = 1 AND b.hs_m <= 3) OR c.grp = 2) GROUP BY 1, 2, 3""",
)
def priority_groups(spark, sf_dir):
    return polar.priority_segment(V.points(spark, sf_dir), V.TWA, V.TWS, [F.col("hs_m") <= 1.5, F.col("hs_m") <= 3.0, F.lit(True)], 30).drop("spread")


@query("wave_split_segments", f"WITH {S.BINNED}, w AS (SELECT *, {bucket_sql(8)} AS bucket FROM binned) SELECT bucket, i, j, count(*) AS n, {rnd('stddev_samp(bsp)')} AS spread, CASE WHEN count(*) >= 3 THEN {rnd('quantile_cont(bsp, 0.9)')} END AS bsp FROM w WHERE bucket IS NOT NULL GROUP BY bucket, i, j")
def wave_split_segments(spark, sf_dir):
    bucket = sailing.wave_bucket(8, "from", F.coalesce("heading_corrected", "heading"))
    return polar.segment(V.points(spark, sf_dir).withColumn("bucket", bucket).where("bucket is not null"), V.TWA, V.TWS, "p90", 3, ("bucket",))


# ---- polars


def _nodes(spark, sf_dir):
    return polar.collect_points(V.polar_points(spark, sf_dir), ["source_id"])


@query("polar_collect", f"WITH {S.NODES} SELECT * FROM nodes")
def polar_collect(spark, sf_dir):
    return _nodes(spark, sf_dir)


@query("polar_resample_ragged", f"WITH {S.NODES}, {S.READ} SELECT source_id, i, j, {rnd('bsp')} AS bsp FROM read")
def polar_resample_ragged(spark, sf_dir):
    return _r6(polar.resample(_nodes(spark, sf_dir), V.TWA, V.TWS), "bsp")


@query(
    "polar_on_grid_excluded",
    f"""WITH {S.NODES}, {S.READ}, gone AS (SELECT source_id, twa, tws FROM nodes WHERE (CAST(twa AS BIGINT) + CAST(tws AS BIGINT) * 2 + source_id) % 7 = 0),
bad AS (SELECT DISTINCT c.source_id, c.i, c.j FROM cread c JOIN gone g ON g.source_id = c.source_id AND g.tws = c.c AND (g.twa = c.a0 OR g.twa = c.a1))
SELECT r.source_id, r.i, r.j, {rnd("r.bsp")} AS bsp FROM read r WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.source_id = r.source_id AND b.i = r.i AND b.j = r.j)""",
)
def polar_on_grid_excluded(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    gone = nodes.where("(CAST(twa AS BIGINT) + CAST(tws AS BIGINT) * 2 + source_id) % 7 = 0")
    return _r6(polar.resample(nodes, V.TWA, V.TWS, gone), "bsp")


_SIDES = "full_nodes AS (SELECT source_id, CASE WHEN source_id % 2 = 0 AND CAST(twa AS BIGINT) % 2 = 0 THEN 360 - twa ELSE twa END AS twa, tws, bsp FROM nodes), circle AS (SELECT source_id, max(twa) > 180 AS is_full FROM full_nodes GROUP BY 1)"


def _sided(spark, sf_dir):
    return _nodes(spark, sf_dir).withColumn("twa", F.when((F.col("source_id") % 2 == 0) & (F.col("twa").cast("long") % 2 == 0), 360.0 - F.col("twa")).otherwise(F.col("twa")))


@query(
    "polar_directional_half",
    f"WITH {S.NODES}, {_SIDES} SELECT n.source_id, CASE WHEN c.is_full AND n.twa > 180 THEN 360 - n.twa ELSE n.twa END AS twa, n.tws, {rnd('avg(n.bsp)')} AS bsp FROM full_nodes n JOIN circle c ON c.source_id = n.source_id GROUP BY 1, 2, 3",
)
def polar_directional_half(spark, sf_dir):
    return _r6(polar.directional(_sided(spark, sf_dir), False), "bsp")


@query(
    "polar_directional_full",
    f"""WITH {S.NODES}, {_SIDES} SELECT n.source_id, n.twa, n.tws, {rnd("n.bsp")} AS bsp FROM full_nodes n
UNION ALL SELECT n.source_id, 360 - n.twa, n.tws, {rnd("n.bsp")} FROM full_nodes n JOIN circle c ON c.source_id = n.source_id WHERE NOT c.is_full AND n.twa <> 180""",
)
def polar_directional_full(spark, sf_dir):
    return _r6(polar.directional(_sided(spark, sf_dir), True), "bsp")


@query("polar_overrides", f"WITH {S.NODES} SELECT source_id, twa, tws, CASE WHEN (CAST(twa AS BIGINT) + source_id * 15) % 4 = 0 THEN {rnd('twa / 20')} ELSE bsp END AS bsp FROM nodes")
def polar_overrides(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    edits = nodes.where("(CAST(twa AS BIGINT) + source_id * 15) % 4 = 0").withColumn("bsp", rounded(F.col("twa") / 20.0, 6)).union(nodes.sparkSession.createDataFrame([(0, 33.3, 8.0, 9.0)], "source_id long, twa double, tws double, bsp double"))
    return polar.overridden(nodes, edits)


@query("polar_scaled", f"WITH {S.NODES} SELECT source_id, twa, tws, {rnd('least(greatest(bsp * (1 + 900 / ' + d(100) + '), 0), 60)')} AS bsp FROM nodes")
def polar_scaled(spark, sf_dir):
    return _r6(polar.scaled(_nodes(spark, sf_dir), 900.0), "bsp")


@query(
    "vpp_to_polar",
    f"""WITH {S.NODES}, t AS (SELECT source_id, twa, tws, bsp FROM nodes WHERE twa <= 180), o AS (SELECT DISTINCT source_id, tws, {d(39)} + source_id AS twa, {d(3)} + tws / 4 AS vmg, 1 AS up FROM nodes UNION SELECT DISTINCT source_id, tws, {d(150)}, {d(2)} + tws / 4, 0 FROM nodes),
p AS (SELECT source_id, twa, tws, vmg / (CASE WHEN up = 1 THEN cos(radians(twa)) ELSE -cos(radians(twa)) END) AS bsp FROM o)
SELECT source_id, twa, tws, {rnd("bsp")} AS bsp FROM t UNION ALL SELECT p.source_id, p.twa, p.tws, {rnd("p.bsp")} FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.source_id = p.source_id AND t.twa = p.twa AND t.tws = p.tws)""",
)
def vpp_to_polar(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    speeds = nodes.select("source_id", "tws").distinct()
    beat = speeds.select("source_id", "tws", (39.0 + F.col("source_id")).alias("twa"), (3.0 + F.col("tws") / 4).alias("vmg"), F.lit(True).alias("upwind"))
    run = speeds.select("source_id", "tws", F.lit(150.0).alias("twa"), (2.0 + F.col("tws") / 4).alias("vmg"), F.lit(False).alias("upwind"))
    return _r6(polar.vpp_to_cells(nodes, beat.union(run)), "bsp")


def _end_slope(ha: str, hb: str, da: str, db: str) -> str:
    m = f"(((2 * {ha} + {hb}) * {da} - {ha} * {db}) / ({ha} + {hb}))"
    return f"(CASE WHEN {db} IS NULL THEN {da} WHEN {m} * {da} <= 0 THEN 0 WHEN {da} * {db} <= 0 AND abs({m}) > 3 * abs({da}) THEN 3 * {da} ELSE {m} END)"


def _curve_sql(p: str, nodes: str, keys: str, x: str, y: str, asked: str) -> str:
    """``p``_read: the rows of ``asked`` (keys, x and more) that lie on a curve through the nodes of their keys, with its value v there."""
    along, same = f"OVER (PARTITION BY {keys} ORDER BY {x})", " AND ".join(f"q.{k} = c.{k}" for k in keys.split(", "))
    return f"""{p}0 AS (SELECT *, lead({x}) {along} AS x1, lead({y}) {along} AS y1 FROM {nodes}), {p}1 AS (SELECT *, x1 - {x} AS h, (y1 - {y}) / (x1 - {x}) AS d FROM {p}0),
{p}2 AS (SELECT *, lag(h) {along} AS h0, lag(d) {along} AS d0, lag(h, 2) {along} AS h00, lag(d, 2) {along} AS d00, lead(h) {along} AS h1, lead(d) {along} AS d1 FROM {p}1),
{p}3 AS (SELECT *, CASE WHEN h IS NULL AND h0 IS NULL THEN 0 WHEN h0 IS NULL THEN {_end_slope("h", "h1", "d", "d1")} WHEN h IS NULL THEN {_end_slope("h0", "h00", "d0", "d00")} WHEN d0 * d <= 0 THEN 0 ELSE 3 * (h + h0) / ((2 * h + h0) / d0 + (h + 2 * h0) / d) END AS m FROM {p}2),
{p}4 AS (SELECT *, lead(m) {along} AS m1 FROM {p}3),
{p}5 AS (SELECT q.*, c.{y} AS y0, c.y1, c.h, c.m, c.m1, (q.{x} - c.{x}) / c.h AS u FROM {p}4 c JOIN {asked} q ON {same} AND (q.{x} = c.{x} OR (q.{x} > c.{x} AND q.{x} < c.x1))),
{p}_read AS (SELECT *, CASE WHEN u IS NULL OR u = 0 THEN y0 ELSE greatest(least(y0 + u * h * m + u * u * (3 * (y1 - y0) - h * (2 * m + m1)) + u * u * u * (2 * (y0 - y1) + h * (m + m1)), greatest(y0, y1)), least(y0, y1)) END AS v FROM {p}5)"""


_COLUMNS_ASKED = "asked AS (SELECT n.source_id, n.tws, g.i, g.twa FROM (SELECT DISTINCT source_id, tws FROM nodes) n CROSS JOIN axis_i g)"


@query("pchip_resample", f"WITH {S.NODES}, {S.GRID}, {_COLUMNS_ASKED}, {_curve_sql('c', 'nodes', 'source_id, tws', 'twa', 'bsp', 'asked')} SELECT source_id, tws, i, {rnd('v')} AS bsp FROM c_read")
def pchip_resample(spark, sf_dir):
    return _r6(polar.pchip(_nodes(spark, sf_dir), V.TWA), "bsp")


_CUBIC = f"""{S.NODES}, {S.READ}, {_COLUMNS_ASKED}, {_curve_sql("c", "nodes", "source_id, tws", "twa", "bsp", "asked")},
cells1 AS (SELECT source_id, i, tws, v AS bsp FROM c_read), asked1 AS (SELECT r.source_id, r.i, r.j, g.tws FROM read r JOIN axis_j g ON g.j = r.j), {_curve_sql("e", "cells1", "source_id, i", "tws", "bsp", "asked1")}"""


@query("polar_resample_cubic", f"WITH {_CUBIC} SELECT source_id, i, j, {rnd('v')} AS bsp FROM e_read")
def polar_resample_cubic(spark, sf_dir):
    """Two curves: along each column, then across the columns, where straight lines reach."""
    return _r6(polar.resample_cubic(_nodes(spark, sf_dir), V.TWA, V.TWS), "bsp")


@query("plot_curves", f"WITH {S.NODES}, c AS (SELECT source_id, twa, max(CASE WHEN tws <= 10 THEN tws END) AS s0, min(CASE WHEN tws >= 10 THEN tws END) AS s1 FROM nodes GROUP BY 1, 2) SELECT c.source_id, {d(10)} AS tws, c.twa, {rnd('CASE WHEN s0 = s1 THEN x.bsp ELSE x.bsp + (y.bsp - x.bsp) * ((' + d(10) + ' - s0) / (s1 - s0)) END')} AS bsp FROM c JOIN nodes x ON x.source_id = c.source_id AND x.twa = c.twa AND x.tws = c.s0 JOIN nodes y ON y.source_id = c.source_id AND y.twa = c.twa AND y.tws = c.s1")
def plot_curves(spark, sf_dir):
    return _r6(polar.curves(_nodes(spark, sf_dir), 10.0), "bsp")


@query("plot_dots", f"WITH {S.POINTS}, h AS (SELECT p.track_id, p.e, p.twa, p.tws, p.bsp, f.t, f.lon FROM points p JOIN fixes f ON f.track_id = p.track_id AND f.e = p.e) SELECT track_id, e, {rnd('twa')} AS twa, {rnd('bsp')} AS bsp, CASE WHEN {_HOUR} >= 21 OR {_HOUR} < 5 THEN 'night' WHEN {_HOUR} < 12 THEN 'morning' WHEN {_HOUR} < 17 THEN 'afternoon' ELSE 'evening' END AS band FROM h WHERE abs(tws - 12) <= 1")
def plot_dots(spark, sf_dir):
    rows = V.placed(spark, sf_dir).where(F.abs(F.col("p_tws") - 12.0) <= 1.0)
    return rows.select("track_id", "e", rounded("p_twa", 6).alias("twa"), rounded("p_bsp", 6).alias("bsp"), sailing.day_band("t", "lon").alias("band"))


# ---- blend


def _evidence(spark, sf_dir):
    """Six polar files and the tracks pooled into four boats, with weights."""
    read = polar.resample(_nodes(spark, sf_dir), V.TWA, V.TWS).select("source_id", "i", "j", "bsp", (0.25 + F.col("source_id") / 10.0).alias("weight"))
    boats = V.points(spark, sf_dir).withColumn("source_id", 100 + F.col("track_id") % 4)
    cells = checkpointed(polar.segment(boats, V.TWA, V.TWS, "p90", 5, ("source_id",)))
    weights = cells.select("source_id").distinct().withColumn("weight", (F.col("source_id") - 99) / 4.0)
    # at most a few hundred cells a source: kept once, as blends read them several times
    return checkpointed(read.unionByName(blend.track_evidence(cells, weights, 30)))


_EVIDENCE = f"""{S.BINNED}, {S.NODES}, {S.READ},
seg AS (SELECT 100 + track_id % 4 AS source_id, i, j, count(*) AS n, {rnd("quantile_cont(bsp, 0.9)")} AS bsp FROM binned GROUP BY 1, 2, 3),
ev1 AS (SELECT source_id, i, j, bsp, {d(0.25)} + source_id / {d(10)} AS weight FROM read UNION ALL SELECT source_id, i, j, bsp, ((source_id - 99) / {d(4)}) * least(n / {d(30)}, {d(1)}) FROM seg WHERE n >= 5)"""
_DIRECT = _EVIDENCE + ", direct AS (SELECT i, j, sum(weight * bsp) / sum(weight) AS value FROM ev1 WHERE weight > 0 GROUP BY i, j)"


def _fill_sql(source: str, part: str, at: str, value: str) -> str:
    o = f"OVER (PARTITION BY {part} ORDER BY {at} ROWS BETWEEN"
    lo = lambda x: f"last_value(CASE WHEN {value} IS NOT NULL THEN {x} END IGNORE NULLS) {o} UNBOUNDED PRECEDING AND 1 PRECEDING)"
    hi = lambda x: f"first_value(CASE WHEN {value} IS NOT NULL THEN {x} END IGNORE NULLS) {o} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"SELECT *, coalesce({value}, {lo(value)} + (({at} - {lo(at)}) / ({hi(at)} - {lo(at)})) * ({hi(value)} - {lo(value)})) AS v FROM {source}"


_FILLED = (
    _DIRECT
    + f""", b0 AS (SELECT g.*, dd.value AS dv, dd.value IS NOT NULL AS has FROM grid g LEFT JOIN direct dd ON dd.i = g.i AND dd.j = g.j WHERE g.i <> 0),
b1 AS (SELECT i, twa, j, tws, has, v AS v1 FROM ({_fill_sql("b0", "j", "twa", "dv")}) x), b2 AS (SELECT i, twa, j, tws, has, v AS v2 FROM ({_fill_sql("b1", "i", "tws", "v1")}) x),
z AS (SELECT g.i, g.twa, g.j, g.tws, EXISTS (SELECT 1 FROM direct dd WHERE dd.i = g.i AND dd.j = g.j) AS has FROM grid g WHERE g.i = 0),
cells AS (SELECT i, twa, j, tws, v2 AS value, CASE WHEN has THEN 'direct' WHEN v2 IS NOT NULL THEN 'filled' ELSE 'empty' END AS origin FROM b2 UNION ALL SELECT i, twa, j, tws, {d(0)}, CASE WHEN has THEN 'direct' ELSE 'filled' END FROM z)"""
)


@query("blend_direct", f"WITH {_DIRECT} SELECT i, j, {rnd('value')} AS value FROM direct")
def blend_direct(spark, sf_dir):
    return _r6(blend.direct(_evidence(spark, sf_dir)), "value")


@query("blend_contributions", f"WITH {_EVIDENCE}, c AS (SELECT * FROM ev1 WHERE i = 5 AND j = 3 AND weight > 0) SELECT CAST(source_id AS BIGINT) AS source_id, {rnd('bsp')} AS bsp, {rnd('weight')} AS weight, {rnd('weight / (SELECT sum(weight) FROM c)')} AS share FROM c")
def blend_contributions(spark, sf_dir):
    return _r6(blend.contributions(_evidence(spark, sf_dir), 5, 3), "bsp", "weight", "share")


@query("blend_fill", f"WITH {_FILLED} SELECT i, j, origin, {rnd('value')} AS bsp FROM cells")
def blend_fill(spark, sf_dir):
    return blend.blend(_evidence(spark, sf_dir), V.TWA, V.TWS).select("i", "j", "origin", "bsp")


_FILLED_CUBIC = (
    _DIRECT
    + f""", cubic_b0 AS (SELECT g.*, dd.value AS dv FROM grid g LEFT JOIN direct dd ON dd.i = g.i AND dd.j = g.j WHERE g.i <> 0), cubic_k0 AS (SELECT * FROM cubic_b0 WHERE dv IS NOT NULL), cubic_n0 AS (SELECT i, twa, j, tws FROM cubic_b0 WHERE dv IS NULL),
{_curve_sql("cubic_f", "cubic_k0", "j", "twa", "dv", "cubic_n0")}, cubic_b1 AS (SELECT cubic_b0.i, cubic_b0.twa, cubic_b0.j, cubic_b0.tws, dv, coalesce(dv, r.v) AS v1 FROM cubic_b0 LEFT JOIN cubic_f_read r ON r.i = cubic_b0.i AND r.j = cubic_b0.j),
cubic_k1 AS (SELECT * FROM cubic_b1 WHERE v1 IS NOT NULL), cubic_n1 AS (SELECT i, twa, j, tws FROM cubic_b1 WHERE v1 IS NULL), {_curve_sql("cubic_w", "cubic_k1", "i", "tws", "v1", "cubic_n1")},
cells AS (SELECT cubic_b1.i, cubic_b1.j, CASE WHEN dv IS NOT NULL THEN 'direct' WHEN coalesce(v1, r.v) IS NOT NULL THEN 'filled' ELSE 'empty' END AS origin, coalesce(v1, r.v) AS value FROM cubic_b1 LEFT JOIN cubic_w_read r ON r.i = cubic_b1.i AND r.j = cubic_b1.j
 UNION ALL SELECT g.i, g.j, CASE WHEN EXISTS (SELECT 1 FROM direct dd WHERE dd.i = g.i AND dd.j = g.j) THEN 'direct' ELSE 'filled' END, {d(0)} FROM grid g WHERE g.i = 0)"""
)


@query("blend_fill_cubic", f"WITH {_FILLED_CUBIC} SELECT i, j, origin, {rnd('value')} AS bsp FROM cells")
def blend_fill_cubic(spark, sf_dir):
    """Both ordered fills by shape-preserving cubics."""
    return blend.blend(_evidence(spark, sf_dir), V.TWA, V.TWS, cubic=True).select("i", "j", "origin", "bsp")


_SMOOTH = _FILLED + ", sm AS (SELECT a.i, a.j, sum(b.value * (2 - abs(a.i - b.i)) * (2 - abs(a.j - b.j))) / sum((2 - abs(a.i - b.i)) * (2 - abs(a.j - b.j))) AS value FROM cells a JOIN cells b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 WHERE a.i <> 0 AND b.i <> 0 AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2)"


@query("blend_smooth", f"WITH {_SMOOTH} SELECT c.i, c.j, c.origin, {rnd('coalesce(s.value, c.value)')} AS bsp FROM cells c LEFT JOIN sm s ON s.i = c.i AND s.j = c.j")
def blend_smooth(spark, sf_dir):
    return blend.blend(_evidence(spark, sf_dir), V.TWA, V.TWS, True).select("i", "j", "origin", "bsp")


@query("blend_coverage", f"WITH {_FILLED} SELECT CAST(sum(CASE WHEN origin = 'direct' THEN 1 ELSE 0 END) AS BIGINT) AS direct, CAST(sum(CASE WHEN origin = 'filled' THEN 1 ELSE 0 END) AS BIGINT) AS filled, CAST(sum(CASE WHEN origin = 'empty' THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM cells WHERE i <> 0")
def blend_coverage(spark, sf_dir):
    return blend.coverage(blend.blend(_evidence(spark, sf_dir), V.TWA, V.TWS))


@query("blend_corrected", f"WITH {_FILLED} SELECT i, j, CASE WHEN (CAST(twa AS BIGINT) + CAST(tws AS BIGINT)) % 11 = 0 THEN 'direct' ELSE origin END AS origin, {rnd('CASE WHEN i = 0 THEN 0 WHEN (CAST(twa AS BIGINT) + CAST(tws AS BIGINT)) % 11 = 0 THEN tws / 2 ELSE value END')} AS bsp FROM cells")
def blend_corrected(spark, sf_dir):
    edits = polar.grid(spark, V.TWA, V.TWS).where("(CAST(twa AS BIGINT) + CAST(tws AS BIGINT)) % 11 = 0").select("twa", "tws", (F.col("tws") / 2).alias("bsp"))
    cells = blend.filled(blend.direct(_evidence(spark, sf_dir)), V.TWA, V.TWS)
    return blend.corrected(cells, edits).select("i", "j", "origin", knots("value").alias("bsp"))


_RTWA, _RTWS = [0.0, 40.0, 52.0, 67.5, 110.0, 172.5], [6.0, 9.0, 10.0, 15.0]


@query(
    "blend_resampled",
    f"""WITH {_FILLED}, rc AS (SELECT twa, tws, {rnd("value")} AS bsp FROM cells WHERE i <> 0 AND value IS NOT NULL),
rq AS (SELECT * FROM {S.axis_values(_RTWA, "i", "twa")} a CROSS JOIN {S.axis_values(_RTWS, "j", "tws")} b),
rs AS (SELECT *, (SELECT max(x.tws) FROM axis_j x WHERE x.tws <= rq.tws) AS s0, (SELECT min(x.tws) FROM axis_j x WHERE x.tws >= rq.tws) AS s1 FROM rq),
rside AS (SELECT *, s0 AS c FROM rs UNION SELECT *, s1 AS c FROM rs),
rn AS (SELECT *, (SELECT max(k.twa) FROM rc k WHERE k.tws = c AND k.twa <= rside.twa) AS a0, (SELECT min(k.twa) FROM rc k WHERE k.tws = c AND k.twa >= rside.twa) AS a1 FROM rside),
rv AS (SELECT n.*, CASE WHEN a0 = a1 THEN x.bsp ELSE x.bsp + (y.bsp - x.bsp) * ((n.twa - a0) / (a1 - a0)) END AS v FROM rn n JOIN rc x ON x.tws = n.c AND x.twa = n.a0 JOIN rc y ON y.tws = n.c AND y.twa = n.a1),
rr AS (SELECT l.i, l.j, CASE WHEN l.s0 = l.s1 THEN l.v ELSE l.v + (h.v - l.v) * ((l.tws - l.s0) / (l.s1 - l.s0)) END AS v FROM rv l JOIN rv h ON l.i = h.i AND l.j = h.j AND l.c = l.s0 AND h.c = h.s1)
SELECT q.i, q.twa, q.j, q.tws, CASE WHEN q.i = 0 THEN 0 ELSE {rnd("rr.v")} END AS bsp FROM rq q LEFT JOIN rr ON rr.i = q.i AND rr.j = q.j""",
)
def blend_resampled(spark, sf_dir):
    cells = blend.blend(_evidence(spark, sf_dir), V.TWA, V.TWS)
    return blend.resampled(cells, _RTWA, _RTWS)


@query(
    "split_blends",
    f"""WITH {S.BINNED}, {S.NODES}, {S.READ}, seg AS (SELECT bucket, 100 + track_id % 4 AS source_id, i, j, count(*) AS n, {rnd("quantile_cont(bsp, 0.9)")} AS bsp FROM (SELECT *, {bucket_sql(4)} AS bucket FROM binned) WHERE bucket IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3),
sides0 AS (SELECT DISTINCT bucket FROM seg),
evb AS (SELECT bucket, i, j, bsp, least(n / {d(30)}, {d(1)}) AS weight FROM seg UNION ALL SELECT bucket, i, j, bsp, {d(0.5)} FROM read CROSS JOIN sides0),
direct AS (SELECT bucket, i, j, sum(weight * bsp) / sum(weight) AS value FROM evb GROUP BY 1, 2, 3),
g0 AS (SELECT k.bucket, g.i, g.twa, g.j, g.tws, dd.value AS dv, dd.value IS NOT NULL AS has FROM sides0 k CROSS JOIN grid g LEFT JOIN direct dd ON dd.bucket = k.bucket AND dd.i = g.i AND dd.j = g.j),
b0 AS (SELECT * FROM g0 WHERE i <> 0), b1 AS (SELECT bucket, i, twa, j, tws, has, v AS v1 FROM ({_fill_sql("b0", "bucket, j", "twa", "dv")}) x), b2 AS (SELECT bucket, i, j, has, v AS v2 FROM ({_fill_sql("b1", "bucket, i", "tws", "v1")}) x)
SELECT bucket, i, j, CASE WHEN has THEN 'direct' WHEN v2 IS NOT NULL THEN 'filled' ELSE 'empty' END AS origin, {rnd("v2")} AS bsp FROM b2 UNION ALL SELECT bucket, i, j, CASE WHEN has THEN 'direct' ELSE 'filled' END, {d(0)} FROM g0 WHERE i = 0""",
)
def split_blends(spark, sf_dir):
    """One blend a wave direction in one job: polar files in every copy, tracks by their own direction."""
    bucket = sailing.wave_bucket(4, "from", F.coalesce("heading_corrected", "heading"))
    boats = V.points(spark, sf_dir).withColumns({"bucket": bucket, "source_id": 100 + F.col("track_id") % 4}).where("bucket is not null")
    cells = polar.segment(boats, V.TWA, V.TWS, "p90", 3, ("bucket", "source_id"))
    own = cells.where("bsp is not null").select("bucket", "source_id", "i", "j", "bsp", blend.confidence(F.col("n"), 30).alias("weight"))
    read = polar.resample(_nodes(spark, sf_dir), V.TWA, V.TWS).select("source_id", "i", "j", "bsp", F.lit(0.5).alias("weight"))
    every = own.select("bucket").distinct().join(F.broadcast(read)).select("bucket", "source_id", "i", "j", "bsp", "weight")
    return blend.blend(own.unionByName(every), V.TWA, V.TWS, keys=("bucket",)).select("bucket", "i", "j", "origin", "bsp")


# ---- compare

_AB = f"{S.BINNED}, {S.NODES}, {S.READ}, a AS (SELECT i, j, {rnd('quantile_cont(bsp, 0.9)')} AS bsp FROM binned GROUP BY i, j HAVING count(*) >= 5), b AS (SELECT i, j, {rnd('max(bsp)')} AS bsp FROM read GROUP BY i, j)"
_CELLS = (
    _AB
    + f""", cmp0 AS (SELECT g.i, g.twa, g.j, g.tws, a.bsp AS a, b.bsp AS b FROM grid g LEFT JOIN a ON a.i = g.i AND a.j = g.j LEFT JOIN b ON b.i = g.i AND b.j = g.j),
cmp AS (SELECT *, CASE WHEN i <> 0 THEN {rnd("a - b")} END AS delta_kn, CASE WHEN i <> 0 AND b >= {d(0.1)} THEN {rnd(f"(a - b) / b * {d(100)}")} END AS delta_pct,
 CASE WHEN i = 0 THEN 'zero_row' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both' WHEN a IS NOT NULL THEN 'a_only' WHEN b IS NOT NULL THEN 'b_only' ELSE 'neither' END AS class FROM cmp0)"""
)


def _compared(spark, sf_dir):
    a = polar.segment(V.points(spark, sf_dir), V.TWA, V.TWS, "p90", 5).select("i", "j", "bsp")
    b = polar.resample(_nodes(spark, sf_dir), V.TWA, V.TWS).groupBy("i", "j").agg(knots(F.max("bsp")).alias("bsp"))
    return checkpointed(compare.cells(a, b, polar.grid(spark, V.TWA, V.TWS)))


@query("compare_cells", f"WITH {_CELLS} SELECT i, j, a, b, delta_kn, delta_pct, class FROM cmp")
def compare_cells(spark, sf_dir):
    return _compared(spark, sf_dir).select("i", "j", "a", "b", "delta_kn", "delta_pct", "class")


def _stats_sql() -> str:
    out = [f"CAST(sum(CASE WHEN class = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in ("both", "a_only", "b_only", "neither", "zero_row")]
    out.append("CAST(sum(CASE WHEN class = 'both' AND delta_pct IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS pct_excluded")
    for u in ("kn", "pct"):
        place = lambda c, u=u: f"(SELECT {c} FROM cmp WHERE delta_{u} IS NOT NULL ORDER BY abs(delta_{u}) DESC, i, j LIMIT 1)"
        out += [f"{rnd(f'avg(abs(delta_{u}))')} AS mean_abs_{u}", f"max(abs(delta_{u})) AS max_abs_{u}", f"{place('i')} AS max_i_{u}", f"{place('j')} AS max_j_{u}", f"min(delta_{u}) AS min_{u}", f"max(delta_{u}) AS max_{u}"]
    return f"WITH {_CELLS} SELECT {', '.join(out)} FROM cmp"


@query("compare_stats", _stats_sql())
def compare_stats(spark, sf_dir):
    return compare.stats(_compared(spark, sf_dir))


@query("compare_regions", f"WITH {_CELLS}, s AS (SELECT j, i, CASE WHEN delta_kn > {d(0.05)} THEN 'a' WHEN delta_kn < {d(-0.05)} THEN 'b' END AS faster FROM cmp), r AS (SELECT *, i - row_number() OVER (PARTITION BY j, faster ORDER BY i) AS run FROM s WHERE faster IS NOT NULL) SELECT j, faster, min(i) AS first_i, max(i) AS last_i FROM r GROUP BY j, faster, run")
def compare_regions(spark, sf_dir):
    return compare.regions(_compared(spark, sf_dir))


# ---- weather

AXES = weather.Axes(t0=1_704_067_200, dt=21_600, steps=124, lat0=35.0, dlat=2.0, lats=20, lon0=-40.0, dlon=3.0, lons=30)


def _archive(spark):
    rows = spark.range(AXES.steps).toDF("step").join(F.broadcast(spark.range(AXES.lats).toDF("i"))).join(F.broadcast(spark.range(AXES.lons).toDF("j")))
    land = (F.col("i") * 3 + F.col("j") * 5) % 17 == 0
    value = lambda k: F.when(~land, ((F.col("i") * 7 + F.col("j") * 13 + F.col("step") * 29 + k) % 200) / 10.0 - 10.0)
    angle = F.when(~land, ((F.col("i") * 31 + F.col("j") * 17 + F.col("step") * 7) % 360).cast("double"))
    return rows, value, angle


_ARCHIVE = f"arc AS (SELECT s.range AS step, a.range AS i, b.range AS j, CASE WHEN (a.range * 3 + b.range * 5) % 17 <> 0 THEN ((a.range * 7 + b.range * 13 + s.range * 29) % 200) / {d(10)} - {d(10)} END AS u, CASE WHEN (a.range * 3 + b.range * 5) % 17 <> 0 THEN ((a.range * 7 + b.range * 13 + s.range * 29 + 77) % 200) / {d(10)} - {d(10)} END AS v, CASE WHEN (a.range * 3 + b.range * 5) % 17 <> 0 THEN CAST((a.range * 31 + b.range * 17 + s.range * 7) % 360 AS DOUBLE) END AS w FROM range({AXES.steps}) s CROSS JOIN range({AXES.lats}) a CROSS JOIN range({AXES.lons}) b)"
_STENCIL = f"""{S.FIXES}, {_ARCHIVE}, pt AS (SELECT e AS point_id, (t - {AXES.t0}) / {d(AXES.dt)} AS ft, (lat - {d(AXES.lat0)}) / {d(AXES.dlat)} AS fy, (lon - {d(AXES.lon0)}) / {d(AXES.dlon)} AS fx FROM fixes),
inb AS (SELECT *, least(CAST(floor(ft) AS BIGINT), {AXES.steps - 2}) AS s, least(CAST(floor(fy) AS BIGINT), {AXES.lats - 2}) AS i, least(CAST(floor(fx) AS BIGINT), {AXES.lons - 2}) AS j FROM pt WHERE ft >= 0 AND ft <= {AXES.steps - 1} AND fy >= 0 AND fy <= {AXES.lats - 1} AND fx >= 0 AND fx <= {AXES.lons - 1}),
key AS (SELECT point_id, ft - s AS tw, c.side, s + c.side AS step, i + c.a AS i, j + c.b AS j, (CASE WHEN c.a = 1 THEN fy - inb.i ELSE 1 - (fy - inb.i) END) * (CASE WHEN c.b = 1 THEN fx - inb.j ELSE 1 - (fx - inb.j) END) AS weight FROM inb CROSS JOIN (SELECT x.range AS side, y.range AS a, z.range AS b FROM range(2) x CROSS JOIN range(2) y CROSS JOIN range(2) z) c)"""


def _timed(x: str) -> str:
    return f"(CASE WHEN a_{x} IS NOT NULL AND b_{x} IS NOT NULL THEN a_{x} + (b_{x} - a_{x}) * tw WHEN a_{x} IS NOT NULL AND tw <= 0.5 THEN a_{x} WHEN b_{x} IS NOT NULL AND tw >= 0.5 THEN b_{x} END)"


def _sampled(*columns: tuple[str, str]) -> str:
    side = ", ".join(f"sum(weight * ({x})) / sum(weight) AS {n}" for n, x in columns)
    both = ", ".join(f"max(CASE WHEN side = 0 THEN {n} END) AS a_{n}, max(CASE WHEN side = 1 THEN {n} END) AS b_{n}" for n, _ in columns)
    return f"{_STENCIL}, side AS (SELECT point_id, tw, k.side, {side} FROM key k JOIN arc ON arc.step = k.step AND arc.i = k.i AND arc.j = k.j WHERE weight > 0 AND arc.u IS NOT NULL GROUP BY 1, 2, 3), tm AS (SELECT point_id, tw, {both} FROM side GROUP BY 1, 2)"


def _points(spark, sf_dir):
    return V.fixes(spark, sf_dir).select(F.col("e").alias("point_id"), "t", "lat", "lon")


@query("weather_stencil", f"WITH {_sampled(('u', 'u'), ('v', 'v'))} SELECT point_id, {rnd(_timed('u'))} AS u, {rnd(_timed('v'))} AS v FROM tm WHERE {_timed('u')} IS NOT NULL")
def weather_stencil(spark, sf_dir):
    rows, value, _ = _archive(spark)
    archive = rows.select("step", "i", "j", F.lit("u").alias("var"), value(0).alias("value")).unionByName(rows.select("step", "i", "j", F.lit("v").alias("var"), value(77).alias("value")))
    got = weather.sample(_points(spark, sf_dir), archive, AXES)
    return got.groupBy("point_id").agg(*[rounded(F.max(F.when(F.col("var") == v, F.col("value"))), 6).alias(v) for v in ("u", "v")])


_SS, _CC = _timed("s"), _timed("c")


@query("weather_direction", f"WITH {_sampled(('s', 'sin(radians(w))'), ('c', 'cos(radians(w))'))} SELECT point_id, {rnd(S.mod360(f'degrees(atan2({_SS}, {_CC}))'), 4)} AS direction FROM tm WHERE {S.hypot(_SS, _CC)} >= {d('0.000000001')}")
def weather_direction(spark, sf_dir):
    rows, _, angle = _archive(spark)
    got = weather.sample_direction(_points(spark, sf_dir), rows.select("step", "i", "j", F.lit("w").alias("var"), angle.alias("value")), AXES)
    return got.select("point_id", rounded("value", 4).alias("direction"))


@query("wind_from_components", f"WITH {S.FIXES}, {_ARCHIVE}, s AS (SELECT step, i, j, {S.hypot('u', 'v')} AS m, {rnd(S.compass('-u', '-v'), 1)} AS f FROM arc WHERE u IS NOT NULL) SELECT step, i, j, {rnd(f'm * ({d(3600)} / {d(1852)})', 2)} AS knots, CASE WHEN m > {d('0.000000001')} THEN CASE WHEN f >= 360 THEN 0 ELSE f END END AS wind_from FROM s")
def wind_from_components(spark, sf_dir):
    rows, value, _ = _archive(spark)
    speed, direction = sailing.from_components("u", "v", "from")
    return rows.select("step", "i", "j", value(0).alias("u"), value(77).alias("v")).where("u is not null").select("step", "i", "j", speed.alias("knots"), direction.alias("wind_from"))


@query("current_tiers", f"WITH {S.FIXES}, x AS (SELECT e, CASE WHEN e % 4 = 0 THEN e / {d(10)} END AS a, CASE WHEN e % 3 = 0 THEN e / {d(20)} END AS b, e / {d(40)} AS c FROM fixes) SELECT e AS point_id, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 ELSE 2 END AS tier FROM x")
def current_tiers(spark, sf_dir):
    f = V.fixes(spark, sf_dir)
    tier = lambda every, by: f.select(F.col("e").alias("point_id"), F.when(F.col("e") % every == 0, F.col("e") / by).alias("value"))
    return weather.first_tier([tier(4, 10.0), tier(3, 20.0), tier(1, 40.0)])


_NEAR = 20_000


@query(
    "report_asof",
    f"""WITH {S.FIXES}, fx AS (SELECT DISTINCT track_id, t FROM fixes WHERE event_type <> 'purchase'), rp AS (SELECT track_id, t, e AS report_id FROM fixes WHERE event_type = 'purchase'),
c AS (SELECT r.track_id, r.t, r.report_id, f.t AS hit_t, abs(f.t - r.t) AS gap, row_number() OVER (PARTITION BY r.report_id ORDER BY abs(f.t - r.t), f.t) AS k FROM rp r JOIN fx f ON f.track_id = r.track_id AND abs(f.t - r.t) <= {_NEAR}),
b AS (SELECT *, row_number() OVER (PARTITION BY track_id, hit_t ORDER BY gap, t, report_id) AS q FROM c WHERE k = 1)
SELECT track_id, hit_t AS t, report_id, gap FROM b WHERE q = 1""",
)
def report_asof(spark, sf_dir):
    f = V.fixes(spark, sf_dir)
    reports = f.where("event_type = 'purchase'").select("track_id", "t", F.col("e").alias("report_id"))
    return weather.match_reports(f.where("event_type <> 'purchase'").select("track_id", "t").distinct(), reports, _NEAR)


_T = d(0.25)


@query(
    "region_bbox",
    f"""WITH {S.FIXES}, p AS (SELECT track_id, lat, ((lon + fix_idx * 3) % {d(360)} + {d(360)}) % {d(360)} AS lon FROM fixes), l AS (SELECT track_id, lon, lon - lag(lon) OVER (PARTITION BY track_id ORDER BY lon) AS gap FROM (SELECT DISTINCT track_id, lon FROM p) q),
g AS (SELECT track_id, gap, lon, row_number() OVER (PARTITION BY track_id ORDER BY gap DESC, lon) AS k FROM l WHERE gap IS NOT NULL), e AS (SELECT track_id, min(lat) AS s, max(lat) AS n, min(lon) AS a, max(lon) AS z FROM p GROUP BY 1),
x AS (SELECT e.track_id, s, n, CASE WHEN g.gap > a + 360 - z THEN g.lon ELSE a END AS start, CASE WHEN g.gap > a + 360 - z THEN {d(360)} - g.gap ELSE {d(360)} - (a + 360 - z) END AS ext FROM e LEFT JOIN g ON g.track_id = e.track_id AND g.k = 1),
y AS (SELECT *, CAST(least(greatest(ceil((n + 2) / {_T}), -360), 360) AS BIGINT) AS nn, CAST(least(greatest(floor((s - 2) / {_T}), -360), 360) AS BIGINT) AS ss, ext + 4 >= {d(360)} - {_T} AS world, CAST(floor((start - 2) / {_T}) AS BIGINT) AS west, CAST(ceil((start + ext + 2) / {_T}) AS BIGINT) AS east FROM x)
SELECT track_id, nn AS north_step, nn - ss + 1 AS rows, CASE WHEN world THEN 0 ELSE ((west % 1440) + 1440) % 1440 END AS west_step, CASE WHEN world THEN 1440 ELSE least(east - west + 1, 1440) END AS columns FROM y""",
)
def region_bbox(spark, sf_dir):
    f = V.fixes(spark, sf_dir).withColumn("lon", F.col("lon") + F.col("fix_idx") * 3)
    return weather.bounding_region(f, ["track_id"])


@query("download_estimate", f"WITH {S.FIXES}, k AS (SELECT DISTINCT e % 3 AS dataset, t // 3600 AS hour, CAST(floor(lat / 5) AS BIGINT) AS block FROM fixes), n AS (SELECT * FROM k WHERE NOT (hour % 4 = 0 AND block % 2 = 0)) SELECT dataset, count(*) AS blocks, CAST(count(*) * (dataset + 1) * 1000 AS BIGINT) AS bytes FROM n GROUP BY dataset")
def download_estimate(spark, sf_dir):
    f = V.fixes(spark, sf_dir)
    keys = f.select((F.col("e") % 3).alias("dataset"), F.expr("t div 3600").alias("hour"), F.floor(F.col("lat") / 5.0).alias("block"))
    sizes = spark.createDataFrame([(k, (k + 1) * 1000) for k in range(3)], "dataset long, bytes long")
    return weather.download_estimate(keys, sizes, keys.where("hour % 4 = 0 AND block % 2 = 0").distinct())


@query("fetch_status", f"WITH {S.FIXES}, x AS (SELECT track_id, (track_id % 3 = 0) OR (track_id % 3 = 1 AND fix_idx < 20) AS f FROM fixes) SELECT track_id, CASE WHEN min(CASE WHEN f THEN 1 ELSE 0 END) = 1 THEN 'ready' WHEN max(CASE WHEN f THEN 1 ELSE 0 END) = 1 THEN 'partial' ELSE 'none' END AS status FROM x GROUP BY track_id")
def fetch_status(spark, sf_dir):
    f = V.fixes(spark, sf_dir).withColumn("env_fetched", F.expr("(track_id % 3 = 0) OR (track_id % 3 = 1 AND fix_idx < 20)"))
    return weather.fetch_status(f, ["track_id"])


# ---- catalogues

_CERT = f"cert AS (SELECT c_custkey AS id, c_name AS name, concat(substring(n_name, 1, 3), CAST(c_custkey % 997 AS VARCHAR)) AS sail_no, substring(n_name, 1, 3) AS country, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS model, CASE WHEN c_custkey % 10 <> 0 THEN CAST(1990 + c_custkey % 35 AS INTEGER) END AS year, CASE WHEN c_custkey % 8 <> 0 THEN CAST(2019 + c_custkey % 7 AS INTEGER) END AS certificate_year, CASE WHEN c_custkey % 9 <> 0 THEN round(abs(c_acctbal)) / {d(500)} END AS loa, c_custkey % 17 = 0 AS withdrawn FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_HITS = "hits AS (SELECT id, CASE WHEN lower(sail_no) = '12' OR lower(substring(sail_no, 4)) = '12' THEN 1 WHEN starts_with(lower(name), '12') THEN 2 ELSE 4 END AS tier, certificate_year AS y, lower(name) AS f FROM cert WHERE contains(' ' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) || ' ' || lower(sail_no) || ' ' || lower(country) || ' ' || coalesce(trim(regexp_replace(lower(model), '[^a-z0-9]+', ' ', 'g')), '') || ' ' || lower(sail_no) || ' ' || lower(substring(sail_no, 4)) || ' ' || regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), ' 12') AND loa >= 2 AND NOT withdrawn)"


@query("catalogue_search_topk", f"WITH {_CERT}, {_HITS} SELECT id, tier, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY tier, y DESC NULLS LAST, f, id LIMIT 20")
def catalogue_search_topk(spark, sf_dir):
    return catalogue.search(V.certificates(spark, sf_dir), "12", 20, where=catalogue.admits(sizes={"loa": (2.0, None)}) & ~F.col("withdrawn"))


@query("catalogue_search_page", f"WITH {_CERT}, hits AS (SELECT id, certificate_year AS y, lower(name) AS f FROM cert WHERE lower(country) = 'chi' AND year BETWEEN 1993 AND 2020) SELECT id, 2 AS tier, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY y DESC NULLS LAST, f, id LIMIT 15 OFFSET 2")
def catalogue_search_page(spark, sf_dir):
    return catalogue.search(V.certificates(spark, sf_dir), "Çustömër", 15, 2, catalogue.admits("CHI", (1993, 2020)))


@query("catalogue_facets", f"WITH {_CERT} SELECT string_agg(DISTINCT country, ',' ORDER BY country) AS countries, min(year) AS first_year, max(year) AS last_year, count(*) AS entries, CAST(sum(CASE WHEN NOT withdrawn THEN 1 ELSE 0 END) AS BIGINT) AS current FROM cert")
def catalogue_facets(spark, sf_dir):
    return catalogue.facets(V.certificates(spark, sf_dir))


@query(
    "catalogue_upsert",
    f"""WITH {_CERT}, st AS (SELECT id AS ref_no, country, certificate_year, name AS payload, withdrawn FROM cert WHERE id % 5 <> 0), inc AS (SELECT id AS ref_no, country, certificate_year, CASE WHEN id % 4 = 0 THEN name || '+' ELSE name END AS payload FROM cert WHERE id % 3 = 0),
li AS (SELECT id AS ref_no, country FROM cert WHERE id % 7 <> 0 AND country < 'J'),
m AS (SELECT coalesce(i.ref_no, s.ref_no) AS ref_no, CASE WHEN i.ref_no IS NOT NULL THEN i.country ELSE s.country END AS country, CASE WHEN i.ref_no IS NOT NULL THEN i.certificate_year ELSE s.certificate_year END AS certificate_year, CASE WHEN i.ref_no IS NOT NULL THEN i.payload ELSE s.payload END AS payload, CASE WHEN i.ref_no IS NOT NULL THEN FALSE ELSE s.withdrawn END AS withdrawn,
 CASE WHEN s.ref_no IS NULL THEN 'added' WHEN i.ref_no IS NOT NULL AND (i.payload <> s.payload OR s.withdrawn) THEN 'updated' ELSE 'kept' END AS change FROM st s FULL OUTER JOIN inc i ON s.ref_no = i.ref_no),
g AS (SELECT *, NOT withdrawn AND certificate_year = 2021 AND country IN (SELECT country FROM li) AND ref_no NOT IN (SELECT ref_no FROM li) AS gone0 FROM m)
SELECT ref_no, country, certificate_year, payload, withdrawn OR coalesce(gone0, FALSE) AS withdrawn, CASE WHEN coalesce(gone0, FALSE) THEN 'withdrawn' ELSE change END AS change FROM g""",
)
def catalogue_upsert(spark, sf_dir):
    c = V.certificates(spark, sf_dir).withColumnRenamed("id", "ref_no")
    stored = c.where("ref_no % 5 <> 0").select("ref_no", "country", "certificate_year", F.col("name").alias("payload"), "withdrawn")
    incoming = c.where("ref_no % 3 = 0").select("ref_no", F.lit(1).alias("seq"), "country", "certificate_year", F.expr("CASE WHEN ref_no % 4 = 0 THEN concat(name, '+') ELSE name END AS payload"))
    early = incoming.withColumns({"seq": F.lit(0), "payload": F.lit("stale")})
    return catalogue.upsert(stored, incoming.union(early), c.where("ref_no % 7 <> 0 AND country < 'J'").select("country", "ref_no"), 2021)


_IDF = "country, CAST(id % 4 AS VARCHAR) AS sail_no, 'n' AS name, model, CASE WHEN id % 2 = 0 THEN 2000 END AS year, certificate_year"
_IDENT = " AND ".join(f"s.{c} IS NOT DISTINCT FROM e.{c}" for c in ("country", "sail_no", "model", "year", "certificate_year"))
_IDPART = "country, sail_no, name, model, year, certificate_year"


@query(
    "catalogue_identity",
    f"""WITH {_CERT}, s0 AS (SELECT id AS scraped_id, {_IDF} FROM cert WHERE id % 3 = 0), e0 AS (SELECT id AS embedded_id, {_IDF} FROM cert WHERE id % 3 = 1), s AS (SELECT *, row_number() OVER (PARTITION BY {_IDPART} ORDER BY scraped_id) AS k FROM s0), e AS (SELECT *, row_number() OVER (PARTITION BY {_IDPART} ORDER BY embedded_id) AS k FROM e0)
SELECT s.scraped_id, e.embedded_id FROM s LEFT JOIN e ON {_IDENT} AND s.k = e.k""",
)
def catalogue_identity(spark, sf_dir):
    c = V.certificates(spark, sf_dir).selectExpr("id", "country", "CAST(id % 4 AS STRING) AS sail_no", "'n' AS name", "model", "CASE WHEN id % 2 = 0 THEN 2000 END AS year", "certificate_year")
    return catalogue.identity_match(c.where("id % 3 = 0").withColumnRenamed("id", "scraped_id"), c.where("id % 3 = 1").withColumnRenamed("id", "embedded_id"))


@query("name_keys", "SELECT p_partkey, lower(p_name) AS folded, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS compacted, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS words FROM part")
def name_keys(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", fold("p_name").alias("folded"), compact("p_name").alias("compacted"), joined_words("p_name").alias("words"))


_BOATS = f"boats AS (SELECT p_partkey AS boat_id, concat('First ', CAST(30 + p_partkey % 97 AS VARCHAR), '.', CAST(p_partkey % 7 AS VARCHAR)) AS model, CASE WHEN p_partkey % 5 <> 0 THEN {d(6)} + (p_partkey % 43) / {d(4)} END AS length FROM part)"


@query("model_match", f"WITH {_BOATS}, k AS (SELECT boat_id, length, regexp_replace(lower(model), ' ', '', 'g') AS key FROM boats) SELECT x.boat_id AS a, y.boat_id AS b, x.key FROM k x JOIN k y ON x.key = y.key AND x.boat_id < y.boat_id WHERE x.length IS NULL OR y.length IS NULL OR abs(x.length - y.length) <= greatest({d(0.6)}, {d(0.05)} * least(x.length, y.length))")
def model_match(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").selectExpr("p_partkey AS boat_id", "concat('First ', CAST(30 + p_partkey % 97 AS STRING), '.', CAST(p_partkey % 7 AS STRING)) AS model", "CASE WHEN p_partkey % 5 <> 0 THEN 6D + (p_partkey % 43) / 4D END AS length")
    return catalogue.model_matches(p)


_REACH = f"greatest(length + {d(0.6)}, length * {d(1.05)})"


@query(
    "model_classes",
    f"""WITH {_BOATS}, k AS (SELECT boat_id, length, regexp_replace(lower(model), ' ', '', 'g') AS key FROM boats), u AS (SELECT key, length, min(boat_id) AS least FROM k GROUP BY 1, 2),
n AS (SELECT *, coalesce(length > max({_REACH}) OVER (PARTITION BY key ORDER BY length NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS fresh, max(CASE WHEN length IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY key) AS open FROM u),
c AS (SELECT *, CASE WHEN open = 1 THEN 0 ELSE sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY length NULLS FIRST) END AS chain FROM n), g AS (SELECT key, length, min(least) OVER (PARTITION BY key, chain) AS class_id FROM c)
SELECT k.boat_id, k.key, g.class_id, (SELECT count(*) FROM k o WHERE o.key = k.key AND o.boat_id <> k.boat_id AND (o.length IS NULL OR k.length IS NULL OR abs(o.length - k.length) <= greatest({d(0.6)}, {d(0.05)} * least(o.length, k.length)))) AS links FROM k JOIN g ON g.key = k.key AND g.length IS NOT DISTINCT FROM k.length""",
)
def model_classes(spark, sf_dir):
    """The same matches as classes: a row a boat instead of a row a pair."""
    p = V.table(spark, sf_dir, "part").selectExpr("p_partkey AS boat_id", "concat('First ', CAST(30 + p_partkey % 97 AS STRING), '.', CAST(p_partkey % 7 AS STRING)) AS model", "CASE WHEN p_partkey % 5 <> 0 THEN 6D + (p_partkey % 43) / 4D END AS length")
    return catalogue.model_classes(p)


@query("model_consensus", "SELECT p_brand AS brand, min(p_type) AS model FROM (SELECT p_brand, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_brand < 'Brand#3' THEN 'one' ELSE p_type END AS p_type FROM part) x WHERE p_type IS NOT NULL GROUP BY p_brand HAVING count(DISTINCT p_type) = 1")
def model_consensus(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").selectExpr("p_brand AS brand", "CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_brand < 'Brand#3' THEN 'one' ELSE p_type END AS model")
    return catalogue.model_consensus(p, ["brand"])


_LIB = "lib AS (SELECT o.o_orderkey AS track_id, c.c_name AS boat, n.n_name AS event, s.s_name AS storage, CAST(floor(epoch(o.o_orderdate)) AS BIGINT) AS start FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1 JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE o.o_orderstatus <> 'P')"


def _library(spark, sf_dir):
    o, c, l_, s, n = (V.table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "supplier", "nation"))
    units = o.where("o_orderstatus <> 'P'").join(l_.where("l_linenumber = 1"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = units.join(c, F.col("c_custkey") == F.col("o_custkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.select(F.col("o_orderkey").alias("track_id"), F.col("c_name").alias("boat"), F.col("n_name").alias("event"), F.col("s_name").alias("storage"), F.expr("CAST(floor(unix_micros(CAST(o_orderdate AS TIMESTAMP)) / 1000000) AS BIGINT)").alias("start"))


@query("library_join", f"WITH {_LIB} SELECT * FROM lib")
def library_join(spark, sf_dir):
    return _library(spark, sf_dir)


@query("library_search", f"WITH {_LIB}, h AS (SELECT *, lower(concat(boat, ' ', event)) AS x FROM lib) SELECT track_id, boat, start, CASE WHEN contains(x, '1 nat') THEN 0 ELSE 1 END AS tier FROM h WHERE contains(x, '1') AND contains(x, 'nat') ORDER BY tier, lower(boat), start DESC NULLS LAST, track_id LIMIT 50")
def library_search(spark, sf_dir):
    return catalogue.library_search(_library(spark, sf_dir), "1 nat", 50)


# ---- export

_TXT = lambda x: f"regexp_replace(printf('%.2f', {x}), '\\.?0+$', '')"


@query("export_expedition_lines", f"WITH {S.NODES}, n AS (SELECT source_id, tws, twa, round(bsp * 4) / {d(4)} AS bsp FROM nodes) SELECT source_id, tws, {_TXT('tws')} || chr(9) || string_agg({_TXT('twa')} || chr(9) || printf('%.2f', bsp), chr(9) ORDER BY twa) AS line FROM n GROUP BY source_id, tws")
def export_expedition_lines(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).withColumn("bsp", F.round(F.col("bsp") * 4.0) / 4.0)
    return export.expedition_lines(nodes, ["source_id"])


_FILE_TWS = [4.0, 8.0, 12.0, 16.0, 20.0, 24.0]


@query("export_grid_pivot", f"WITH {S.NODES}, n AS (SELECT source_id, tws, twa, round(bsp * 4) / {d(4)} AS bsp FROM nodes) SELECT source_id, twa, {_TXT('twa')} || {' || '.join(f''' ';' || coalesce(max(CASE WHEN tws = {v} THEN printf('%.2f', bsp) END), '')''' for v in _FILE_TWS)} AS line FROM n GROUP BY source_id, twa")
def export_grid_pivot(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).withColumn("bsp", F.round(F.col("bsp") * 4.0) / 4.0)
    return export.table_lines(nodes, ["source_id"], _FILE_TWS)


@query(
    "export_check",
    f"""WITH {S.NODES}, n AS (SELECT source_id, CASE WHEN source_id = 1 THEN twa + source_id / {d(1000)} * (CAST(tws AS BIGINT) % 3) ELSE twa END AS twa, CASE WHEN source_id = 2 THEN tws * 3 ELSE tws END AS tws, CASE WHEN source_id = 3 THEN bsp * 7 WHEN source_id = 4 THEN NULL ELSE bsp END AS bsp FROM nodes),
a AS (SELECT DISTINCT source_id, twa FROM n), b AS (SELECT *, lag(twa) OVER (PARTITION BY source_id ORDER BY twa) AS p FROM a)
SELECT DISTINCT source_id, 'out-of-range' AS problem, 'tws' AS axis, tws AS value FROM n WHERE tws > 70
UNION ALL SELECT source_id, 'axis-collision', 'twa', {rnd("twa")} FROM b WHERE {_TXT("p")} = {_TXT("twa")}
UNION ALL SELECT source_id, 'too-fast', 'bsp', {rnd("bsp")} FROM n WHERE round(bsp * 100) / 100 > 60
UNION ALL SELECT source_id, 'empty', '', NULL FROM n GROUP BY source_id HAVING count(bsp) = 0""",
)
def export_check(spark, sf_dir):
    n = _nodes(spark, sf_dir).selectExpr("source_id", "CASE WHEN source_id = 1 THEN twa + source_id / 1000D * (CAST(tws AS BIGINT) % 3) ELSE twa END AS twa", "CASE WHEN source_id = 2 THEN tws * 3 ELSE tws END AS tws", "CASE WHEN source_id = 3 THEN bsp * 7 WHEN source_id = 4 THEN NULL ELSE bsp END AS bsp")
    return _r6(export.problems(n, ["source_id"]), "value")


__all__ = ["ORACLE", "QUERIES", "degrees", "model_key"]
