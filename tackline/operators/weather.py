"""Gridded weather at points: stencil joins, interpolation, fallback tiers.

A variable is a long table (var, step, i, j, value); where nothing was
measured the value is null or the row is missing. Keys of the cells that a
point needs are computed, so that the join to the archive is on equality.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tackline.functions.canonical import ON_AXIS


@dataclass(frozen=True)
class Axes:
    """Regular axes: t0 + step * dt seconds, lat0 + i * dlat, lon0 + j * dlon; ``turns`` if longitudes go all the way round."""

    t0: int
    dt: int
    steps: int
    lat0: float
    dlat: float
    lats: int
    lon0: float
    dlon: float
    lons: int
    turns: bool = False


def _bracket(x: Column, n: int) -> tuple[Column, Column]:
    """The lower index and the fraction beyond it for a place in steps; null outside [0, n - 1]. Ends take in rounding."""
    inside = (x >= -ON_AXIS) & (x <= n - 1 + ON_AXIS)
    x = F.greatest(F.lit(0.0), F.least(x, F.lit(float(n - 1))))
    low = F.least(F.floor(x), F.lit(max(0, n - 2))).cast("long")
    return F.when(inside, low), F.when(inside, x - low)


def stencil_keys(points: DataFrame, axes: Axes) -> DataFrame:
    """Each point's up to eight cells: point_id, side (0 before, 1 after), tw (weight of the later step), step, i, j, weight."""
    lat, lon = (F.col("lat") - axes.lat0) / axes.dlat, F.col("lon") - axes.lon0
    lon = (F.pmod(lon, F.lit(360.0)) if axes.turns else lon) / axes.dlon
    time = (F.col("t") - axes.t0) / float(axes.dt)
    i, y = _bracket(lat, axes.lats)
    # around the globe there is a cell between the last longitude and the first
    j, x = (F.floor(lon).cast("long"), lon - F.floor(lon)) if axes.turns else _bracket(lon, axes.lons)
    exact = F.pmod(F.col("t") - axes.t0, F.lit(axes.dt)) == 0
    s, w = _bracket(time, axes.steps)
    s, w = F.when(exact & (time >= 0) & (time <= axes.steps - 1), time.cast("long")).otherwise(s), F.when(exact, 0.0).otherwise(w)
    rows = points.select("point_id", s.alias("s"), w.alias("tw"), i.alias("i"), y.alias("y"), j.alias("j"), x.alias("x")).where("s is not null and i is not null and j is not null")
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    side = F.explode(F.when(F.col("tw") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("c", corner).withColumn("side", side)
    weight = F.when(F.col("c.a") == 1, F.col("y")).otherwise(1.0 - F.col("y")) * F.when(F.col("c.b") == 1, F.col("x")).otherwise(1.0 - F.col("x"))
    east = F.col("j") + F.col("c.b")
    return rows.select("point_id", "side", "tw", (F.col("s") + F.col("side")).alias("step"), (F.col("i") + F.col("c.a")).alias("i"), (F.pmod(east, F.lit(axes.lons)) if axes.turns else east).alias("j"), weight.alias("weight")).where("weight > 0")


def in_time(first: Column, second: Column, w: Column) -> Column:
    """Linear between the steps; with one side missing the other only where it is at least as near."""
    return F.when(first.isNotNull() & second.isNotNull(), first + (second - first) * w).when(first.isNotNull() & (w <= 0.5), first).when(second.isNotNull() & (w >= 0.5), second)


def sample(points: DataFrame, archive: DataFrame, axes: Axes) -> DataFrame:
    """(point_id, var, value): interpolated over the corners that hold a value, then in time. Points without any are left out."""
    keys = stencil_keys(points, axes)
    met = keys.join(archive.where("value is not null"), ["step", "i", "j"])
    # corners in one order, so that sums are the same bit for bit
    term = F.struct("i", "j", "weight", "value")
    sides = met.groupBy("point_id", "var", "side", "tw").agg(F.array_sort(F.collect_list(term)).alias("terms"))
    total = F.aggregate("terms", F.lit(0.0), lambda s, x: s + x["weight"])
    value = F.aggregate("terms", F.lit(0.0), lambda s, x: s + x["weight"] * x["value"]) / total
    sides = sides.select("point_id", "var", "tw", "side", F.when(total > 1e-12, value).alias("v"))
    both = sides.groupBy("point_id", "var").agg(F.max("tw").alias("w"), F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"))
    return both.select("point_id", "var", in_time(F.col("a"), F.col("b"), F.col("w")).alias("value")).where("value is not null")


def sample_direction(points: DataFrame, archive: DataFrame, axes: Axes) -> DataFrame:
    """(point_id, var, value) of directions in degrees, interpolated as unit vectors; null where they cancel out."""
    r = F.radians("value")
    parts = archive.where("value is not null").select("step", "i", "j", F.explode(F.array(F.struct(F.concat("var", F.lit("|sin")).alias("var"), F.sin(r).alias("value")), F.struct(F.concat("var", F.lit("|cos")).alias("var"), F.cos(r).alias("value")))).alias("p")).select("step", "i", "j", "p.*")
    got = sample(points, parts, axes).select("point_id", F.split("var", r"\|").alias("n"), "value")
    both = got.groupBy("point_id", F.get("n", F.lit(0)).alias("var")).agg(*[F.max(F.when(F.get("n", F.lit(1)) == part, F.col("value"))).alias(part[0]) for part in ("sin", "cos")])
    return both.where(F.hypot("s", "c") >= 1e-9).select("point_id", "var", F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0)).alias("value"))


def vector_sum(parts: DataFrame, names: list[str]) -> DataFrame:
    """(point_id, value): the sum of the named variables, for points that have all of them."""
    return parts.where(F.col("var").isin(*names)).groupBy("point_id").agg(F.count("*").alias("n"), F.sum("value").alias("value")).where(F.col("n") == len(names)).select("point_id", "value")


def first_tier(tiers: list[DataFrame]) -> DataFrame:
    """(point_id, value, tier): of tables (point_id, value) in order of preference, the first with a value."""
    rows = None
    for k, t in enumerate(tiers):
        t = t.where("value is not null").select("point_id", "value", F.lit(k).alias("tier"))
        rows = t if rows is None else rows.unionByName(t)
    return rows.groupBy("point_id").agg(F.min(F.struct("tier", "value")).alias("x")).select("point_id", "x.value", "x.tier")


def match_reports(fixes: DataFrame, reports: DataFrame, within_s: int = 60) -> DataFrame:
    """(track_id, t, report_id, gap): each report goes to its nearest fix, the earlier on a tie; each fix takes its nearest report, the first on a tie.

    An as-of join by one window over both streams in time order, so no report meets more than two fixes.
    """
    both = fixes.select("track_id", "t", F.lit(None).cast("long").alias("report_id")).unionByName(reports.select("track_id", "t", "report_id"))
    is_fix = F.when(F.col("report_id").isNull(), F.col("t"))
    w = Window.partitionBy("track_id").orderBy("t")
    # a range frame takes in all rows of the same time
    before = F.max(is_fix).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(is_fix).over(w.rangeBetween(0, Window.unboundedFollowing))
    rows = both.withColumns({"_b": before, "_a": after}).where("report_id is not null")
    to_before = F.col("_a").isNull() | (F.col("t") - F.col("_b") <= F.col("_a") - F.col("t"))
    rows = rows.select("track_id", F.when(to_before & F.col("_b").isNotNull(), F.col("_b")).otherwise(F.col("_a")).alias("at"), "t", "report_id").where("at is not null")
    rows = rows.withColumn("gap", F.abs(F.col("at") - F.col("t"))).where(F.col("gap") <= within_s)
    best = rows.groupBy("track_id", "at").agg(F.min(F.struct("gap", "t", "report_id")).alias("x"))
    return best.select("track_id", F.col("at").alias("t"), "x.report_id", "x.gap")


def bounding_region(points: DataFrame, keys: list[str], margin: float = 2.0, step: float = 0.25) -> DataFrame:
    """By key, the grid that holds all positions: north and west in steps, rows and columns.

    The shortest arc of longitude is the circle without its largest empty gap.
    """
    turn, half = round(360 / step), round(90 / step)
    rows = points.where("lat is not null and lon is not null").select(*keys, "lat", F.pmod("lon", F.lit(360.0)).alias("lon"))
    lats = rows.groupBy(*keys).agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("first"), F.max("lon").alias("last"))
    w = Window.partitionBy(*keys).orderBy("lon")
    gaps = rows.select(*keys, "lon").distinct().withColumn("gap", F.col("lon") - F.lag("lon").over(w)).where("gap is not null")
    # of equal gaps the first; the gap over north counts first of all
    widest = gaps.groupBy(*keys).agg(F.max(F.struct("gap", (-F.col("lon")).alias("m"))).alias("g"))
    out = lats.join(widest, keys, "left")
    round_gap = F.col("first") + 360.0 - F.col("last")
    inner = F.coalesce(F.col("g.gap") > round_gap, F.lit(False))
    gap, start = F.when(inner, F.col("g.gap")).otherwise(round_gap), F.when(inner, -F.col("g.m")).otherwise(F.col("first"))
    out = out.withColumns({"extent": 360.0 - gap, "start": start})
    n = F.greatest(F.lit(-half), F.least(F.ceil((F.col("north") + margin) / step), F.lit(half)))
    s = F.greatest(F.lit(-half), F.least(F.floor((F.col("south") - margin) / step), F.lit(half)))
    world = F.col("extent") + 2.0 * margin >= 360.0 - step
    west, east = F.floor((F.col("start") - margin) / step), F.ceil((F.col("start") + F.col("extent") + margin) / step)
    return out.select(*keys, n.cast("long").alias("north_step"), (n - s + 1).cast("long").alias("rows"), F.when(world, 0).otherwise(F.pmod(west, F.lit(turn))).cast("long").alias("west_step"), F.when(world, turn).otherwise(F.least(east - west + 1, F.lit(turn))).cast("long").alias("columns"))


def download_estimate(keys: DataFrame, block_bytes: DataFrame, cached: DataFrame) -> DataFrame:
    """By dataset: the distinct blocks needed and not cached, and their bytes; keys and cached have (dataset, hour, block)."""
    need = keys.select("dataset", "hour", "block").distinct().join(cached, ["dataset", "hour", "block"], "left_anti")
    return need.join(F.broadcast(block_bytes), "dataset").groupBy("dataset").agg(F.count("*").alias("blocks"), F.sum("bytes").alias("bytes"))


def fetch_status(samples: DataFrame, keys: list[str]) -> DataFrame:
    """ready where every sample was fetched, partial where some were, else none."""
    return samples.groupBy(*keys).agg(F.when(F.bool_and("env_fetched"), "ready").when(F.bool_or("env_fetched"), "partial").otherwise("none").alias("status"))
