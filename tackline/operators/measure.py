"""Measuring on plots: readings along a spoke, distances, lasso selections and the same wind in other copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tackline.durable import written
from tackline.functions.canonical import angle_between, col

#: How near in angle and wind speed a dot of another copy must be.
NEAR_DEG, NEAR_KN = 5.0, 1.0
#: How many points of a copy a bin should hold; it changes no result.
FEW = 4


def crossings(curves: DataFrame, twa: float) -> DataFrame:
    """(source_id, tws, bsp, place) of every curve (source_id, tws, twa, bsp) that covers the angle, fastest first, then by source and wind.

    The places are of one plot's curves, a bounded number: at most 512 a source.
    """
    point = F.struct(F.col("twa").alias("a"), F.col("bsp").alias("v"))
    ends = curves.groupBy("source_id", "tws").agg(F.max(F.when(F.col("twa") <= twa, point)).alias("lo"), F.min(F.when(F.col("twa") >= twa, point)).alias("hi")).where("lo is not null and hi is not null")
    value = F.when(F.col("lo.a") == F.col("hi.a"), F.col("lo.v")).otherwise(F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * (F.lit(float(twa)) - F.col("lo.a")) / (F.col("hi.a") - F.col("lo.a")))
    return ends.select("source_id", "tws", value.alias("bsp")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("bsp"), "source_id", "tws")) - 1)


def nearest_crossing(found: DataFrame, bsp: float) -> DataFrame:
    """The crossing nearest to a speed, the first of equals; no row where there is none."""
    return found.orderBy(F.abs(F.col("bsp") - bsp), "place").limit(1)


def between(twa_a, bsp_a, twa_b, bsp_b) -> dict[str, Column]:
    """From one point of a plot to another: difference and ratio of speeds, and the angle the short way."""
    a, b = col(bsp_a), col(bsp_b)
    return {"delta_bsp": b - a, "ratio": F.when(a > 0, b / a), "delta_twa": angle_between(twa_a, twa_b)}


def inside(x, y, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon by the even-odd rule; its bounding box is looked at first. Under three corners hold nothing."""
    if len(polygon) < 3:
        return F.lit(False)
    x, y = col(x), col(y)
    crossed = F.lit(0)
    for (xa, ya), (xb, yb) in zip(polygon, polygon[-1:] + polygon[:-1], strict=True):
        if ya != yb:
            crossed = crossed + (((F.lit(float(ya)) > y) != (F.lit(float(yb)) > y)) & (x < F.lit(float(xb - xa)) * (y - float(ya)) / float(yb - ya) + float(xa))).cast("int")
    xs, ys = zip(*polygon, strict=True)
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossed % 2 == 1)


def selection_summary(points: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """By key: how many points, and the least, most and mean of each value."""
    stats = [f(v).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return points.groupBy(*keys).agg(F.count("*").alias("points"), *stats)


def same_wind(points: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked_id, copy, id): for each asked point, in every other copy the point nearest in wind, the smaller id of equals.

    points: id, copy, twa, tws; asked: asked_id, copy, twa, tws. Points of one place count once. Points within reach lie in the
    same or a neighbouring bin of 5 degrees and 1 knot. Bins are halved until the fullest of the nine around holds some FEW
    points; a point nearer than such a bin is wide is the nearest, and what finds none goes on with bins four times as wide, up
    to the whole ones. So an asked point meets some points of a copy however many there are. No join broadcasts: an asked point's nine bins are
    not in what Spark reckons a table to take. Runs jobs while it is built.
    """
    turn, around = round(360 / NEAR_DEG), F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])

    def bins(angle, wind, level, step=None) -> list[Column]:
        """The bin of a level, or one beside it, as ba and bw."""
        times = F.pow(F.lit(2.0), level)
        a, w = F.floor(F.col(angle) / NEAR_DEG * times).cast("long"), F.floor(F.col(wind) / NEAR_KN * times).cast("long")
        if step is not None:
            a, w = a + step["a"], w + step["b"]
        return [F.pmod(a, (turn * times).cast("long")).alias("ba"), w.alias("bw")]

    whole = F.lit(0)
    p = written(points.where("copy is not null and twa is not null and tws is not null").groupBy("copy", "twa", "tws").agg(F.min("id").alias("id")))
    counts = p.select("copy", *bins("twa", "tws", whole)).groupBy("copy", "ba", "bw").agg(F.count(F.lit(1)).alias("n"))
    fullest = counts.select("copy", "n", "ba", "bw", F.explode(around).alias("s")).select("copy", "n", F.pmod(F.col("ba") + F.col("s.a"), F.lit(turn)).alias("ba"), (F.col("bw") + F.col("s.b")).alias("bw")).groupBy("copy", "ba", "bw").agg(F.max("n").alias("n"))
    level = F.greatest(F.lit(0), F.least(F.lit(16), F.floor(F.log2(F.col("n") / FEW) / 2))).cast("int")
    q = asked.select(F.col("copy").alias("own"), F.col("twa").alias("a"), F.col("tws").alias("w")).distinct()
    left = q.select("own", "a", "w", *bins("a", "w", whole)).join(fullest.hint("merge"), ["ba", "bw"]).where(F.col("copy") != F.col("own")).select("own", "a", "w", "copy", level.alias("level"))
    left, found = written(left), None
    while found is None or not left.isEmpty():
        beside = left.select("copy", "level", F.explode(around).alias("s"), "a", "w").select("copy", "level", *bins("a", "w", whole, F.col("s"))).distinct()
        near_p = p.select("copy", "twa", "tws", "id", *bins("twa", "tws", whole)).join(beside.hint("merge"), ["copy", "ba", "bw"]).select("copy", "level", "twa", "tws", "id", *bins("twa", "tws", F.col("level")))
        near_q = left.select("own", "a", "w", "copy", "level", F.explode(around).alias("s")).select("own", "a", "w", "copy", "level", *bins("a", "w", F.col("level"), F.col("s")))
        angle, wind = angle_between("twa", "a"), F.abs(F.col("tws") - F.col("w"))
        near = near_q.join(near_p.hint("merge"), ["copy", "level", "ba", "bw"]).where((angle <= NEAR_DEG) & (wind <= NEAR_KN))
        best = near.groupBy("own", "a", "w", "copy", "level").agg(F.min(F.struct((angle * angle / NEAR_DEG**2 + wind * wind / NEAR_KN**2).alias("score"), "id")).alias("x"))
        # a little less than the bin's width, as bins of nearly equal quotients may round apart
        sure = written(best.where((F.col("level") == 0) | (F.col("x.score") < F.pow(F.lit(0.25), F.col("level")) * (1 - 1e-6))).select("own", "a", "w", "copy", "x"))
        found = sure if found is None else found.union(sure)
        left = written(left.where("level > 0").join(sure.hint("merge"), ["own", "a", "w", "copy"], "left_anti").withColumn("level", F.greatest(F.lit(0), F.col("level") - 2)))
    named = asked.select("asked_id", F.col("copy").alias("own"), F.col("twa").alias("a"), F.col("tws").alias("w"))
    return named.join(found.hint("merge"), ["own", "a", "w"]).groupBy("asked_id", "copy").agg(F.min("x").alias("x")).select("asked_id", "copy", "x.id")
