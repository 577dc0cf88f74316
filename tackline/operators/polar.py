"""Polars as long tables (source_id, twa, tws, bsp): building, binning, reading.

Axes are short (at most 512 values), so they are Python lists here and
literals or small broadcast tables in plans.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tackline.functions.canonical import ON_AXIS, col, holds, is_zero_row, knots, settled
from tackline.operators.ranks import percentile_by

#: The default output grid.
DEFAULT_TWA = [0.0, 30.0, 36.0, 40.0, 45.0, 52.0, 60.0, 70.0, 75.0, 80.0, 90.0, 100.0, 110.0, 120.0, 135.0, 150.0, 160.0, 170.0, 180.0]
DEFAULT_TWS = [4.0, 6.0, 8.0, 10.0, 12.0, 14.0, 16.0, 20.0, 25.0, 30.0]
MAX_AXIS = 512


def axis_table(spark: SparkSession, values: list[float], index: str, name: str) -> DataFrame:
    if len(values) > MAX_AXIS:
        raise ValueError(f"an axis has at most {MAX_AXIS} values, not {len(values)}")
    return spark.createDataFrame(list(enumerate(map(float, values))), f"{index} int, {name} double")


def grid(spark: SparkSession, twa: list[float], tws: list[float]) -> DataFrame:
    """(i, twa, j, tws) of every cell; bounded by the axes' lengths."""
    return axis_table(spark, twa, "i", "twa").join(F.broadcast(axis_table(spark, tws, "j", "tws")))


def fold_twa(x) -> Column:
    """[0, 180]: port read as starboard; null outside [0, 360]."""
    x = col(x)
    return F.when(x.between(0, 360), F.least(x, 360.0 - x))


def angle_on_axis(x, axis: list[float]) -> Column:
    """A full-circle axis keeps the side, a half-circle one is read folded."""
    x = col(x)
    return F.when((x >= 0) & (x <= 360), x) if axis and axis[-1] > 180 else fold_twa(x)


def bin_index(x, axis: list[float]) -> Column:
    """The nearest node: halfway goes up, and half a step beyond the ends is still in. A count over the axis, not a range join."""
    x = col(x)
    if len(axis) == 1:
        return F.when(x.isNotNull(), F.lit(0))
    low, high = axis[0] - (axis[1] - axis[0]) / 2, axis[-1] + (axis[-1] - axis[-2]) / 2
    middles = F.array(*[F.lit((a + b) / 2) for a, b in zip(axis, axis[1:], strict=False)])
    return F.when(x.between(low, high), F.size(F.filter(middles, lambda m: m <= x)))


def collect_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """One cell a (keys, twa, tws): repeated points are averaged."""
    return points.groupBy(*keys, "twa", "tws").agg(knots(F.avg("bsp")).alias("bsp"))


def segment(points: DataFrame, twa: list[float], tws: list[float], statistic: str = "p90", min_samples: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Samples' (twa, tws, bsp) binned: keys, i, j, count, spread and the statistic where there are enough samples.

    statistic: p90, p75, median or mean, percentiles interpolated between ranks, exact and without a cell's samples in one task.
    """
    angle = angle_on_axis("twa", twa)
    zero = [k for k, a in enumerate(twa) if a in (0.0, 360.0)]
    rows = settled(points.select(*keys, "twa", "tws", "bsp"), {"i": bin_index(angle, twa), "j": bin_index("tws", tws)})
    rows = rows.where(holds(F.col("bsp") >= 0) & ~F.isnan("bsp") & F.col("i").isNotNull() & F.col("j").isNotNull() & ~F.col("i").isin(zero))
    if statistic == "mean":
        cells = rows.groupBy(*keys, "i", "j").agg(F.count("*").alias("n"), F.stddev_samp("bsp").alias("spread"), F.avg("bsp").alias("value"))
    else:
        cells = percentile_by(rows, [*keys, "i", "j"], "bsp", {"p90": 0.9, "p75": 0.75, "median": 0.5}[statistic])
    return cells.select(*keys, "i", "j", "n", knots("spread").alias("spread"), F.when(F.col("n") >= max(1, min_samples), knots("value")).alias("bsp"))


def choose_priority(points: DataFrame, twa: list[float], tws: list[float], groups: list[Column], min_samples: int) -> DataFrame:
    """Samples kept by ordered alternatives: in each cell the first group of conditions that enough pooled samples pass.

    Adds i, j and grp. A cell that no group fills drops its samples.
    """
    rows = settled(points, {"i": bin_index(angle_on_axis("twa", twa), twa), "j": bin_index("tws", tws)})
    rows = rows.where(F.col("i").isNotNull() & F.col("j").isNotNull())
    passing = F.array_compact(F.array(*[F.when(holds(g), F.lit(k)) for k, g in enumerate(groups)]))
    counted = rows.select("i", "j", F.explode(passing).alias("grp")).groupBy("i", "j", "grp").count()
    chosen = counted.where(F.col("count") >= min_samples).groupBy("i", "j").agg(F.min("grp").alias("grp"))
    passes = F.lit(False)
    for k, g in enumerate(groups):
        passes = passes | ((F.col("grp") == k) & holds(g))
    return rows.join(chosen, ["i", "j"]).where(passes)


def priority_segment(points: DataFrame, twa: list[float], tws: list[float], groups: list[Column], min_samples: int, fraction: float = 0.9) -> DataFrame:
    """i, j, grp, n, spread and the percentile of each cell, from the first group of conditions that enough samples pass; the zero row aside.

    Every group is counted in one pass over the samples, and the choice is made among cells.
    """
    rows = settled(points, {"i": bin_index(angle_on_axis("twa", twa), twa), "j": bin_index("tws", tws)})
    rows = rows.where(holds(F.col("bsp") >= 0) & ~F.isnan("bsp") & F.col("i").isNotNull() & F.col("j").isNotNull())
    passing = F.array_compact(F.array(*[F.when(holds(g), F.lit(k)) for k, g in enumerate(groups)]))
    cells = percentile_by(rows.select("i", "j", "bsp", F.explode(passing).alias("grp")), ["i", "j", "grp"], "bsp", fraction)
    zero = [k for k, a in enumerate(twa) if a in (0.0, 360.0)]
    # as many rows as cells and groups
    first = Window.partitionBy("i", "j").orderBy("grp")
    chosen = cells.where((F.col("n") >= min_samples) & ~F.col("i").isin(zero)).withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return chosen.select("i", "j", "grp", "n", knots("spread").alias("spread"), knots("value").alias("bsp"))


def _bracket(nodes: DataFrame, queries: DataFrame, key: list[str], at: str, x: str) -> DataFrame:
    """The nearest nodes on either side of each query's place x among nodes with the same keys, as structs lo and hi (at, v); both the same on a node."""
    pair = F.struct(F.col(at).alias("a"), F.col("bsp").alias("v"))
    both = queries.join(nodes.select(*key, at, "bsp"), key)
    return both.groupBy(*queries.columns).agg(F.max(F.when(F.col(at) <= F.col(x) + ON_AXIS, pair)).alias("lo"), F.min(F.when(F.col(at) >= F.col(x) - ON_AXIS, pair)).alias("hi")).where("lo is not null and hi is not null")


def _between(x: str) -> Column:
    t = (F.col(x) - F.col("lo.a")) / (F.col("hi.a") - F.col("lo.a"))
    return F.when(F.col("hi.a") - F.col("lo.a") <= ON_AXIS, F.col("lo.v")).otherwise(F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * t)


def resample(cells: DataFrame, twa: list[float], tws: list[float], excluded: DataFrame | None = None) -> DataFrame:
    """Every source read at every cell of the axes: (source_id, i, j, bsp), without the cells where a source says nothing.

    Each wind-speed column is read between its own nearest known angles, then the two columns on either side are; nothing is
    extrapolated. A column of ``cells`` with a null bsp still belongs to the axes. A cell that was read from a node in
    ``excluded`` (source_id, twa, tws) is left out.
    """
    spark = cells.sparkSession
    span = cells.groupBy("source_id").agg(F.max("twa").alias("_max"), F.min("twa").alias("_min"))
    q = span.join(F.broadcast(grid(spark, twa, tws).withColumnsRenamed({"twa": "_twa", "tws": "s"})))
    q = q.withColumn("a", F.when(F.col("_max") > 180, F.col("_twa")).otherwise(fold_twa("_twa"))).where((F.col("a") >= F.col("_min") - ON_AXIS) & (F.col("a") <= F.col("_max") + ON_AXIS))
    # the two columns of wind speed around each query, whether or not they hold values
    columns = cells.select("source_id", "tws").distinct()
    q = q.select("source_id", "i", "j", "a", "s").join(columns, "source_id").groupBy("source_id", "i", "j", "a", "s").agg(F.max(F.when(F.col("tws") <= F.col("s") + ON_AXIS, F.col("tws"))).alias("s0"), F.min(F.when(F.col("tws") >= F.col("s") - ON_AXIS, F.col("tws"))).alias("s1"))
    q = q.where("s0 is not null and s1 is not null")
    sides = q.withColumn("tws", F.explode(F.array_distinct(F.array("s0", "s1"))))
    known = cells.where("bsp is not null")
    read = _bracket(known, sides, ["source_id", "tws"], "twa", "a")
    read = settled(read, {"v": _between("a")})
    if excluded is not None:
        gone = excluded.select("source_id", "twa", "tws").distinct()
        used = read.select("source_id", "i", "j", "tws", F.explode(F.array_distinct(F.array("lo.a", "hi.a"))).alias("twa"))
        bad = used.join(gone, ["source_id", "twa", "tws"], "left_semi").select("source_id", "i", "j").distinct()
        read = read.join(bad, ["source_id", "i", "j"], "left_anti")
    value = F.struct(F.col("tws").alias("a"), F.col("v"))
    out = read.groupBy("source_id", "i", "j", "s", "s0", "s1").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return out.where(F.col("n") == F.when(F.col("s0") == F.col("s1"), 1).otherwise(2)).select("source_id", "i", "j", _between("s").alias("bsp"))


def directional(cells: DataFrame, full_circle: bool) -> DataFrame:
    """Sources brought to one side (pairs averaged) or both sides (nodes seeded on each); those already there are kept."""
    full = cells.groupBy("source_id").agg((F.max("twa") > 180).alias("full"))
    rows = cells.join(full, "source_id")
    same, other = rows.where(F.col("full") == full_circle).drop("full"), rows.where(F.col("full") != full_circle)
    if full_circle:
        sides = F.array_distinct(F.array(F.col("twa"), 360.0 - F.col("twa")))
        turned = other.withColumn("twa", F.explode(sides)).drop("full")
    else:
        turned = other.withColumn("twa", fold_twa("twa")).groupBy("source_id", "twa", "tws").agg(F.avg("bsp").alias("bsp"))
    return same.select("source_id", "twa", "tws", "bsp").unionByName(turned.select("source_id", "twa", "tws", "bsp"))


def overridden(cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """Cells with the overrides (source_id, twa, tws, bsp) that name one of their nodes written in."""
    o = overrides.select("source_id", "twa", "tws", F.col("bsp").alias("_o"))
    return cells.join(o, ["source_id", "twa", "tws"], "left").withColumn("bsp", F.coalesce("_o", "bsp")).drop("_o")


def vpp_to_cells(table: DataFrame, optimum: DataFrame) -> DataFrame:
    """A certificate's speed table (source_id, twa, tws, bsp) with its optimum points (source_id, tws, twa, vmg, upwind).

    An optimum point has speed VMG over the cosine of its angle, at its own wind speed; the table's own value wins.
    """
    cos = F.cos(F.radians("twa"))
    along = F.when(F.col("upwind"), cos).otherwise(-cos)
    good = F.when(F.col("upwind"), (F.col("twa") > 0) & (F.col("twa") < 90)).otherwise((F.col("twa") > 90) & (F.col("twa") <= 180)) & (F.col("vmg") >= 0) & (along > 1e-9)
    points = optimum.where(good).select("source_id", "twa", "tws", (F.col("vmg") / along).alias("bsp"), F.lit(1).alias("rank"))
    own = table.where("bsp is not null and twa between 0 and 180").select("source_id", "twa", "tws", "bsp", F.lit(0).alias("rank"))
    return own.unionByName(points).groupBy("source_id", "twa", "tws").agg(F.min_by("bsp", "rank").alias("bsp"))


def scaled(cells: DataFrame, percent: float, most: float = 60.0) -> DataFrame:
    """Overrides that a scale tool gives to cells with a value, kept between 0 and what a cell can hold."""
    return cells.where("bsp is not null").withColumn("bsp", F.greatest(F.lit(0.0), F.least(F.lit(most), F.col("bsp") * (1.0 + percent / 100.0))))


def curves_of(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys and ``curve``: the known points of each key in order, as structs (x, y, m) with the slope of a shape-preserving cubic at each.

    Slopes come from neighbouring steps, so windows suffice; a curve has at most as many points as an axis.
    """
    w = Window.partitionBy(*keys).orderBy("x")
    rows = points.where(F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).alias("y"))
    rows = rows.withColumns({"h": F.lead("x").over(w) - F.col("x"), "d": (F.lead("y").over(w) - F.col("y")) / (F.lead("x").over(w) - F.col("x"))})
    rows = rows.withColumns({"h0": F.lag("h").over(w), "d0": F.lag("d").over(w), "h00": F.lag("h", 2).over(w), "d00": F.lag("d", 2).over(w), "h1": F.lead("h").over(w), "d1": F.lead("d").over(w)})

    def end(ha, hb, da, db):
        slope = ((2.0 * ha + hb) * da - ha * db) / (ha + hb)
        return F.when(db.isNull(), da).when(slope * da <= 0, 0.0).when((da * db <= 0) & (F.abs(slope) > 3.0 * F.abs(da)), 3.0 * da).otherwise(slope)

    h, d, h0, d0 = (F.col(c) for c in ("h", "d", "h0", "d0"))
    w1, w2 = 2.0 * h + h0, h + 2.0 * h0
    inner = F.when(d0 * d <= 0, 0.0).otherwise((w1 + w2) / (w1 / d0 + w2 / d))
    m = F.when(h0.isNull() & h.isNotNull(), end(h, F.col("h1"), d, F.col("d1"))).when(h.isNull() & h0.isNotNull(), end(h0, F.col("h00"), d0, F.col("d00"))).otherwise(inner)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y", m.alias("m")))).alias("curve"))


def on_curve(curve, q) -> Column:
    """A curve read at q: a point's own value, the cubic between two, null outside."""
    curve, q = col(curve), col(q)

    def read(p):
        lo, hi = p["lo"], p["hi"]
        h = hi["x"] - lo["x"]
        t = (q - lo["x"]) / h
        y0, y1 = lo["y"], hi["y"]
        cubic = (2.0 * t * t * t - 3.0 * t * t + 1.0) * y0 + (t * t * t - 2.0 * t * t + t) * h * lo["m"] + (-2.0 * t * t * t + 3.0 * t * t) * y1 + (t * t * t - t * t) * h * hi["m"]
        return F.when(F.abs(q - lo["x"]) <= ON_AXIS, y0).when(hi.isNotNull() & lo.isNotNull(), F.greatest(F.least(cubic, F.greatest(y0, y1)), F.least(y0, y1)))

    # the points on either side are looked up once, as the one element of an array; beyond the ends there is none
    sides = F.transform(F.array(F.size(F.filter(curve, lambda p: p["x"] <= q + ON_AXIS))), lambda k: F.struct(F.get(curve, k - 1).alias("lo"), F.get(curve, k).alias("hi")))
    return F.get(F.transform(sides, read), 0)


def pchip(cells: DataFrame, twa: list[float], keys: tuple[str, ...] = ("source_id", "tws")) -> DataFrame:
    """Each column's shape-preserving cubic read at the angles: keys, i, bsp."""
    found = curves_of(cells, list(keys), "twa", "bsp").join(F.broadcast(axis_table(cells.sparkSession, twa, "i", "q")))
    return settled(found.select(*keys, "i", "curve", "q"), {"bsp": on_curve("curve", "q")}).where("bsp is not null").select(*keys, "i", "bsp")


def resample_cubic(cells: DataFrame, twa: list[float], tws: list[float], excluded: DataFrame | None = None) -> DataFrame:
    """Every source read at every cell of the axes by two curves: each column's at the angle, then one across the columns that have a value there.

    Only cells that :func:`resample` gives have a value, so that no curve leads across missing cells.
    """
    linear = resample(cells, twa, tws, excluded).select("source_id", "i", "j")
    full = cells.groupBy("source_id").agg((F.max("twa") > 180).alias("_full"))
    asked = full.join(F.broadcast(axis_table(cells.sparkSession, twa, "i", "_twa"))).select("source_id", "i", F.when(F.col("_full"), F.col("_twa")).otherwise(fold_twa("_twa")).alias("a"))
    along = settled(curves_of(cells, ["source_id", "tws"], "twa", "bsp").join(asked, "source_id").select("source_id", "tws", "i", "curve", "a"), {"v": on_curve("curve", "a")}).where("v is not null")
    across = curves_of(along, ["source_id", "i"], "tws", "v")
    read = linear.join(F.broadcast(axis_table(cells.sparkSession, tws, "j", "s")), "j").join(across, ["source_id", "i"])
    return settled(read.select("source_id", "i", "j", "curve", "s"), {"bsp": on_curve("curve", "s")}).select("source_id", "i", "j", "bsp")


def nearest_speeds(axis: list[float], wanted: list[float]) -> list[float]:
    """The axis's value nearest to each wanted speed, the lower on a tie, without repeats."""
    out = []
    for x in wanted:
        k = bisect_right(axis, x)
        near = min(axis[max(0, k - 1) : k + 1], key=lambda v: (abs(v - x), v), default=None)
        if near is not None and near not in out:
            out.append(near)
    return out


def curves(cells: DataFrame, tws: float | None = None) -> DataFrame:
    """Polar curves: at each wind speed of the source, or read at one wind speed between its columns; the zero row aside."""
    rows = cells.where("bsp is not null").where(~is_zero_row("twa"))
    if tws is None:
        return rows.select("source_id", "tws", "twa", "bsp")
    value = F.struct(F.col("tws").alias("a"), F.col("bsp").alias("v"))
    at = rows.withColumn("s", F.lit(float(tws))).groupBy("source_id", "twa", "s").agg(F.max(F.when(F.col("tws") <= F.col("s") + ON_AXIS, value)).alias("lo"), F.min(F.when(F.col("tws") >= F.col("s") - ON_AXIS, value)).alias("hi"))
    return at.where("lo is not null and hi is not null").select("source_id", F.col("s").alias("tws"), "twa", _between("s").alias("bsp"))
