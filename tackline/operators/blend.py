"""Blending weighted sources into one polar, filling and smoothing it.

Evidence is a long table (source_id, i, j, bsp, weight). Cells of a grid are
at most 512 x 512, whatever the number of boats; ``keys`` (a boat, a wave
bucket) multiply them and become grouping and window keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tackline.functions.canonical import is_zero_row, knots, settled
from tackline.operators import polar


def confidence(n: Column, n_full: int) -> Column:
    """Tracks count by their samples, up to full confidence."""
    return F.least(n / float(max(1, n_full)), F.lit(1.0))


def track_evidence(cells: DataFrame, weights: DataFrame, n_full: int, overrides: DataFrame | None = None) -> DataFrame:
    """Segments (source_id, i, j, n, bsp) as evidence; an overridden cell counts in full, also where it has no samples."""
    rows = cells.select("source_id", "i", "j", "n", "bsp", F.lit(False).alias("fixed"))
    if overrides is not None:
        o = overrides.select("source_id", "i", "j", F.col("bsp").alias("_o"))
        rows = rows.join(o, ["source_id", "i", "j"], "full").select("source_id", "i", "j", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("_o", "bsp").alias("bsp"), F.col("_o").isNotNull().alias("fixed"))
    share = F.when(F.col("fixed"), 1.0).otherwise(confidence(F.col("n"), n_full))
    return rows.where("bsp is not null").join(weights, "source_id").select("source_id", "i", "j", "bsp", (F.col("weight") * share).alias("weight"))


def direct(evidence: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The weighted mean of each cell, summed in order of source so that it is the same bit for bit; keys, i, j, value.

    The list that is summed has a row a source of one cell, not of samples.
    """
    terms = F.array_sort(F.collect_list(F.struct("source_id", "weight", "bsp")))
    cells = evidence.where("weight > 0 and bsp is not null").groupBy(*keys, "i", "j").agg(terms.alias("terms"))
    total = F.aggregate("terms", F.lit(0.0), lambda s, x: s + x["weight"] * x["bsp"]) / F.aggregate("terms", F.lit(0.0), lambda s, x: s + x["weight"])
    return cells.select(*keys, "i", "j", total.alias("value"))


def contributions(evidence: DataFrame, i: int, j: int) -> DataFrame:
    """What stands behind one cell: each source's speed, weight and share."""
    rows = evidence.where((F.col("i") == i) & (F.col("j") == j) & (F.col("weight") > 0) & F.col("bsp").isNotNull())
    total = rows.agg(F.sum("weight").alias("total"))
    return rows.join(F.broadcast(total)).select("source_id", "bsp", "weight", (F.col("weight") / F.col("total")).alias("share"))


def _fill(cells: DataFrame, keys: list[str], at: str, value: str) -> Column:
    """Between the nearest known values on either side, along ``at``; null beyond them."""
    w = Window.partitionBy(*keys).orderBy(at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("a"), F.col(value).alias("v")))
    lo, hi = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(known, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    t = (F.col(at) - lo["a"]) / (hi["a"] - lo["a"])
    return F.coalesce(F.col(value), lo["v"] + t * (hi["v"] - lo["v"]))


def _fill_cubic(rows: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the value, or the cubic through a line's known values where it lies between two."""
    curves = polar.curves_of(rows, keys, at, value)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    rows = rows.join(curves.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "curve"), on, "left").drop(*[f"_c_{k}" for k in keys])
    return settled(rows, {out: F.coalesce(value, polar.on_curve("curve", at))}).drop("curve")


def filled(values: DataFrame, twa: list[float], tws: list[float], keys: tuple[str, ...] = (), cubic: bool = False) -> DataFrame:
    """The whole grid: keys, i, twa, j, tws, value and origin (direct, filled, empty).

    Filled along the angles from direct values, then along wind speeds from what that left, straight or by shape-preserving
    cubics. The zero row is no anchor and is 0.
    """
    spark = values.sparkSession
    cells = polar.grid(spark, twa, tws)
    if keys:
        cells = values.select(*keys).distinct().join(F.broadcast(cells))
    rows = cells.join(values, [*keys, "i", "j"], "left")
    zero = is_zero_row("twa")
    rows = rows.withColumns({"_d": F.col("value").isNotNull(), "_v0": F.when(~zero, F.col("value"))})
    # the zero row is kept out of the windows by a partition of its own
    rows = rows.withColumn("_z", zero)
    if cubic:
        rows = _fill_cubic(_fill_cubic(rows, [*keys, "j", "_z"], "twa", "_v0", "_v1"), [*keys, "i"], "tws", "_v1", "_v2")
    else:
        rows = rows.withColumn("_v1", F.when(~F.col("_z"), _fill(rows, [*keys, "j", "_z"], "twa", "_v0")))
        rows = rows.withColumn("_v2", F.when(~F.col("_z"), _fill(rows, [*keys, "i"], "tws", "_v1")))
    origin = F.when(F.col("_d"), "direct").when(F.col("_z") | F.col("_v2").isNotNull(), "filled").otherwise("empty")
    return rows.select(*keys, "i", "twa", "j", "tws", F.when(F.col("_z"), 0.0).otherwise(F.col("_v2")).alias("value"), origin.alias("origin"))


def smoothed(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The 1-2-1 by 1-2-1 kernel over cells that have a value; the zero row neither changes nor takes part."""
    steps = F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit(float((2 - abs(di)) * (2 - abs(dj)))).alias("k")) for di in (-1, 0, 1) for dj in (-1, 0, 1)])
    near = cells.where(F.col("value").isNotNull() & ~is_zero_row("twa")).withColumn("s", F.explode(steps))
    near = near.select(*keys, (F.col("i") + F.col("s.di")).alias("i"), (F.col("j") + F.col("s.dj")).alias("j"), F.struct(-F.col("s.di"), -F.col("s.dj"), F.col("s.k").alias("k"), F.col("value").alias("v")).alias("x"))
    # nine terms at most, summed in order of place
    terms = near.groupBy(*keys, "i", "j").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    mean = F.aggregate("xs", F.lit(0.0), lambda s, x: s + x["k"] * x["v"]) / F.aggregate("xs", F.lit(0.0), lambda s, x: s + x["k"])
    out = cells.join(terms, [*keys, "i", "j"], "left")
    return out.withColumn("value", F.when(F.col("value").isNull() | is_zero_row("twa") | F.col("xs").isNull(), F.col("value")).otherwise(mean)).drop("xs")


def corrected(cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual corrections (twa, tws, bsp) after the blend: they become direct values; the zero row stays 0."""
    o = overrides.select("twa", "tws", F.col("bsp").alias("_o"))
    rows = cells.join(o, ["twa", "tws"], "left")
    return rows.withColumns({"value": F.when(is_zero_row("twa"), 0.0).otherwise(F.coalesce("_o", "value")), "origin": F.when(F.col("_o").isNotNull(), "direct").otherwise(F.col("origin"))}).drop("_o")


def coverage(cells: DataFrame) -> DataFrame:
    """Cells by origin, the zero row aside."""
    rows = cells.where(~is_zero_row("twa"))
    return rows.agg(*[F.count_if(F.col("origin") == o).alias(o) for o in ("direct", "filled", "empty")])


def blend(evidence: DataFrame, twa: list[float], tws: list[float], smoothing: bool = False, keys: tuple[str, ...] = (), cubic: bool = False) -> DataFrame:
    """Direct means, both fills, smoothing if asked, and rounding: keys, i, twa, j, tws, bsp, origin."""
    cells = filled(direct(evidence, keys), twa, tws, keys, cubic)
    cells = smoothed(cells, keys) if smoothing else cells
    return cells.withColumn("bsp", knots("value")).drop("value")


def resampled(blended: DataFrame, twa: list[float], tws: list[float], cubic: bool = False) -> DataFrame:
    """A blend (twa, tws, bsp) on other axes: the zero row is no anchor, and an output zero row is 0; i, j, bsp."""
    cells = blended.select(F.lit(0).alias("source_id"), "twa", "tws", F.when(~is_zero_row("twa"), F.col("bsp")).alias("bsp"))
    read = (polar.resample_cubic if cubic else polar.resample)(cells, twa, tws).select("i", "j", F.col("bsp").alias("_v"))
    out = polar.grid(blended.sparkSession, twa, tws).join(read, ["i", "j"], "left")
    return out.select("i", "twa", "j", "tws", F.when(is_zero_row("twa"), 0.0).otherwise(knots("_v")).alias("bsp"))
