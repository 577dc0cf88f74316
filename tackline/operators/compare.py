"""Comparing two polars cell by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tackline.functions.canonical import is_zero_row, knots, rounded

#: Below this speed a percentage says nothing; the default threshold of a region.
MIN_PERCENT_BASE_KN = 0.1
THRESHOLD_KN = 0.05


def cells(a: DataFrame, b: DataFrame, axes: DataFrame) -> DataFrame:
    """(i, twa, j, tws, a, b, delta_kn, delta_pct, class) of every cell of the axes (i, twa, j, tws).

    Both operands are (i, j, bsp) on those axes.
    """
    rows = axes.join(a.select("i", "j", F.col("bsp").alias("a")), ["i", "j"], "left").join(b.select("i", "j", F.col("bsp").alias("b")), ["i", "j"], "left")
    both = ~is_zero_row("twa") & F.col("a").isNotNull() & F.col("b").isNotNull()
    kind = F.when(is_zero_row("twa"), "zero_row").when(both, "both").when(F.col("a").isNotNull(), "a_only").when(F.col("b").isNotNull(), "b_only").otherwise("neither")
    pct = F.when(both & (F.col("b") >= MIN_PERCENT_BASE_KN), rounded((F.col("a") - F.col("b")) / F.col("b") * 100.0, 6))
    return rows.select("i", "twa", "j", "tws", "a", "b", F.when(both, knots(F.col("a") - F.col("b"))).alias("delta_kn"), pct.alias("delta_pct"), kind.alias("class"))


def stats(compared: DataFrame) -> DataFrame:
    """One row: counts by class, and for knots and percent the mean and largest size (with its first place) and the range."""
    out = [F.count_if(F.col("class") == c).alias(c) for c in ("both", "a_only", "b_only", "neither", "zero_row")]
    out.append(F.count_if((F.col("class") == "both") & F.col("delta_pct").isNull()).alias("pct_excluded"))
    for unit in ("kn", "pct"):
        d = F.col(f"delta_{unit}")
        # of equal sizes the first by angle, then wind speed
        first = F.max(F.when(d.isNotNull(), F.struct(F.abs(d).alias("d"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))))
        out += [rounded(F.avg(F.abs(d)), 6).alias(f"mean_abs_{unit}"), first["d"].alias(f"max_abs_{unit}"), (-first["i"]).alias(f"max_i_{unit}"), (-first["j"]).alias(f"max_j_{unit}"), F.min(d).alias(f"min_{unit}"), F.max(d).alias(f"max_{unit}")]
    return compared.agg(*out)


def regions(compared: DataFrame, threshold: float = THRESHOLD_KN) -> DataFrame:
    """Runs of neighbouring angles, by wind speed, where one side is faster by more than the threshold: (j, first_i, last_i, faster)."""
    if not threshold >= 0:
        raise ValueError(f"the threshold is not a speed of zero or more: {threshold}")
    side = F.when(F.col("delta_kn") > threshold, "a").when(F.col("delta_kn") < -threshold, "b")
    rows = compared.withColumn("faster", side).where("faster is not null")
    island = F.col("i") - F.row_number().over(Window.partitionBy("j", "faster").orderBy("i"))
    return rows.withColumn("_run", island).groupBy("j", "faster", "_run").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i")).drop("_run")
