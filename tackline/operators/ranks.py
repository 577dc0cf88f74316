"""Exact percentiles of groups of any size.

Values are counted by bucket, an eighth of a unit wide below 128 and an eighth of a
doubling above, so that a group has some thousands of buckets at most; running
counts tell which buckets hold the wanted ranks, and only in those are values put in
order. Rows shuffle as counted different values under all of (group, bucket, value): a
group that holds nearly all rows is dealt over many tasks, and none sorts it whole. The
counts are written while the query is built, so that the rows are read once; moments come
from the same counts, about the middle of each bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tackline.durable import written
from tackline.functions.canonical import col

#: Below this, buckets are of one width.
EVEN = 128.0


def bucket(value) -> Column:
    """Ascending with the value; for values of 0 or more."""
    v = col(value)
    return F.when(v < EVEN, F.floor(v * 8.0)).otherwise(F.floor(F.least(F.log2(v / EVEN), F.lit(1024.0)) * 8.0) + int(EVEN * 8)).cast("int")


def _middle(b: Column) -> Column:
    return F.when(b < int(EVEN * 8), (b + 0.5) / 8.0).otherwise(EVEN * F.pow(F.lit(2.0), (b - int(EVEN * 8) + 0.5) / 8.0))


def percentile_by(rows: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """keys, n, spread (of a sample) and value: the percentile interpolated between ranks. Values are 0 or more and not null; keys may be null."""
    counted = written(rows.groupBy(*keys, bucket(value).alias("_b"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    off = F.col("_v") - _middle(F.col("_b"))
    parts = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * off).alias("_d"), F.sum(F.col("_c") * off * off).alias("_q"))
    # a row a bucket of a group
    group = Window.partitionBy(*keys)
    parts = parts.withColumns({"n": F.sum("_n").over(group), "_upto": F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))})
    middle = _middle(F.col("_b"))
    parts = parts.withColumns({"_mean": F.sum(F.col("_n") * middle + F.col("_d")).over(group) / F.col("n"), "_upto": F.coalesce("_upto", F.lit(0))})
    gap = middle - F.col("_mean")
    parts = parts.withColumn("_m2", F.sum(F.col("_q") + 2.0 * gap * F.col("_d") + F.col("_n") * gap * gap).over(group))
    rank = (F.col("n") - 1) * F.lit(float(fraction))
    parts = parts.withColumns({"_rank": rank, "_lo": F.floor(rank), "_hi": F.ceil(rank)})
    holds = lambda r: (F.col("_upto") <= F.col(r)) & (F.col(r) < F.col("_upto") + F.col("_n"))
    wanted = parts.where(holds("_lo") | holds("_hi")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_wb"), "n", "_upto", "_m2", "_rank", "_lo", "_hi")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_b") == F.col("_wb"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = counted.join(wanted, same).withColumn("_to", F.col("_upto") + F.sum("_c").over(inside))
    at = lambda r: F.max(F.when((F.col("_to") - F.col("_c") <= F.col(r)) & (F.col(r) < F.col("_to")), F.col("_v")))
    found = near.groupBy(*keys).agg(F.max("n").alias("n"), F.max("_m2").alias("_m2"), F.max("_rank").alias("_rank"), at("_lo").alias("_x"), at("_hi").alias("_y"))
    between = F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise(F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_rank") - F.floor("_rank")))
    return found.select(*keys, "n", F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("_m2"), F.lit(0.0)) / (F.col("n") - 1))).alias("spread"), between.alias("value"))
