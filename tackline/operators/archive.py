"""Written weather archives: read by blocks of time and place, several quantities at once.

An archive is a wide table (step, i, j, quantities) in folders by blocks of steps, rows and
columns. A reading first finds the extent of what its points need, one row, and scans only
the folders within it; each point then meets its at most eight cells once for all quantities.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tackline.operators.races import in_region
from tackline.operators.weather import Axes, first_tier, in_time, stencil_keys

#: Steps, rows and columns of a block.
BLOCK = (31, 5, 10)
INDEX = ("step", "i", "j")


@dataclass(frozen=True)
class Source:
    """An archive's folder and axes; ``box`` (south, north, west, east), inclusive, if it holds a region only."""

    path: str
    axes: Axes
    box: tuple[float, float, float, float] | None = None


def write(cells: DataFrame, path: str, block: tuple[int, int, int] = BLOCK) -> None:
    """Write (step, i, j, quantities). A block's rows go to one file each."""
    blocks = {f"{c}_block": F.floor(F.col(c) / n).cast("int") for c, n in zip(INDEX, block, strict=True)}
    cells.withColumns(blocks).repartition(*blocks).sortWithinPartitions(*blocks, *INDEX).write.partitionBy(*blocks).parquet(path)


def opened(spark: SparkSession, source: Source) -> DataFrame | None:
    """The archive's rows, or None where it cannot be read: what falls back on others goes on without it."""
    try:
        return spark.read.parquet(source.path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def within(points: DataFrame, source: Source) -> DataFrame:
    """The points in the source's box and on its axes of time."""
    last = source.axes.t0 + (source.axes.steps - 1) * source.axes.dt
    rows = points.where(F.col("t").between(source.axes.t0, last))
    return rows.where(in_region("lat", "lon", source.box)) if source.box else rows


def pruned(archive: DataFrame, keys: DataFrame, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """The archive's blocks within the extent of the keys, found by a small job."""
    extent = keys.agg(*[f(c).alias(f"{c}_{n}") for c in INDEX for n, f in (("low", F.min), ("high", F.max))]).first()
    if extent[0] is None:
        return archive.where("false")
    return archive.where(reduce(lambda a, b: a & b, [F.col(f"{c}_block").between(extent[f"{c}_low"] // n, extent[f"{c}_high"] // n) for c, n in zip(INDEX, block, strict=True)]))


def sample(points: DataFrame, archive: DataFrame, axes: Axes, scalars: list[str], directions: list[str] = [], block: tuple[int, int, int] = BLOCK) -> DataFrame:  # noqa: B006
    """point_id and each quantity in one join: over the corners that hold it, then in time; directions, in degrees, as unit vectors. Points without any are left out."""
    keys = stencil_keys(points, axes)
    parts = {c: F.col(c) for c in scalars}
    for c in directions:
        parts |= {f"{c}|sin": F.sin(F.radians(c)), f"{c}|cos": F.cos(F.radians(c))}
    names = {c: f"q{k}" for k, c in enumerate(parts)}
    cells = pruned(archive, keys, block).select(*INDEX, *[p.alias(names[c]) for c, p in parts.items()])
    # at most four corners of a side, in one order, so that sums are the same bit for bit
    terms = F.array_sort(F.collect_list(F.struct("i", "j", "weight", *names.values())))
    sides = keys.join(cells, list(INDEX)).groupBy("point_id", "side", "tw").agg(terms.alias("terms"))

    def mean(q: str) -> Column:
        total = F.aggregate("terms", F.lit(0.0), lambda s, x: s + F.when(x[q].isNotNull(), x["weight"]).otherwise(0.0))
        return F.when(total > 1e-12, F.aggregate("terms", F.lit(0.0), lambda s, x: s + F.coalesce(x["weight"] * x[q], F.lit(0.0))) / total)

    sides = sides.select("point_id", "side", "tw", *[mean(q).alias(q) for q in names.values()])
    both = sides.groupBy("point_id").agg(F.max("tw").alias("w"), *[F.max(F.when(F.col("side") == k, F.col(q))).alias(f"{q}_{k}") for q in names.values() for k in (0, 1)])
    at = {c: in_time(F.col(f"{q}_0"), F.col(f"{q}_1"), F.col("w")) for c, q in names.items()}
    turned = {c: F.when(F.hypot(at[f"{c}|sin"], at[f"{c}|cos"]) >= 1e-9, F.pmod(F.degrees(F.atan2(at[f"{c}|sin"], at[f"{c}|cos"])), F.lit(360.0))) for c in directions}
    out = both.select("point_id", *[at[c].alias(c) for c in scalars], *[v.alias(c) for c, v in turned.items()])
    return out.where(F.coalesce(*scalars, *directions).isNotNull())


def combined(points: DataFrame, source: Source) -> DataFrame:
    """Wind, current and waves of one archive: point_id, wind, current and waves as structs.

    A vector is null if either part is; waves are there if any of direction, height and period is.
    """
    got = sample(points, points.sparkSession.read.parquet(source.path), source.axes, ["u10", "v10", "ucur", "vcur", "hs", "period"], ["wave_from"])
    vector = lambda u, v: F.when(F.col(u).isNotNull() & F.col(v).isNotNull(), F.struct(F.col(u).alias("u"), F.col(v).alias("v")))
    waves = F.when(F.coalesce("wave_from", "hs", "period").isNotNull(), F.struct("wave_from", "hs", "period"))
    return got.select("point_id", vector("u10", "v10").alias("wind"), vector("ucur", "vcur").alias("current"), waves.alias("waves"))


def switched(points: DataFrame, first: Source, second: Source, u: str = "u10", v: str = "v10") -> DataFrame:
    """point_id, u, v, dataset (0 or 1): points on the first source's axis of time are read there, and only there, all others in the second."""
    last = first.axes.t0 + (first.axes.steps - 1) * first.axes.dt
    own = F.coalesce(F.col("t").between(first.axes.t0, last), F.lit(False))
    rows = None
    for k, (source, mine) in enumerate(((first, own), (second, ~own))):
        archive = opened(points.sparkSession, source)
        if archive is not None:
            got = sample(points.where(mine), archive, source.axes, [u, v]).where(F.col(u).isNotNull() & F.col(v).isNotNull()).select("point_id", F.col(u).alias("u"), F.col(v).alias("v"), F.lit(k).alias("dataset"))
            rows = got if rows is None else rows.unionByName(got)
    return rows if rows is not None else points.sparkSession.createDataFrame([], "point_id long, u double, v double, dataset int")


def tiered(points: DataFrame, tiers: list[tuple[Source, list[tuple[str, str]]]]) -> DataFrame:
    """point_id, u, v, tier: the first source, in order, that has every part of the vector at the point; parts are summed.

    A source is asked only for points in its box, and one that cannot be read is passed over.
    """
    found = []
    for source, parts in tiers:
        archive, names = opened(points.sparkSession, source), [c for p in parts for c in p]
        if archive is None:
            found.append(None)
            continue
        got = sample(within(points, source), archive, source.axes, names)
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
        add = lambda k, parts=parts: reduce(lambda a, b: a + b, [F.col(p[k]) for p in parts])
        found.append(got.where(whole).select("point_id", F.struct(add(0).alias("u"), add(1).alias("v")).alias("value")))
    empty = points.sparkSession.createDataFrame([], "point_id long, value struct<u:double,v:double>")
    return first_tier([empty if t is None else t for t in found]).select("point_id", "value.u", "value.v", "tier")
