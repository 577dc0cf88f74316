"""Fixes to samples: merging, import counts, derived motion, map lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tackline.functions.canonical import settled, wrap_360
from tackline.functions.geo import KNOT_M_S, distance_m, final_bearing, initial_bearing, mean_direction
from tackline.operators.chunks import CHUNK_S, with_neighbours


def _first(value: Column, order: str) -> Column:
    """The first value that is there, in the order of a column; a plain minimum, so it combines before the shuffle."""
    return F.min(F.when(value.isNotNull(), F.struct(F.col(order), value.alias("v")))).getField("v")


def normalise(fixes: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """One fix a track and time: the first fix's place and ``carried`` columns, the first given heading and speed, the first whole wind pair.

    Where the fixes are dealt by track already, this and the windows that follow need no further shuffle.
    """
    carried = carried or []
    wind = F.struct("tws", "twd_from")
    whole = F.when(F.col("tws").isNotNull() & F.col("twd_from").isNotNull(), wind)
    merged = fixes.groupBy("track_id", "t").agg(
        F.min("fix_idx").alias("fix_idx"),
        *[_first(F.col(c), "fix_idx").alias(c) for c in ("lat", "lon", "cog", "sog")],
        _first(whole, "fix_idx").alias("whole"),
        F.min(F.struct(F.col("fix_idx"), wind.alias("v"))).getField("v").alias("first_wind"),
        F.min_by(F.struct("fix_idx", *carried), "fix_idx").alias("first"),
    )
    kept = F.coalesce("whole", "first_wind")
    return merged.select("track_id", "t", "fix_idx", "lat", "lon", "cog", "sog", kept["tws"].alias("tws"), kept["twd_from"].alias("twd_from"), *[F.col("first").getField(c).alias(c) for c in carried])


def import_report(fixes: DataFrame) -> DataFrame:
    """By track: fixes, those merged into another, those out of order, and how many carry each given value."""
    before = F.lag("t").over(Window.partitionBy("track_id").orderBy("fix_idx"))
    rows = fixes.withColumn("_back", F.coalesce(F.col("t") < before, F.lit(False)))
    return rows.groupBy("track_id").agg(
        F.count("*").alias("fixes"),
        (F.count("*") - F.countDistinct("t")).alias("duplicates"),
        F.count_if("_back").alias("out_of_order"),
        F.count("cog").alias("given_headings"),
        F.count("sog").alias("given_speeds"),
        F.count_if(F.col("tws").isNotNull() & F.col("twd_from").isNotNull()).alias("wind_pairs"),
    )


def derive(fixes: DataFrame, max_gap_s: int = 10_800, prefer_heading: str = "given", prefer_speed: str = "given", chunk_s: int | None = CHUNK_S) -> DataFrame:
    """Adds heading and speed with their origins: given, or derived from neighbours no further away in time than the gap."""
    return from_neighbours(with_neighbours(fixes, ["t", "lat", "lon"], chunk_s), max_gap_s, prefer_heading, prefer_speed)


def from_neighbours(rows: DataFrame, max_gap_s: int = 10_800, prefer_heading: str = "given", prefer_speed: str = "given") -> DataFrame:
    """The same, of fixes that hold their neighbours (t, lat, lon) in _before and _after."""
    for side, other in (("p", "_before"), ("n", "_after")):
        near = F.abs(F.col(other)["t"] - F.col("t")) <= max_gap_s
        rows = rows.withColumns({f"_{side}{c}": F.when(near, F.col(other)[c]) for c in ("t", "lat", "lon")})
    arriving, leaving = final_bearing("_plat", "_plon", "lat", "lon"), initial_bearing("lat", "lon", "_nlat", "_nlon")
    rows = settled(rows, {
        "_arrive": arriving, "_leave": leaving,
        "_leg": F.when(F.col("_pt").isNotNull() | F.col("_nt").isNotNull(), F.coalesce(distance_m("_plat", "_plon", "lat", "lon"), F.lit(0.0)) + F.coalesce(distance_m("lat", "lon", "_nlat", "_nlon"), F.lit(0.0))),
        "_seconds": (F.coalesce("_nt", "t") - F.coalesce("_pt", "t")).cast("double"),
    })
    both = F.col("_arrive").isNotNull() & F.col("_leave").isNotNull()
    heading = F.when(both, mean_direction("_arrive", "_leave")).otherwise(F.coalesce("_arrive", "_leave"))
    speed = F.when(F.col("_seconds") > 0, F.col("_leg") / F.col("_seconds") / KNOT_M_S)
    rows = settled(rows, {"_dh": heading, "_ds": speed, "_gh": F.when(~F.isnan("cog"), wrap_360("cog")), "_gs": F.when(~F.isnan("sog") & (F.col("sog") >= 0), F.col("sog"))})
    out = {}
    for name, given, found, prefer in (("heading", "_gh", "_dh", prefer_heading), ("speed", "_gs", "_ds", prefer_speed)):
        first, second = (given, found) if prefer == "given" else (found, given)
        label = {given: "given", found: "derived"}
        out[name] = F.coalesce(first, second)
        out[f"{name}_origin"] = F.when(F.col(first).isNotNull(), label[first]).when(F.col(second).isNotNull(), label[second])
    return settled(rows, out).drop(*[c for c in rows.columns if c.startswith("_")])


def unwrapped_longitude(points: DataFrame) -> DataFrame:
    """Adds line_lon: longitude carried on by the shortest step from point to point, so that a line never jumps across the map."""
    w = Window.partitionBy("track_id").orderBy("t", "fix_idx")
    step = F.col("lon") - F.lag("lon").over(w)
    short = step - 360.0 * F.floor((step + 180.0) / 360.0)
    return points.withColumn("_step", F.coalesce(short, F.col("lon"))).withColumn("line_lon", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def preview(points: DataFrame, most: int = 64) -> DataFrame:
    """At most ``most`` points a track, evenly by position, first and last included."""
    by = Window.partitionBy("track_id")
    rows = points.withColumns({"_k": F.row_number().over(by.orderBy("t", "fix_idx")) - 1, "_n": F.count("*").over(by)})
    m = F.least(F.col("_n"), F.lit(most))
    wanted = F.floor(F.col("_i") * (F.col("_n") - 1) / F.greatest(m - 1, F.lit(1)))
    # position k is wanted if some i below m maps to it: the least such i is known in closed form
    i = F.ceil(F.col("_k") * F.greatest(m - 1, F.lit(1)) / F.greatest(F.col("_n") - 1, F.lit(1)))
    rows = rows.withColumn("_i", i).where((F.col("_i") < m) & (wanted == F.col("_k")))
    return rows.select("track_id", F.col("_i").cast("long").alias("position"), F.round(F.col("lat") * 1e4).alias("lat_e4"), F.round(F.col("lon") * 1e4).alias("lon_e4"))
