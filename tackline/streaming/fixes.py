"""Live fixes: sessions and polar cells over an unbounded table.

State is bounded by the watermark: what is later than it is dropped, and what
it has passed is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tackline.operators.polar import angle_on_axis, bin_index


def sessions(fixes: DataFrame, gap: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """Stretches of a track without a gap: track_id, start, end, fixes. ``fixes`` has track_id and a timestamp ts."""
    s = F.session_window("ts", gap)
    return fixes.withWatermark("ts", late).groupBy("track_id", s.alias("w")).agg(F.count("*").alias("fixes")).select("track_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "fixes")


def live_cells(points: DataFrame, twa: list[float], tws: list[float], every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and mean speeds by window and cell of points (ts, twa, tws, bsp)."""
    rows = points.withWatermark("ts", late).withColumns({"i": bin_index(angle_on_axis("twa", twa), twa), "j": bin_index("tws", tws)})
    rows = rows.where("i is not null and j is not null and bsp >= 0")
    return rows.groupBy(F.window("ts", every).alias("w"), "i", "j").agg(F.count("*").alias("n"), F.avg("bsp").alias("bsp")).select(F.col("w.start").alias("start"), "i", "j", "n", "bsp")
