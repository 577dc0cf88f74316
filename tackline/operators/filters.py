"""Sample filters: predicates that mark, never delete.

A missing value fails a predicate that is set and is ignored by one that is
not, so every clause is closed over nulls before it is combined.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F

from tackline.functions import sailing
from tackline.functions.canonical import angle_between, holds, wrap_360
from tackline.operators.chunks import CHUNK_S, with_last_known, with_neighbours

Range = tuple[float | None, float | None]


@dataclass(frozen=True)
class SampleFilters:
    """Optional predicates; None leaves a quantity alone. Ranges are closed, directions run clockwise and wrap north."""

    min_bsp_kn: float | None = 1.0
    max_bsp_kn: float | None = None
    tws_kn: Range | None = None
    twa_deg: Range | None = None
    vmg_kn: Range | None = None
    wave_height_m: Range | None = None
    current_speed_kn: Range | None = None
    heading_deg: tuple[float, float] | None = None
    cog_deg: tuple[float, float] | None = None
    twd_deg: tuple[float, float] | None = None
    wave_sectors: tuple[str, ...] | None = None
    wave_relative: Range | None = None
    wave_cog: Range | None = None
    wave_absolute: tuple[float, float] | None = None
    time_window: tuple[int | None, int | None] | None = None
    exclude_unknown_wave: bool = False
    exclude_unknown_current: bool = False
    exclude_tacks: bool = False
    max_heading_change_deg: float | None = 30.0
    max_awa_change_deg: float | None = None
    max_wind_speed_change_kn: float | None = None
    max_wind_direction_change_deg: float | None = None

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name.startswith(("min_", "max_")) and value is not None and value < 0:
                raise ValueError(f"{f.name} is negative: {value}")
            if isinstance(value, tuple) and len(value) == 2 and f.name not in ("heading_deg", "cog_deg", "twd_deg", "wave_absolute", "wave_sectors") and None not in value and value[0] > value[1]:
                raise ValueError(f"{f.name} ends before it begins: {value}")


def in_range(value: Column, bounds: Range) -> Column:
    low, high = bounds
    ok = value.isNotNull()
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return holds(ok)


def in_compass(value: Column, bounds: tuple[float, float]) -> Column:
    start, end = bounds
    return holds(wrap_360(value - start) <= wrap_360(F.lit(float(end - start))))


def plain_predicates(f: SampleFilters, corrected: bool) -> list[Column]:
    """What a sample alone must satisfy."""
    twa, tws, _ = sailing.polar_point(corrected)
    placed = twa.isNotNull()
    twa, tws = F.when(placed, twa).otherwise(F.col("twa")), F.when(placed, tws).otherwise(F.col("wind_speed"))
    bsp = sailing.by_field(corrected, "bsp_corrected", "speed")
    heading = sailing.by_field(corrected, "heading_corrected", "heading")
    wind_from = sailing.by_field(corrected, "twd_from_corrected", "wind_from")
    out = []
    for bounds, value in ((f.tws_kn, tws), (f.twa_deg, twa), (f.vmg_kn, sailing.vmg(corrected)), (f.wave_height_m, F.col("hs_m")), (f.current_speed_kn, F.col("current_speed")), (f.wave_relative, F.col("wave_angle")), (f.wave_cog, angle_between("heading", "wave_from")), (f.time_window, F.col("t"))):
        if bounds is not None:
            out.append(in_range(value, bounds))
    for bounds, value in ((f.heading_deg, heading), (f.cog_deg, F.col("heading")), (f.twd_deg, wind_from), (f.wave_absolute, F.col("wave_from"))):
        if bounds is not None:
            out.append(in_compass(value, bounds))
    if f.wave_sectors is not None:
        out.append(holds(sailing.wave_sector("wave_angle").isin(*f.wave_sectors)))
    if f.min_bsp_kn is not None or f.max_bsp_kn is not None:
        out.append(in_range(bsp, (f.min_bsp_kn, f.max_bsp_kn)))
    if f.exclude_unknown_wave:
        out.append(F.col("hs_m").isNotNull() & F.col("wave_from").isNotNull())
    if f.exclude_unknown_current:
        out.append(F.col("current_speed").isNotNull() & F.col("current_toward").isNotNull())
    return out


def change_predicates(f: SampleFilters, corrected: bool, max_gap_s: int) -> dict[str, Column]:
    """Name to value of the metrics whose change between neighbours is limited."""
    metrics = {
        "heading": (f.max_heading_change_deg, True, sailing.by_field(corrected, "heading_corrected", "heading")),
        "awa": (f.max_awa_change_deg, True, sailing.apparent_wind_angle(corrected)),
        "wind_speed": (f.max_wind_speed_change_kn, False, sailing.by_field(corrected, "tws_corrected", "wind_speed")),
        "wind_from": (f.max_wind_direction_change_deg, True, sailing.by_field(corrected, "twd_from_corrected", "wind_from")),
    }
    return {k: v for k, v in metrics.items() if v[0] is not None}


def mark(samples: DataFrame, f: SampleFilters, corrected: bool = True, max_gap_s: int = 10_800, chunk_s: int | None = CHUNK_S) -> DataFrame:
    """Adds ``filtered``: whether the filters take a sample out. One pass for neighbours serves every predicate on changes."""
    rows, passes = samples, plain_predicates(f, corrected)
    changes = change_predicates(f, corrected, max_gap_s)
    rows = rows.withColumns({f"_m_{name}": F.when(metric >= 0, (wrap_360(metric) if circular else metric) + 0.0) for name, (_, circular, metric) in changes.items()})
    if changes:
        rows = with_neighbours(rows, ["t", *[f"_m_{name}" for name in changes]], chunk_s)
        close_before = holds(F.col("t") - F.col("_before")["t"] <= max_gap_s)
        close_after = holds(F.col("_after")["t"] - F.col("t") <= max_gap_s)
        still = F.lit(True)
        for name, (limit, circular, _) in changes.items():

            def far(other, at=f"_m_{name}", circular=circular, limit=limit):
                d = F.abs(F.col(other)[at] - F.col(at))
                return holds((F.least(d, 360.0 - d) if circular else d) > limit)

            still = still & ~((close_before & far("_before")) | (close_after & far("_after")))
        # settled here, since tacks have neighbours of their own
        rows = rows.withColumn("_m_still", still).drop("_before", "_after")
        passes.append(F.col("_m_still"))
    if f.exclude_tacks:
        rows = tack_changes(rows, corrected, max_gap_s, chunk_s)
        passes.append(~F.col("_tacked"))
    kept = F.lit(True)
    for p in passes:
        kept = kept & p
    rows = rows.withColumn("filtered", ~kept)
    return rows.drop(*[c for c in rows.columns if c.startswith(("_m_", "_tacked"))])


def tack_changes(samples: DataFrame, corrected: bool, max_gap_s: int, chunk_s: int | None = CHUNK_S) -> DataFrame:
    """Adds ``_tacked``: the samples on either side of a change of tack.

    A sample without a place in the polar starts a new stretch. Within one, the
    last sample with a side is compared if it is no further away than the gap;
    samples that have a place but no side bridge a change.
    """
    twa, _, _ = sailing.polar_point(corrected)
    side = F.when(F.lit(corrected) & F.col("twa_corrected").isNotNull(), F.col("tack_corrected")).otherwise(F.col("tack"))
    rows = samples.withColumns({"_side": side, "_breaks": side.isNull() & twa.isNull()})
    rows = with_last_known(rows, F.col("_breaks"), F.when(F.col("_side").isNotNull(), F.struct("t", F.col("_side").alias("side"))), chunk_s)

    def differs(other):
        return holds(F.col("_side").isNotNull() & (F.col(other)["side"] != F.col("_side")) & (F.abs(F.col(other)["t"] - F.col("t")) <= max_gap_s))

    return rows.withColumn("_tacked", differs("_before") | differs("_after")).drop("_side", "_breaks", "_before", "_after")


def wave_ranges_exclude(height: Range | None, angle: Range | None, period: Range | None, corrected: bool) -> Column:
    """The wave sliders, in single precision as they are shown; true where a sample is out."""
    heading = sailing.by_field(corrected, "heading_corrected", "heading")
    out = F.lit(False)
    for bounds, value in ((height, F.col("hs_m")), (angle, angle_between("wave_from", heading)), (period, F.col("wave_period_s"))):
        if bounds is not None and bounds != (None, None):
            single = value.cast("float")
            ok = value.isNotNull()
            if bounds[0] is not None:
                ok = ok & (single >= F.lit(bounds[0]).cast("float"))
            if bounds[1] is not None:
                ok = ok & (single <= F.lit(bounds[1]).cast("float"))
            out = out | ~holds(ok)
    return out


def without(samples: DataFrame, excluded: DataFrame, on: list[str]) -> DataFrame:
    """The samples that are not excluded by hand."""
    return samples.join(excluded.select(*on).distinct(), on, "left_anti")


def without_tide(samples: DataFrame, datasets: DataFrame) -> DataFrame:
    """Adds ``no_tide``: whether the sample's current comes from a dataset known to leave tides out."""
    none = datasets.where(holds(~F.col("has_tide"))).select(F.col("dataset").alias("current_dataset"), F.lit(True).alias("no_tide"))
    return samples.join(none, "current_dataset", "left").withColumn("no_tide", F.coalesce("no_tide", F.lit(False)))
