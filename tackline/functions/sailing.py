"""Boat, wind, wave and current relations, as Column expressions over samples.

A sample has heading, speed, supplied wind (sup_tws, sup_twd) as a pair,
downloaded wind (tws, twd_from), waves (hs_m, wave_period_s, wave_from) and
current (current_speed, current_toward).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tackline.functions.canonical import angle_off, col, degrees, knots, rounded, settled, wrap_360

#: Knots in one unit of each.
KNOTS_PER = {"kn": 1.0, "m/s": 3600.0 / 1852.0, "km/h": 1000.0 / 1852.0, "mph": 1609.344 / 1852.0}


def to_knots(x, unit: str) -> Column:
    return col(x) * KNOTS_PER[unit]


def compass(east, north) -> Column:
    """The direction that a vector points to, [0, 360)."""
    return wrap_360(F.degrees(F.atan2(col(east), col(north))))


def toward(speed, direction) -> tuple[Column, Column]:
    """East and north parts of a speed toward a direction."""
    r = F.radians(col(direction))
    return col(speed) * F.sin(r), col(speed) * F.cos(r)


def tack_of(heading, wind_from) -> Column:
    """starboard, port, or null head to wind and dead downwind."""
    r = F.pmod(col(wind_from) - col(heading), F.lit(360.0))
    return F.when((r > 0) & (r < 180), "starboard").when((r > 180) & (r < 360), "port")


def effective_wind(downloaded_only: bool = False) -> tuple[Column, Column]:
    """Speed and direction of the supplied pair, else of the downloaded one; the two are never mixed."""
    if downloaded_only:
        return F.col("tws"), F.col("twd_from")
    pair = F.col("sup_tws").isNotNull() & F.col("sup_twd").isNotNull()
    return F.when(pair, F.col("sup_tws")).otherwise(F.col("tws")), F.when(pair, F.col("sup_twd")).otherwise(F.col("twd_from"))


def from_components(u, v, sense: str) -> tuple[Column, Column]:
    """Knots and direction of a vector in m/s: where wind comes from, or where a current goes."""
    u, v = col(u), col(v)
    speed = F.hypot(u, v)
    sign = -1.0 if sense == "from" else 1.0
    turned = F.pmod(rounded(compass(u * sign, v * sign), 1), F.lit(360.0))
    return rounded(speed * KNOTS_PER["m/s"], 2), F.when(speed > 1e-9, turned)


def relate(samples: DataFrame, downloaded_only: bool = False) -> DataFrame:
    """Adds wind over the ground and, where there is a current, motion and wind through the water, and the wave angle."""
    wind, wind_from = effective_wind(downloaded_only)
    s = samples.withColumns({"wind_speed": wind, "wind_from": wind_from})
    # without a current every vector below is null, and so is what follows from it
    ce, cn = toward("current_speed", "current_toward")
    ge, gn = toward("speed", "heading")
    ae, an = toward("wind_speed", F.col("wind_from") + 180.0)
    s = settled(s, {"_we": ge - ce, "_wn": gn - cn, "_re": ae - ce, "_rn": an - cn})
    s = settled(s, {"_bsp": F.hypot("_we", "_wn"), "_tws": F.hypot("_re", "_rn"), "_to": compass("_we", "_wn"), "_from": F.pmod(compass("_re", "_rn") + 180.0, F.lit(360.0))})
    # a boat that is stopped in the water has no heading through it
    s = settled(s, {"_hdg": F.when(F.col("_bsp") > 1e-9, F.col("_to")), "_twd": F.when(F.col("_tws") > 1e-9, F.col("_from"))})
    north = lambda x: F.pmod(degrees(x), F.lit(360.0))
    s = settled(s, {
        "twa": degrees(angle_off("heading", "wind_from")), "tack": tack_of("heading", "wind_from"),
        "bsp_corrected": knots("_bsp"), "heading_corrected": north("_hdg"), "tws_corrected": knots("_tws"), "twd_from_corrected": north("_twd"),
        "twa_corrected": degrees(angle_off("_hdg", "_twd")), "tack_corrected": tack_of("_hdg", "_twd"),
        "wave_angle": degrees(angle_off(F.coalesce("_hdg", "heading"), F.col("wave_from"))),
    })
    return s.drop("_we", "_wn", "_re", "_rn", "_bsp", "_tws", "_to", "_from", "_hdg", "_twd")


def apparent_wind_angle(corrected: bool) -> Column:
    """Signed bearing of the apparent wind off the bow, [0, 360)."""
    angle = F.radians(F.col("wind_from") - F.col("heading"))
    east, north = F.col("wind_speed") * F.sin(angle), F.col("wind_speed") * F.cos(angle) + F.col("speed")
    bow = F.coalesce("heading_corrected", "heading") if corrected else F.col("heading")
    return F.when(F.hypot(east, north) > 1e-9, degrees(F.pmod(F.degrees(F.atan2(east, north)) + F.col("heading") - bow, F.lit(360.0))))


def polar_point(corrected: bool) -> tuple[Column, Column, Column]:
    """TWA, TWS and boat speed: the corrected three if all are there, else the ground three if all are there, else null."""
    ground = F.col("twa").isNotNull() & F.col("wind_speed").isNotNull() & F.col("speed").isNotNull()
    water = F.lit(corrected) & F.col("twa_corrected").isNotNull() & F.col("tws_corrected").isNotNull() & F.col("bsp_corrected").isNotNull()
    pairs = (("twa_corrected", "twa"), ("tws_corrected", "wind_speed"), ("bsp_corrected", "speed"))
    return tuple(F.when(water, F.col(w)).when(ground, F.col(g)) for w, g in pairs)


def by_field(corrected: bool, water: str, ground: str) -> Column:
    """The corrected value where there is one, else the ground value: field by field, unlike :func:`polar_point`."""
    return F.coalesce(water, ground) if corrected else F.col(ground)


def vmg(corrected: bool) -> Column:
    twa, _, bsp = polar_point(corrected)
    return bsp * F.cos(F.radians(twa))


def wave_sector(angle) -> Column:
    a = col(angle)
    return F.when(a < 30, "head").when(a < 60, "bow").when(a < 120, "beam").when(a < 150, "quarter").when(a.isNotNull(), "following")


def solar_hour(t, lon) -> Column:
    return F.pmod(F.pmod(F.col(t), F.lit(86400)) + F.col(lon) * 240.0, F.lit(86400.0)) / 3600.0


def day_band(t, lon) -> Column:
    """night, morning, afternoon or evening by local solar time."""
    h = solar_hour(t, lon)
    return F.when((h >= 21) | (h < 5), "night").when(h < 12, "morning").when(h < 17, "afternoon").otherwise("evening")


def wave_bucket(count: int, sense: str = "from", heading="heading", wave_from="wave_from") -> Column:
    """Which of ``count`` sectors around the bow the waves come from or go to, in single precision; 0 is centred on the bow."""
    bearing = wrap_360(col(wave_from) - col(heading)).cast("float")
    bearing = F.when(bearing >= F.lit(360.0).cast("float"), F.lit(0.0).cast("float")).otherwise(bearing)
    single = lambda x: F.lit(float(x)).cast("float")
    width = single(360.0 / count)
    turned = F.pmod(bearing + single(180.0 if sense == "to" else 0.0) + width / single(2), single(360.0))
    return F.least(F.floor((turned / width).cast("float")).cast("int"), F.lit(count - 1))
