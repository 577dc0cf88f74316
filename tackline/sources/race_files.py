"""Race files.

Race GeoJSON has a line a participant, whose vertices hold longitude, latitude, altitude and
milliseconds, and columns that the file itself names. KML has placemarks with lists of times
and of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tackline.functions.canonical import knots, settled, wrap_360, wrap_lon
from tackline.sources.times import seconds

#: Where course and speed stand if a file does not say, what the wind's columns are called, lower case, and the last millisecond of a date.
COG_AT, SOG_AT, LAST_MS = 5, 4, 253_402_300_799_000.0
TWS_NAMES, TWD_NAMES = ("tws", "windspeed", "truewindspeed"), ("twd", "twd_from", "winddirection", "truewinddirection")


def _number(v: Column) -> Column:
    """A number, or one in quotes; null for anything else."""
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|STRING)"), F.try_variant_get(v, "$", "string").try_cast("double"))


def _is(name: str):
    return lambda entry: entry["k"] == name


def read_race(texts: DataFrame, identities: DataFrame, text_col: str = "text", file_col: str = "file") -> DataFrame:
    """file, participant, at, t, lat, lon, cog, sog, tws, twd_from and problem: the fixes of the participants in ``identities`` (participant).

    A file with a faulty line or vertex of one of them gives one row, its first problem, and nothing else.
    """
    doc = texts.select(F.col(file_col).alias("file"), F.try_parse_json(text_col).alias("d"))
    one = F.try_variant_get("d", "$.type", "string") == "Feature"
    rows = settled(doc, {"features": F.when(one, F.array("d")).otherwise(F.try_variant_get("d", "$.features", "array<variant>"))})
    unread = rows.where("features is null").select("file", F.when(F.col("d").isNull(), "not JSON").otherwise("no features").alias("problem"))
    rows = rows.where("features is not null").select("file", F.posexplode("features").alias("feature", "f"))
    get = lambda path, kind: F.try_variant_get("f", path, kind)
    text = lambda path: F.when(F.schema_of_variant(get(path, "variant")) == "STRING", get(path, "string"))
    rows = settled(rows, {
        "participant": F.coalesce(text("$.properties.vesselParticipantId"), text("$.properties.id"), F.lit("")), "kind": text("$.geometry.type"), "vertices": get("$.geometry.coordinates", "array<variant>"),
        "detail": F.when(F.schema_of_variant(get("$.properties.detail", "variant")).startswith("OBJECT"), F.from_json(F.to_json(get("$.properties.detail", "variant")), "map<string,string>")),
    }).drop("f")
    rows = rows.join(identities.select("participant"), "participant", "left_semi")
    place = lambda x: F.when(x.rlike("^[0-9]{1,9}$"), x.cast("int"))

    def named(names: tuple[str, ...]) -> Column:
        entries = F.transform(F.map_entries("detail"), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
        return F.coalesce(*[F.get(F.filter(entries, _is(n)), 0)["v"] for n in names])

    given = lambda name, at: F.when(F.col("detail").isNull(), F.lit(at)).otherwise(place(F.try_element_at("detail", F.lit(name))))
    rows = settled(rows, {"_cog": given("cog", COG_AT), "_sog": given("sog", SOG_AT), "_tws": place(named(TWS_NAMES)), "_twd": place(named(TWD_NAMES))})
    shape = F.when(F.coalesce(F.col("kind") != "LineString", F.lit(True)), "no line").when(F.col("vertices").isNull(), "no coordinates")
    rows = rows.select("file", "participant", "feature", "_cog", "_sog", "_tws", "_twd", shape.alias("shape"), F.posexplode_outer(F.when(shape.isNull(), F.col("vertices"))).alias("at", "v"))
    item = lambda k: _number(F.get(F.try_variant_get("v", "$", "array<variant>"), k))
    rows = settled(rows, {"lon": item(F.lit(0)), "lat": item(F.lit(1)), "ms": item(F.lit(3)), "cog": item(F.col("_cog")), "sog": item(F.col("_sog")), "tws": item(F.col("_tws")), "twd_from": item(F.col("_twd"))})
    good = lambda c: F.coalesce(c, F.lit(False))
    placed = good(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 360) & F.col("ms").between(0, LAST_MS))
    windy = F.col("tws").isNull() | F.col("tws").between(0, 200)
    turned = F.col("twd_from").isNull() | F.col("twd_from").between(-360, 360)
    fault = F.when(F.col("shape").isNotNull(), F.col("shape")).when(F.col("at").isNull(), None).when(~placed, "no place and time").when(~good(windy), "wind speed out of range").when(~good(turned), "wind direction out of range")
    rows = settled(rows, {"fault": fault})
    first = rows.where("fault is not null").groupBy("file").agg(F.min(F.struct("feature", F.coalesce("at", F.lit(-1)).alias("at"), "fault")).alias("x")).select("file", F.col("x.fault").alias("problem"))
    sailed = rows.where("at is not null").join(first, "file", "left_anti").select(
        "file", "participant", "at", F.floor(F.col("ms") / 1000.0).alias("t"), "lat", wrap_lon("lon").alias("lon"), F.when((F.col("cog") >= 0) & (F.col("cog") < 360), F.col("cog")).alias("cog"), F.when((F.col("sog") >= 0) & (F.col("sog") < float("inf")), F.col("sog")).alias("sog"),
        knots("tws").alias("tws"), wrap_360("twd_from").alias("twd_from"),
    )
    return sailed.unionByName(first.unionByName(unread), allowMissingColumns=True)


#: What XML writes for marks of its own; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _plain(text: Column) -> Column:
    for entity, mark in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return F.btrim(text, F.lit(" \t\r\n"))


def _elements(text: Column, name: str) -> Column:
    """The contents of an element without children, in order, whatever its prefix."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"<(?:[A-Za-z0-9_]++:)?{name}(?:\s[^>]*+)?>([^<]*+)</"), F.lit(1)), _plain)


def read_kml(texts: DataFrame, text_col: str = "text", file_col: str = "file") -> DataFrame:
    """file, placemark, name, k, t, lat, lon and problem: the tracks of KML files, one text a row, times and places paired in order.

    A file that is not XML, or has a track with a time or place that cannot be read or with more of one than of the other,
    gives one row, its first problem, and nothing else. Places lie on a grid of 1e-5 degrees.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = F.from_xml(text, "_corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = settled(texts.select(F.col(file_col).alias("file"), text.alias("x"), whole.alias("w")), {"broken": F.col("w").isNull() | F.col("w._corrupt_record").isNotNull()}).drop("w")
    broken = rows.where("broken").select("file", F.lit("not XML").alias("problem"))
    marks = rows.where("not broken").select("file", F.posexplode(F.regexp_extract_all("x", F.lit(r"(?s)<Placemark(?:\s[^>]*+)?>(.*?)</Placemark\s*+>"), F.lit(1))).alias("placemark", "p"))
    marks = settled(marks, {"name": F.coalesce(F.get(_elements(F.col("p"), "name"), 0), F.lit("")), "times": F.transform(_elements(F.col("p"), "when"), lambda t: seconds(t, "iso")), "places": F.transform(_elements(F.col("p"), "coord"), lambda c: F.transform(F.split(c, ","), lambda x: x.try_cast("double")))}).drop("p")
    grid = lambda x: F.round(x * 1e5) / 1e5
    places = F.transform("places", lambda p: F.struct(grid(F.get(p, 1)).alias("lat"), grid(F.get(p, 0)).alias("lon")))
    marks = settled(marks, {"places": places})
    wrong = lambda p: ~F.coalesce(p["lat"].between(-90, 90) & p["lon"].between(-360, 360), F.lit(False))
    fault = F.when(F.exists("times", lambda t: t.isNull()), "no time").when(F.exists("places", wrong), "no place").when(F.size("times") != F.size("places"), "times and places differ in number")
    marks = settled(marks, {"fault": fault})
    first = marks.where("fault is not null").groupBy("file").agg(F.min(F.struct("placemark", "fault")).alias("x")).select("file", F.col("x.fault").alias("problem"))
    fixes = marks.join(first, "file", "left_anti").select("file", "placemark", "name", F.posexplode(F.arrays_zip("times", "places")).alias("k", "z"))
    fixes = fixes.select("file", "placemark", "name", "k", F.col("z.times").alias("t"), F.col("z.places.lat").alias("lat"), wrap_lon(F.col("z.places.lon")).alias("lon"))
    return fixes.unionByName(first.unionByName(broken), allowMissingColumns=True)
