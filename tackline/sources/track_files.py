"""Track files to fixes: CSV with a guessed mapping, GeoJSON features, binary positions."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tackline.functions.canonical import wrap_360, wrap_lon
from tackline.functions.sailing import KNOTS_PER
from tackline.sources.times import seconds

#: Header names by field, whole names first and then beginnings.
NAMES = {
    "time": (["time", "timestamp", "datetime", "date", "utc", "gpstime", "timeutc", "utctime", "datetimeutc"], ["time", "date", "utc"]),
    "lat": (["lat", "latitude", "y"], ["lat"]),
    "lon": (["lon", "lng", "long", "longitude", "x"], ["lon", "lng"]),
    "tws": (["tws", "truewindspeed", "windspeed"], ["tws", "truewindspeed", "windspeed"]),
    "twd": (["twd", "twdfrom", "truewinddirection", "winddirection"], ["twd", "truewinddirection", "winddirection"]),
    "heading": (["cog", "heading", "hdg", "course", "cogt", "hdgt"], ["cog", "heading", "hdg", "course"]),
    "speed": (["sog", "speed", "bsp", "stw"], ["sog", "speed", "bsp", "stw"]),
    "boat": (["boat", "name", "boatname", "yacht", "vessel"], ["boat", "yacht", "vessel"]),
}
#: Speeds above these are misread.
MAX_BOAT_KN, MAX_WIND_KN = 100.0, 200.0


@dataclass(frozen=True)
class Mapping:
    """Which column holds which field, and in what unit."""

    columns: dict[str, str]
    speed_unit: str = "kn"
    wind_unit: str = "kn"
    time_format: str = "auto"


def _unit(header: str) -> str:
    low = header.lower()
    return next((u for u, marks in (("km/h", ("km/h", "kmh", "kph")), ("m/s", ("m/s", "mps")), ("mph", ("mph",))) if any(m in low for m in marks)), "kn")


def guess(header: list[str]) -> Mapping:
    """A mapping from the names in a header; a column serves one field."""
    plain = [re.sub(r"\(.*?\)|\[.*?\]", "", h).lower() for h in header]
    plain = [re.sub(r"[^a-z0-9]", "", h) for h in plain]
    taken: dict[str, int] = {}
    for field, (whole, starts) in NAMES.items():
        free = [k for k in range(len(plain)) if k not in taken.values()]
        found = next((k for n in whole for k in free if plain[k] == n), None)
        found = next((k for n in starts for k in free if plain[k].startswith(n)), None) if found is None else found
        if found is not None:
            taken[field] = found
    return Mapping({f: header[k] for f, k in taken.items()}, _unit(header[taken["speed"]]) if "speed" in taken else "kn", _unit(header[taken["tws"]]) if "tws" in taken else "kn")


def valid_position(lat: Column, lon: Column) -> Column:
    return F.coalesce((lat >= -90) & (lat <= 90) & (lon >= -180) & (lon <= 360), F.lit(False))


def _bounded(x: Column, most: float) -> Column:
    return F.when((x >= 0) & (x <= most), x)


def checked(rows: DataFrame) -> DataFrame:
    """Fixes with wrapped directions and bounded speeds, and ``problem`` where a row has no time or place."""
    lat, lon = F.col("lat"), F.col("lon")
    problem = F.when(F.col("t").isNull(), "bad-time").when(~valid_position(lat, lon), "bad-position")
    direction = lambda c: F.when((F.col(c) >= -360) & (F.col(c) <= 360), wrap_360(c))
    return rows.withColumns({"problem": problem, "lon": wrap_lon(lon), "cog": direction("cog"), "sog": _bounded(F.col("sog"), MAX_BOAT_KN), "tws": _bounded(F.col("tws"), MAX_WIND_KN), "twd_from": direction("twd_from")})


def read_csv(spark: SparkSession, path: str, separator: str = ",", mapping: Mapping | None = None) -> DataFrame:
    """Fixes (file, boat, t, lat, lon, cog, sog, tws, twd_from, problem) of CSV files with one header.

    Numbers may have a decimal comma where commas do not separate. Rows keep their file; a window by time orders them later.
    """
    raw = spark.read.csv(path, header=True, sep=separator, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    m = mapping or guess(raw.columns)

    def number(field: str, factor: float = 1.0) -> Column:
        if field not in m.columns:
            return F.lit(None).cast("double")
        x = F.trim(F.col(f"`{m.columns[field]}`"))
        x = x if separator == "," else F.regexp_replace(x, ",", ".")
        v = x.try_cast("double") * factor
        return F.when(~F.isnan(v), v)

    boat = F.col(f"`{m.columns['boat']}`") if "boat" in m.columns else F.lit(None).cast("string")
    rows = raw.select(
        F.input_file_name().alias("file"), F.when(F.trim(boat) != "", F.trim(boat)).alias("boat"), seconds(F.col(f"`{m.columns['time']}`"), m.time_format).alias("t"), number("lat").alias("lat"), number("lon").alias("lon"),
        number("heading").alias("cog"), number("speed", KNOTS_PER[m.speed_unit]).alias("sog"), number("tws", KNOTS_PER[m.wind_unit]).alias("tws"), number("twd").alias("twd_from"),
    )
    return checked(rows)


#: Property names of GeoJSON features, lower case.
PROPERTIES = {"time": ["time", "timestamp", "datetime", "date", "t"], "times": ["times", "coordtimes", "time"], "cog": ["cog", "heading", "hdg", "course"], "sog": ["sog", "speed"], "tws": ["tws", "windspeed"], "twd_from": ["twd", "winddirection"], "boat": ["boat", "name", "vessel", "yacht"]}


def read_geojson(texts: DataFrame, text_col: str = "text", file_col: str = "file") -> DataFrame:
    """Fixes of GeoJSON texts, one text a row: points with a time, lines and many lines with a time a vertex.

    Property names are matched without case. A line whose times do not number its vertices gives one row with a problem.
    """
    strings = T.MapType(T.StringType(), T.StringType())
    geometry = "struct<type:string,coordinates:string>"
    feature = f"struct<type:string,geometry:{geometry},properties:map<string,string>>"
    root = F.from_json(text_col, f"struct<type:string,features:array<{feature}>,geometry:{geometry},properties:map<string,string>>")
    rows = texts.select(F.col(file_col).alias("file"), root.alias("r"))
    one = F.struct(F.lit("Feature").alias("type"), F.col("r.geometry").alias("geometry"), F.col("r.properties").alias("properties"))
    rows = rows.select("file", F.posexplode(F.when(F.col("r.type") == "FeatureCollection", F.col("r.features")).otherwise(F.array(one))).alias("feature", "f"))
    rows = rows.where("f.geometry is not null")
    entries = F.transform(F.map_entries(F.coalesce("f.properties", F.create_map().cast(strings))), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    rows = rows.select("file", "feature", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"), entries.alias("p"))

    def named(key: str) -> Column:
        return F.get(F.filter("p", lambda e: e["k"] == key), F.lit(0))["v"]

    def prop(name: str) -> Column:
        return F.coalesce(*map(named, PROPERTIES[name]))

    rows = rows.withColumns({n: prop(n) for n in PROPERTIES})
    places = "array<array<double>>"
    point = F.when(F.col("kind") == "Point", F.array(F.array(F.from_json("c", "array<double>"))))
    lines = F.coalesce(point, F.when(F.col("kind") == "LineString", F.array(F.from_json("c", places))), F.when(F.col("kind") == "MultiLineString", F.from_json("c", f"array<{places}>")))
    many = F.col("kind") == "MultiLineString"

    def series(name: str) -> Column:
        x = F.col(name)
        value = F.when(many & F.startswith(x, F.lit("[[")), F.from_json(x, "array<array<string>>"))
        flat = F.when(F.startswith(x, F.lit("[")), F.from_json(x, "array<string>"))
        return F.when(many & value.isNotNull(), F.get(value, F.col("line"))).otherwise(flat)

    rows = rows.select("*", F.posexplode(lines).alias("line", "vertices"))
    times = F.when(F.col("kind") == "Point", F.array("time")).otherwise(series("times"))
    rows = rows.withColumns({"_times": times, **{f"_{n}": series(n) for n in ("cog", "sog", "tws", "twd_from")}})
    matches = F.coalesce(F.size("_times") == F.size("vertices"), F.lit(False))
    rows = rows.select("*", matches.alias("_ok"), F.posexplode(F.when(matches, F.col("vertices")).otherwise(F.array(F.array().cast("array<double>")))).alias("at", "v"))
    value = lambda n: F.coalesce(F.get(f"_{n}", F.col("at")), F.when(F.col(f"_{n}").isNull(), F.col(n))).try_cast("double")
    out = rows.select(
        "file", "feature", "line", "at", F.when(F.trim("boat") != "", F.trim("boat")).alias("boat"), F.when(F.col("_ok"), seconds(F.get("_times", F.col("at")))).alias("t"), F.get("v", F.lit(1)).alias("lat"), F.get("v", F.lit(0)).alias("lon"),
        *[value(n).alias(n) for n in ("cog", "sog", "tws", "twd_from")], "_ok",
    )
    return checked(out).withColumn("problem", F.when(~F.col("_ok"), "times-mismatch").otherwise(F.col("problem"))).drop("_ok")


_MOMENT = T.StructType([T.StructField("file", T.StringType()), T.StructField("team", T.LongType()), T.StructField("at", T.LongType()), T.StructField("t", T.LongType()), T.StructField("lat_e5", T.LongType()), T.StructField("lon_e5", T.LongType()), T.StructField("delta", T.BooleanType())])


def binary_moments(files: DataFrame) -> DataFrame:
    """The raw moments of binary position files (path, content): whole values and deltas as they stand, newest first.

    A file is big-endian: a flag byte, a reference time, then teams of moments. What a flag adds to a moment is skipped here.
    """

    def moments(path: str, data: bytes):
        flags, reference = struct.unpack_from(">BI", data)
        if flags & ~15:
            raise ValueError(f"{path}: unknown header flags {flags:#x}")
        extra = {True: 2 * bool(flags & 1) + 2 * bool(flags & 2) + 2 * bool(flags & 8), False: 2 * bool(flags & 1) + (4 + bool(flags & 4)) * bool(flags & 2) + 4 * bool(flags & 8)}
        place = 5
        while place < len(data):
            team, count = struct.unpack_from(">HH", data, place)
            place += 4
            for k in range(count):
                delta = bool(data[place] & 0x80)
                if delta:
                    back, lat, lon = struct.unpack_from(">Hhh", data, place)
                    t = -(back & 0x7FFF)
                else:
                    t, lat, lon = struct.unpack_from(">Iii", data, place)
                    t += reference
                if delta and not k:
                    raise ValueError(f"{path}: team {team} starts with a delta at byte {place}")
                place += (6 if delta else 12) + extra[delta]
                if place > len(data):
                    raise ValueError(f"{path}: cut short at byte {len(data)}")
                yield path, team, k, t, lat, lon, delta

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(moments(path, data))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(_MOMENT.names, r, strict=True)) for r in rows], schema=pa.schema([("file", pa.string()), ("team", pa.int64()), ("at", pa.int64()), ("t", pa.int64()), ("lat_e5", pa.int64()), ("lon_e5", pa.int64()), ("delta", pa.bool_())]))

    return files.select("path", "content").mapInArrow(run, _MOMENT)


def resolved(moments: DataFrame) -> DataFrame:
    """Moments with deltas added up from the whole value before them; (file, team, t, lat, lon), any order."""
    from pyspark.sql import Window

    w = Window.partitionBy("file", "team").orderBy("at")
    rows = moments.withColumn("run", F.sum(F.when(F.col("delta"), 0).otherwise(1)).over(w))
    part = Window.partitionBy("file", "team", "run").orderBy("at")
    rows = rows.withColumns({c: F.sum(c).over(part) for c in ("t", "lat_e5", "lon_e5")})
    return rows.select("file", "team", "t", (F.col("lat_e5") / 1e5).alias("lat"), (F.col("lon_e5") / 1e5).alias("lon"))
