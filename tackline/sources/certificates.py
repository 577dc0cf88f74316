"""Lists of rating certificates as JSON: good records as rows, others with a reason.

A document has a list ``rms`` of certificates; each holds its tables of seconds a mile by wind
speed. Documents are read as variants, so that a field of another kind than expected spoils
its own certificate and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tackline.functions.canonical import rounded, settled

#: The fastest speed that counts as a boat's or a wind's, and names of the format's lists.
MAX_KN = 60.0
ANGLES, SPEEDS, BEAT_ANGLE, RUN_ANGLE, BEAT, RUN = "WindAngles", "WindSpeeds", "BeatAngle", "GybeAngle", "Beat", "Run"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _number(v: Column) -> Column:
    """A JSON number; null for anything else, a number in quotes among it."""
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def _text(record: Column, field: str) -> Column:
    return F.nullif(F.btrim(_get(record, f"$.{field}", "string")), F.lit(""))


def _list(allowances: Column, name) -> Column:
    """A list as an array of variants, whatever its elements are; null where there is none."""
    return F.when(F.schema_of_variant(allowances).startswith("OBJECT"), F.try_variant_get(allowances, f"$.{name}" if isinstance(name, str) else name, "array<variant>"))


def _hundredths(values: Column) -> Column:
    return F.transform(values, lambda v: rounded(_number(v), 2))


def _problem_of_numbers(raw: Column, name: str, low: float, high: float) -> Column:
    values = _hundredths(raw)
    return F.when(raw.isNull(), f"no list {name}").when(F.exists(values, lambda x: x.isNull()), f"not a number in {name}").when(F.exists(values, lambda x: (x < low) | (x > high)), f"out of range in {name}")


def _knots(raw: Column) -> Column:
    """Seconds a mile as knots to two decimals; null for what is no allowance."""
    return F.transform(raw, lambda v: F.when(_number(v) > 0, rounded(3600.0 / _number(v), 2)))


def _problem_of_speeds(raw: Column, name: str, count: Column) -> Column:
    values = _knots(raw)
    return F.when(raw.isNull(), f"no list {name}").when(F.size(raw) != count, f"wrong length of {name}").when(F.exists(values, lambda x: x.isNull()), f"no time allowance in {name}").when(F.exists(values, lambda x: x > MAX_KN), f"no boat speed in {name}")


def _increasing(values: Column) -> Column:
    return F.forall(F.sequence(F.lit(1), F.size(values) - 1), lambda k: F.get(values, k - 1) < F.get(values, k)) | (F.size(values) == 1)


def _row_name(angle: Column) -> Column:
    """The name of an angle's row: R52, or R52.5."""
    return F.concat(F.lit("R"), F.when(angle == F.floor(angle), angle.cast("long").cast("string")).otherwise(angle.cast("string")))


def read(documents: DataFrame) -> DataFrame:
    """One row a certificate of (country, year, text): country, year, place in its list, ref_no, name, model, its table and ``problem``.

    A list in several documents tells in ``first`` at which place of it each begins.

    ``problem`` is null for a good record; otherwise it names the first thing that is wrong, and the table is null. A
    document without a list is one row with a problem and no place.
    """
    first = F.coalesce(F.col("first").cast("int"), F.lit(0)) if "first" in documents.columns else F.lit(0)
    doc = documents.select("country", "year", first.alias("first"), F.try_parse_json(F.regexp_replace("text", "^﻿", "")).alias("d"))
    listed = doc.withColumn("rms", _get(F.col("d"), "$.rms", "array<variant>"))
    bad = listed.where("rms is null").select("country", "year", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("ref_no"), F.when(F.col("d").isNull(), "not JSON").otherwise("no list of certificates").alias("problem"))
    rows = listed.where("rms is not null").select("country", "year", "first", F.posexplode("rms").alias("place", "r"))
    rows = rows.select("country", "year", (F.col("first") + F.col("place")).alias("place"), "r")
    # each step is settled, or its variants would be read again wherever the next ones name them
    rows = settled(rows, {"ref_no": _text(F.col("r"), "RefNo"), "name": _text(F.col("r"), "YachtName"), "model": _text(F.col("r"), "Class"), "a": _get(F.col("r"), "$.Allowances", "variant")}).drop("r")
    names = {"_angles": ANGLES, "_speeds": SPEEDS, "_beat_angle": BEAT_ANGLE, "_run_angle": RUN_ANGLE, "_beat": BEAT, "_run": RUN}
    rows = settled(rows, {c: _list(F.col("a"), n) for c, n in names.items()})
    rows = settled(rows, {"twa": _hundredths(F.col("_angles")), "tws": _hundredths(F.col("_speeds"))})
    # a table row is a list under a name made of its angle
    table = F.when(F.schema_of_variant("a").startswith("OBJECT"), F.from_json(F.to_json("a"), "map<string,string>"))
    rows = settled(rows, {"_table": table})
    rows = settled(rows, {"_rows": F.transform("twa", lambda x: F.try_variant_get(F.try_parse_json(F.element_at(F.col("_table"), _row_name(x))), "$", "array<variant>"))})
    count = F.size("tws")
    row_problem = F.get(F.filter(F.transform(F.arrays_zip("twa", "_rows"), lambda x: F.struct(_row_name(x["twa"]).alias("name"), F.when(x["_rows"].isNull(), "no list ").when(F.size(x["_rows"]) != count, "wrong length of ").when(F.exists(_knots(x["_rows"]), lambda k: k.isNull()), "no time allowance in ").when(F.exists(_knots(x["_rows"]), lambda k: k > MAX_KN), "no boat speed in ").alias("what"))), lambda x: x["what"].isNotNull()), 0)

    def per_speed(c, name, low, high):
        return F.coalesce(_problem_of_numbers(F.col(c), name, low, high), F.when(F.size(c) != count, f"wrong length of {name}"))

    problem = F.coalesce(
        F.when(F.col("ref_no").isNull(), "no reference number"),
        F.when(F.col("a").isNull() | ~F.schema_of_variant("a").startswith("OBJECT"), "no allowances"),
        _problem_of_numbers(F.col("_angles"), ANGLES, 0.01, 180.0), _problem_of_numbers(F.col("_speeds"), SPEEDS, 0.01, MAX_KN),
        F.when(F.size("twa") == 0, f"{ANGLES} is empty").when(~_increasing(F.col("twa")), f"{ANGLES} is not increasing"),
        F.when(F.size("tws") == 0, f"{SPEEDS} is empty").when(~_increasing(F.col("tws")), f"{SPEEDS} is not increasing"),
        F.when(row_problem.isNotNull(), F.concat(row_problem["what"], row_problem["name"])),
        per_speed("_beat_angle", BEAT_ANGLE, 0.01, 89.99), _problem_of_speeds(F.col("_beat"), BEAT, count),
        per_speed("_run_angle", RUN_ANGLE, 90.01, 180.0), _problem_of_speeds(F.col("_run"), RUN, count),
    )
    good = settled(rows, {"problem": problem})
    lists = {"twa": F.col("twa"), "tws": F.col("tws"), "bsp": F.transform("_rows", lambda r: _knots(r)), "beat_angle": _hundredths(F.col("_beat_angle")), "beat_vmg": _knots(F.col("_beat")), "run_angle": _hundredths(F.col("_run_angle")), "run_vmg": _knots(F.col("_run"))}
    good = good.select("country", "year", "place", "ref_no", "name", "model", "problem", *[F.when(F.col("problem").isNull(), v).alias(c) for c, v in lists.items()])
    return good.unionByName(bad, allowMissingColumns=True)


def table_cells(certificates: DataFrame) -> DataFrame:
    """(ref_no, twa, tws, bsp) of good certificates."""
    good = certificates.where("problem is null")
    return good.select("ref_no", "tws", F.explode(F.arrays_zip("twa", "bsp")).alias("r")).select("ref_no", F.col("r.twa").alias("twa"), F.explode(F.arrays_zip(F.col("tws"), F.col("r.bsp").alias("bsp"))).alias("c")).select("ref_no", "twa", F.col("c.tws").alias("tws"), F.col("c.bsp").alias("bsp"))


def optimum_points(certificates: DataFrame) -> DataFrame:
    """(ref_no, tws, twa, vmg, upwind): the best angles to windward and to leeward."""
    good = certificates.where("problem is null")
    # both sides from one reading of the certificates
    side = lambda angle, vmg, upwind: F.transform(F.arrays_zip("tws", angle, vmg), lambda x: F.struct(x["tws"].alias("tws"), x[angle].alias("twa"), x[vmg].alias("vmg"), F.lit(upwind).alias("upwind")))
    return good.select("ref_no", F.inline(F.concat(side("beat_angle", "beat_vmg", True), side("run_angle", "run_vmg", False))))
