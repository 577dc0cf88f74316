"""Polars as files: checks, and the lines of each format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tackline.functions.canonical import is_zero_row

#: Fixed values.
MAX_TWS_KN, MAX_SPEED_KN = 70.0, 60.0
FORMATS = {"expedition": "\t", "adrena": "\t", "csv": ";"}
CORNER = "TWA\\TWS"


def axis_text(x) -> Column:
    """At most two decimals, without trailing zeros."""
    x = F.col(x) if isinstance(x, str) else x
    return F.regexp_replace(F.format_string("%.2f", x + 0.0), r"\.?0+$", "")


def speed_text(x) -> Column:
    """Exactly two decimals."""
    x = F.col(x) if isinstance(x, str) else x
    return F.format_string("%.2f", x + 0.0)


def problems(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem, axis, value) of everything that keeps a polar from being written and read back as the same grid."""
    out = []
    for axis, most in (("twa", 360.0), ("tws", MAX_TWS_KN)):
        values = cells.select(*keys, F.col(axis).alias("value")).distinct()
        out.append(values.where(F.isnan("value") | (F.col("value") < 0) | (F.col("value") > most)).withColumns({"problem": F.lit("out-of-range"), "axis": F.lit(axis)}))
        w = Window.partitionBy(*keys).orderBy("value")
        out.append(values.withColumn("_b", F.lag(axis_text("value")).over(w)).where(F.col("_b") == axis_text("value")).drop("_b").withColumns({"problem": F.lit("axis-collision"), "axis": F.lit(axis)}))
    fast = F.isnan("bsp") | (F.col("bsp") < 0) | (F.round(F.col("bsp") * 100.0) / 100.0 > MAX_SPEED_KN)
    out.append(cells.where(F.col("bsp").isNotNull() & fast).select(*keys, F.col("bsp").alias("value")).withColumns({"problem": F.lit("too-fast"), "axis": F.lit("bsp")}))
    some = cells.groupBy(*keys).agg(F.bool_or(F.col("bsp").isNotNull() & ~is_zero_row("twa")).alias("_some"))
    out.append(some.where(~F.col("_some")).drop("_some").withColumns({"value": F.lit(None).cast("double"), "problem": F.lit("empty"), "axis": F.lit("")}))
    rows = out[0].select(*keys, "problem", "axis", "value")
    for o in out[1:]:
        rows = rows.unionByName(o.select(*keys, "problem", "axis", "value"))
    return rows


def expedition_lines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tws, line): a line a wind speed with a value, tab-separated, holding only cells that have one."""
    pair = F.struct("twa", F.concat_ws("\t", axis_text("twa"), speed_text("bsp")).alias("text"))
    rows = cells.where("bsp is not null").groupBy(*keys, "tws").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    return rows.select(*keys, "tws", F.concat_ws("\t", axis_text("tws"), F.array_join(F.col("pairs.text"), "\t")).alias("line"))


def table_lines(cells: DataFrame, keys: list[str], tws: list[float], separator: str = ";") -> DataFrame:
    """(keys, twa, line): the whole grid by angle, empty cells left empty. One pivot over a bounded axis."""
    rows = cells.groupBy(*keys, "twa").pivot("tws", tws).agg(F.first(speed_text("bsp")))
    return rows.select(*keys, "twa", F.concat_ws(separator, axis_text("twa"), *[F.coalesce(F.col(f"`{v}`"), F.lit("")) for v in tws]).alias("line"))


def table_header(tws: list[float], separator: str = ";") -> str:
    return separator.join([CORNER, *[f"{v:.2f}".rstrip("0").rstrip(".") for v in tws]])


def write_lines(lines: DataFrame, order: str, path: str) -> None:
    """The lines as text files, in order within each boat's file."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.text(path)
