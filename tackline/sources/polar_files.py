"""Polar text files to cells, and what is wrong with those that are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tackline.operators.polar import collect_points

#: Words of a row that labels columns, longest first; a table's first cell; limits.
LABELS = "(?:downwind|upwind|twa|bsp|tws|pol|up|dn)+"
TABLE_CORNER = r"^(?i)(twa\\tws|twa/tws|twa)$"
MAX_FILE_BYTES, MAX_TWS_KN, MAX_SPEED_KN = 4 << 20, 70.0, 60.0


def decoded(content: Column) -> Column:
    """Text of a file: by its mark UTF-8 or UTF-16, else UTF-8 where it is valid, else Latin-1."""
    mark = lambda n: F.hex(F.substring(content, 1, n))
    plain = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.when(mark(3) == "EFBBBF", F.regexp_replace(content.cast("string"), "^\\uFEFF", "")).when(mark(2) == "FFFE", F.regexp_replace(F.decode(content, "UTF-16LE"), "^\\uFEFF", "")).when(mark(2) == "FEFF", F.regexp_replace(F.decode(content, "UTF-16BE"), "^\\uFEFF", "")).otherwise(plain)


def _split(line: Column, separator: Column) -> Column:
    by = lambda s: F.transform(F.split(line, s), lambda x: F.trim(x))
    return F.when(separator == "tab", by("\t")).when(separator == ";", by(";")).when(separator == ",", by(",")).otherwise(F.split(F.trim(line), r"\s+"))


def _number(x: Column, separator: Column) -> Column:
    return F.when(separator == ",", x).otherwise(F.regexp_replace(x, ",", ".")).try_cast("double")


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line, content, format, separator) of every line that says something; format by the first of them: table or expedition."""
    rows = files.where(F.length("content") <= MAX_FILE_BYTES).select("path", F.posexplode(F.split(decoded(F.col("content")), r"\r\n|\r|\n")).alias("line", "content"))
    rows = rows.where("trim(content) <> '' and not startswith(ltrim(content), '!')")
    first = F.first("content").over(Window.partitionBy("path").orderBy("line"))
    separator = F.when(F.contains(first, F.lit("\t")), "tab").when(F.contains(first, F.lit(";")), ";").when(F.contains(first, F.lit(",")), ",").otherwise("space")
    rows = rows.withColumns({"line": F.col("line") + 1, "separator": separator, "_corner": F.get(_split(first, separator), F.lit(0)), "_first": first})
    label = F.forall(F.split(F.trim("_first"), r"\s+"), lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "").rlike(f"^{LABELS}$"))
    number = _number(F.get(F.split(F.trim("_first"), r"\s+"), F.lit(0)), F.lit("space")).isNotNull()
    return rows.withColumns({"format": F.when(F.col("_corner").rlike(TABLE_CORNER), "table").when(number | label, "expedition").otherwise("unknown"), "is_label": ~number & label}).drop("_corner", "_first")


def points_of(lines: DataFrame) -> DataFrame:
    """(path, line, twa, tws, bsp, problem) of every cell that is written; numbers that cannot be are kept with their problem."""
    pairs = lines.where("format = 'expedition'")
    cells = F.split(F.trim("content"), r"\s+")
    first = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    pairs = pairs.withColumn("_k", first).where("not (is_label and _k = 1)").select("path", "line", cells.alias("c"))
    n = F.size("c")
    pairs = pairs.where(n > 1).select("path", "line", _number(F.get("c", F.lit(0)), F.lit("space")).alias("tws"), F.explode(F.sequence(F.lit(1), n - 1, F.lit(2))).alias("k"), "c")
    expedition = pairs.select("path", "line", _number(F.get("c", F.col("k")), F.lit("space")).alias("twa"), "tws", _number(F.get("c", F.col("k") + 1), F.lit("space")).alias("bsp"), F.when(F.size("c") <= F.col("k") + 1, "missing-bsp").alias("short"))
    rows = lines.where("format = 'table'").withColumn("c", _split(F.col("content"), F.col("separator")))
    rows = rows.withColumn("head", F.first("c").over(Window.partitionBy("path").orderBy("line"))).withColumn("_k", first).where("_k > 1")
    rows = rows.select("path", "line", "separator", "head", _number(F.get("c", F.lit(0)), F.col("separator")).alias("twa"), F.posexplode(F.slice(F.col("c"), 2, F.greatest(F.size("c"), F.lit(1)))).alias("k", "text"))
    table = rows.where("text <> ''").select("path", "line", "twa", _number(F.get("head", F.col("k") + 1), F.col("separator")).alias("tws"), _number(F.col("text"), F.col("separator")).alias("bsp"), F.when(F.size("head") <= F.col("k") + 1, "too-many-cells").alias("short"))
    both = expedition.unionByName(table)
    problem = (
        F.when(F.col("short").isNotNull(), F.col("short")).when(F.col("twa").isNull() | F.col("tws").isNull() | F.col("bsp").isNull(), "not-a-number").when((F.col("twa") < 0) | (F.col("tws") < 0) | (F.col("bsp") < 0), "negative")
        .when(F.col("twa") > 360, "angle-out-of-range").when((F.col("tws") > MAX_TWS_KN) | (F.col("bsp") > MAX_SPEED_KN), "too-fast")
    )
    return both.withColumn("problem", problem).drop("short")


def polars_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (path, twa, tws, bsp) of the files (path, content) that read whole, and problems (path, line, problem) of the others."""
    lines = lines_of(files)
    points = points_of(lines)
    bad = points.where("problem is not null").select("path", "line", "problem")
    odd = lines.where("format = 'unknown'").groupBy("path").agg(F.min("line").alias("line")).withColumn("problem", F.lit("unknown-format"))
    said = points.select("path").distinct()
    silent = files.join(said, "path", "left_anti").join(odd, "path", "left_anti")
    why = F.when(F.length("content") > MAX_FILE_BYTES, "too-large").otherwise("no-speeds")
    problems = bad.unionByName(odd).unionByName(silent.select("path", F.lit(None).cast("int").alias("line"), why.alias("problem")))
    good = points.join(problems.select("path").distinct(), "path", "left_anti")
    return collect_points(good, ["path"]), problems


def read_polars(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """:func:`polars_of` the files at a path."""
    return polars_of(spark.read.format("binaryFile").load(path))
