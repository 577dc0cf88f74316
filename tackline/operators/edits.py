"""Tools that edit a polar's cells: each turns a selection into overrides, and overrides into the next ones.

Cells are (source_id, twa, tws, bsp), selections and overrides name their cells by (source_id, twa, tws). A grid has at
most 512 x 512 cells, so windows by source are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tackline.functions.canonical import knots
from tackline.operators import polar

#: The most that a cell can hold; the bounds of a scale, the lower one left out.
MAX_EDIT_KN, SCALES = 60.0, (-100.0, 1000.0)
CELL = ["source_id", "twa", "tws"]


def _chosen(cells: DataFrame, selection: DataFrame) -> DataFrame:
    return cells.where("bsp is not null").join(selection.select(*CELL).distinct(), CELL, "left_semi")


def scale(cells: DataFrame, selection: DataFrame, percent: float) -> DataFrame:
    """The chosen cells that hold a value, made faster or slower by a percentage."""
    if not SCALES[0] < percent <= SCALES[1]:
        raise ValueError(f"not a scale: {percent} %")
    return polar.scaled(_chosen(cells, selection), percent, MAX_EDIT_KN).withColumn("bsp", knots("bsp"))


def smooth(cells: DataFrame, selection: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """The chosen cells that hold a value, each the 4-2-1 mean of the values around it in ``neighbours``, by default ``cells``.

    Places are ranks on the axes of ``cells``, nulls included. ``neighbours`` may lack cells that the blend leaves out.
    """
    rank = lambda c: F.dense_rank().over(Window.partitionBy("source_id").orderBy(c))
    placed = cells.select(*CELL, "bsp", rank("twa").alias("i"), rank("tws").alias("j"))
    # every place tells its neighbours, rather than each place asking for its own
    given = placed if neighbours is None else placed.drop("bsp").join(neighbours.select(*CELL, "bsp"), CELL)
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float((2 - abs(a)) * (2 - abs(b)))).alias("k")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    told = given.where("bsp is not null").select("source_id", "i", "j", F.col("bsp").alias("v"), F.explode(steps).alias("s"))
    told = told.select("source_id", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), F.struct((-F.col("s.a")).alias("a"), (-F.col("s.b")).alias("b"), F.col("s.k").alias("k"), "v").alias("x"))
    terms = told.groupBy("source_id", "i", "j").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    mean = F.aggregate("xs", F.lit(0.0), lambda s, x: s + x["k"] * x["v"]) / F.aggregate("xs", F.lit(0.0), lambda s, x: s + x["k"])
    return _chosen(placed, selection).join(terms, ["source_id", "i", "j"]).select(*CELL, knots(F.least(F.lit(MAX_EDIT_KN), F.greatest(F.lit(0.0), mean))).alias("bsp"))


def write(selection: DataFrame, bsp: float | None) -> DataFrame:
    """A dragged or typed speed, null to take an override away. Such a tool edits one cell: sources with more chosen give nothing."""
    if bsp is not None and not 0 <= bsp <= MAX_EDIT_KN:
        raise ValueError(f"not a speed of a cell: {bsp}")
    one = selection.select(*CELL).distinct().groupBy("source_id").agg(F.count("*").alias("n"), F.first("twa").alias("twa"), F.first("tws").alias("tws")).where("n = 1")
    return one.select(*CELL, F.lit(bsp).cast("double").alias("bsp"))


def reset(selection: DataFrame) -> DataFrame:
    """The chosen cells without an override."""
    return selection.select(*CELL).distinct().withColumn("bsp", F.lit(None).cast("double"))


def changes(overrides: DataFrame, edits: DataFrame) -> DataFrame:
    """(source_id, twa, tws, before, after) of the edits that change something."""
    both = edits.select(*CELL, F.col("bsp").alias("after")).join(overrides.select(*CELL, F.col("bsp").alias("before")), CELL, "left")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(*CELL, "before", "after")


def edited(overrides: DataFrame, edits: DataFrame) -> DataFrame:
    """The overrides after the edits."""
    kept = overrides.select(*CELL, "bsp").join(edits, CELL, "left_anti")
    return kept.unionByName(edits.where("bsp is not null").select(*CELL, "bsp"))
