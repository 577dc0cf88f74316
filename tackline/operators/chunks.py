"""Neighbours and states along a track without a whole track in one task.

A track is cut into chunks of time. Windows run within (track, chunk); of each chunk only its
first and last row, or the state that it begins and ends with, go on to a second window by
track, which has a row a chunk. What that one finds is joined to the chunk's rows, which are
dealt by (track, chunk) already and do not move again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Seconds of a chunk: at one fix a second, a million rows.
CHUNK_S = 1_000_000
ORDER = ("t", "fix_idx")


def chunk_of(chunk_s: int) -> Column:
    return F.floor(F.col("t") / F.lit(chunk_s))


def _joined(rows: DataFrame, carried: DataFrame, names: list[str]) -> DataFrame:
    """Columns of ``carried`` (_track, _at, names) for the rows of each chunk; a missing track or time is one of its own."""
    return rows.join(carried, F.col("track_id").eqNullSafe(F.col("_track")) & F.col("_chunk").eqNullSafe(F.col("_at")), "left").select(*rows.columns, *names)


def with_neighbours(rows: DataFrame, columns: list[str], chunk_s: int | None = CHUNK_S) -> DataFrame:
    """Adds ``_before`` and ``_after``: structs of the columns of the rows on either side in the track, of nulls or null at its ends. Without a chunk a track is one window."""
    if chunk_s is None:
        # a struct made above the window is taken apart again by the optimizer
        w = Window.partitionBy("track_id").orderBy(*ORDER)
        return rows.withColumns({name: F.struct(*[shift(c).over(w).alias(c) for c in columns]) for name, shift in (("_before", F.lag), ("_after", F.lead))})
    x, own = F.struct(*columns), rows.columns
    w = Window.partitionBy("track_id", "_chunk").orderBy(*ORDER)
    rows = rows.withColumn("_chunk", chunk_of(chunk_s)).withColumns({"_p": F.lag(x).over(w), "_n": F.lead(x).over(w)})
    ends = rows.groupBy("track_id", "_chunk").agg(F.max(F.when(F.col("_p").isNull(), x)).alias("first"), F.max(F.when(F.col("_n").isNull(), x)).alias("last"))
    along = Window.partitionBy("track_id").orderBy("_chunk")
    carried = ends.select(F.col("track_id").alias("_track"), F.col("_chunk").alias("_at"), F.lag("last").over(along).alias("_cp"), F.lead("first").over(along).alias("_cn"))
    return _joined(rows, carried, ["_cp", "_cn"]).select(*own, F.coalesce("_p", "_cp").alias("_before"), F.coalesce("_n", "_cn").alias("_after"))


def with_last_known(rows: DataFrame, breaks: Column, known: Column, chunk_s: int | None = CHUNK_S) -> DataFrame:
    """Adds ``_before`` and ``_after``: the nearest value of ``known``, a struct or null, on either side in the track with no break between.

    A row that ``breaks`` starts a new stretch, and is a part of it.
    """
    own = rows.columns
    keys = ["track_id", "_chunk"]
    rows = rows.withColumns({"_chunk": chunk_of(chunk_s) if chunk_s else F.lit(0).cast("long"), "_break": breaks.cast("int"), "_known": known})
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    rows = rows.withColumn("_part", F.sum("_break").over(w))
    part = Window.partitionBy(*keys, "_part").orderBy(*ORDER)
    # what follows is read backwards: a frame that grows from the front takes a step a row, one that shrinks takes as many as there are rows
    back, ahead = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (part, Window.partitionBy(*keys, "_part").orderBy(*[F.desc(c) for c in ORDER])))
    rows = rows.withColumns({"_p": F.last("_known", True).over(back), "_n": F.last("_known", True).over(ahead)})
    if not chunk_s:
        return rows.select(*own, F.col("_p").alias("_before"), F.col("_n").alias("_after"))
    rows = rows.withColumn("_parts", F.max("_part").over(Window.partitionBy(*keys)))
    # what a chunk hands on: what its outer stretch knows last, or that it broke; null hands on what came
    state = lambda inner, broke: F.when(inner.isNotNull(), F.struct(F.lit(False).alias("stop"), inner.alias("v"))).when(broke, F.struct(F.lit(True).alias("stop"), F.lit(None).cast(rows.schema["_known"].dataType).alias("v")))
    at = F.struct(*ORDER)
    ends = rows.groupBy(*keys).agg(
        F.max("_parts").alias("parts"),
        F.max_by(F.coalesce("_known", "_p"), at).alias("last"),
        F.min_by(F.when(F.col("_part") == 0, F.coalesce("_known", "_n")), at).alias("first"),
    )
    along, against = (Window.partitionBy("track_id").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_chunk"), F.desc("_chunk")))
    broke = F.col("parts") > 0
    carried = ends.select(
        F.col("track_id").alias("_track"), F.col("_chunk").alias("_at"),
        F.last(state(F.col("last"), broke), True).over(along).alias("_cp"),
        F.last(state(F.col("first"), broke), True).over(against).alias("_cn"),
    )
    # a carried stop has no value
    before, after = F.coalesce(F.col("_p"), F.when(F.col("_part") == 0, F.col("_cp")["v"])), F.coalesce(F.col("_n"), F.when(F.col("_part") == F.col("_parts"), F.col("_cn")["v"]))
    return _joined(rows, carried, ["_cp", "_cn"]).select(*own, before.alias("_before"), after.alias("_after"))
