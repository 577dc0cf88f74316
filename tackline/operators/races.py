"""Races: divisions of teams, whether a race has finished, and catalogues laid over each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tackline.functions.canonical import col, wrap_lon
from tackline.operators.catalogue import IDENTITY

#: Published results that end a boat's race; boxes (south, north, west, east) of two regional archives.
TERMINAL = ["FINISHED", "COMPLETED", "RETIRED", "DNF", "DNS", "DSQ", "ARR", "ARV", "RET", "ABD"]
NORTH_WEST_SHELF, IBERIA_BISCAY_IRELAND = (40.0, 65.1, -20.0, 13.1), (26.1, 56.1, -19.1, 5.1)


def divisions(teams: DataFrame, tags: DataFrame) -> DataFrame:
    """(team_id, division) of teams (team_id, tags): names of their shown tags with a start, or of all shown ones, in the tags' order.

    tags: tag_id, name, sort, start, show. A team without a shown tag has no row.
    """
    worn = teams.select("team_id", F.explode(F.array_distinct("tags")).alias("tag_id")).join(F.broadcast(tags), "tag_id").where("show is null or show <> 0")
    entry = F.struct(F.col("sort").isNull().alias("last"), "sort", "tag_id", "name")
    lists = worn.groupBy("team_id").agg(*[F.array_sort(F.collect_list(F.when(c, entry))).alias(n) for n, c in (("starting", F.col("start").isNotNull()), ("all", F.lit(True)))])
    return lists.select("team_id", F.array_join(F.when(F.size("starting") > 0, F.col("starting.name")).otherwise(F.col("all.name")), ", ").alias("division"))


def finished(events: DataFrame, boats: DataFrame, now: int) -> DataFrame:
    """(event_id, finished): every boat has a terminal result, there is one, and no date lies ahead of now.

    events: event_id, start, stop; boats: event_id, start, finish, status.
    """
    past = lambda c: F.col(c).isNull() | ((F.col(c) > 0) & (F.col(c) <= now))
    done = F.coalesce(F.upper(F.trim("status")).isin(TERMINAL), F.lit(False))
    result = boats.groupBy("event_id").agg(F.bool_and(past("start") & past("finish") & done).alias("_done"))
    return events.join(result, "event_id", "left").select("event_id", (past("start") & past("stop") & F.coalesce("_done", F.lit(False))).alias("finished"))


#: A report's codes and the status that each stands for; others stand for themselves.
STATUS = {"RAC": "RACING", "STA": "RACING", "ARV": "FINISHED", "RET": "RETIRED", "ABD": "RETIRED"}


def participants(rows: DataFrame, identities: DataFrame, on: str) -> DataFrame:
    """The rows of those who take part; an identity that is listed twice brings nothing twice."""
    return rows.join(identities.select(on), on, "left_semi")


def assembled(boats: DataFrame, fixes: DataFrame, reports: DataFrame, classes: DataFrame, runs: DataFrame, arrivals: DataFrame, hidden: DataFrame, start: int | None) -> DataFrame:
    """(boat_id, division, status, start, finish, fixes) of every boat of a race.

    boats: boat_id, class_id; fixes: boat_id, t; reports: boat_id, seq, t, code; classes: class_id, name, run_id; runs: run_id,
    start; arrivals and hidden: boat_id, t. A boat that arrived has finished, whatever it reported last; it starts with the run
    of its class, else with the race; it ends when it arrived, else when it was hidden, else with the last fix of any boat, or
    with the last report where there is no fix.
    """
    # a row a boat each, before anything is joined
    sailed = participants(fixes, boats, "boat_id").groupBy("boat_id").agg(F.count(F.lit(1)).alias("fixes"), F.max("t").alias("_last"))
    said = reports.groupBy("boat_id").agg(F.max_by(F.struct("code"), "seq").alias("_said"))
    ends = lambda df, name: df.groupBy("boat_id").agg(F.max("t").alias(name))
    stop = sailed.agg(F.max("_last").alias("_stop")).join(reports.agg(F.max_by("t", "seq").alias("_line")))
    code = F.col("_said.code")
    known = code
    for k, v in STATUS.items():
        known = F.when(code == k, v).otherwise(known)
    rows = boats.select("boat_id", "class_id").join(classes.select("class_id", "name", "run_id"), "class_id", "left").join(runs.select("run_id", F.col("start").alias("_run")), "run_id", "left")
    for more in (sailed, said, ends(arrivals, "_arrived"), ends(hidden, "_hidden")):
        rows = rows.join(more, "boat_id", "left")
    # one row
    rows = rows.join(F.broadcast(stop))
    return rows.select(
        "boat_id", F.nullif("name", F.lit("")).alias("division"), F.when(F.col("_arrived").isNotNull(), "FINISHED").otherwise(known).alias("status"),
        F.coalesce("_run", F.lit(start).cast("long")).alias("start"), F.coalesce("_arrived", "_hidden", "_stop", "_line").alias("finish"), F.coalesce("fixes", F.lit(0)).alias("fixes"),
    )


def in_region(lat, lon, box: tuple[float, float, float, float]) -> Column:
    """Whether a place lies in a box, edges included, whatever turn its longitude is written in."""
    south, north, west, east = box
    return F.coalesce(col(lat).between(south, north) & wrap_lon(lon).between(west, east), F.lit(False))


def overlaid(embedded: DataFrame, scraped: DataFrame) -> DataFrame:
    """One catalogue: (embedded_id, scraped_id, withdrawn); an entry is of ``scraped`` where it has a scraped_id, and keeps an embedded_id's place.

    The first current scraped certificate of an identity stands for the first embedded one; the others follow in their order.
    """
    first = lambda i: F.row_number().over(Window.partitionBy(*IDENTITY).orderBy(i))
    current = scraped.where("not withdrawn").withColumn("_k", first("scraped_id")).where("_k = 1")
    old = embedded.withColumn("_k", first("embedded_id"))
    on = F.col("_k") == 1
    for c in IDENTITY:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    twin = current.select(F.col("scraped_id"), *[F.col(c).alias(f"_{c}") for c in IDENTITY])
    placed = old.join(twin, on, "left").select("embedded_id", "scraped_id", F.lit(False).alias("withdrawn"))
    used = placed.where("scraped_id is not null").select("scraped_id")
    return placed.unionByName(scraped.join(used, "scraped_id", "left_anti").select(F.lit(None).cast("long").alias("embedded_id"), "scraped_id", "withdrawn"))
