"""URL filtering against dated lists.

A list changes over time: entries are added and removed on known days. Those
events become validity intervals, and every capture is joined as of its fetch
time with the entries that were active then. An entry names a domain and
covers its subdomains.

All of it is DataFrame expressions. Only distinct pairs of host and time are
matched, so a host with a third of the captures costs no more than its days.
Intervals are laid out by month within the time that captures span, and the
join is on (domain, month): a capture meets the intervals of one month alone,
however often an entry came and went.

Defined cases: a capture without a host or time matches nothing; an entry that
is added twice keeps its first day, a removal of what is not listed has no
effect, and on the day of removal an entry no longer holds; of events on one
day for one entry the removal counts; repeated captures give repeated rows;
empty captures or lists give no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The day after any capture.
OPEN_END = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user or port; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(host != "", host)


def validity_intervals(events: DataFrame) -> DataFrame:
    """(list_name, domain, valid_from, valid_to) from events (list_name, domain, day, action 'add' or 'remove').

    Intervals of one entry do not meet; the end is exclusive and open where no removal follows.
    """
    by = Window.partitionBy("list_name", "domain").orderBy("day")
    known = events.where("list_name is not null and domain is not null and day is not null and action in ('add', 'remove')")
    daily = known.groupBy("list_name", F.lower("domain").alias("domain"), "day").agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("active"))
    changes = daily.withColumn("before", F.coalesce(F.lag("active").over(by), F.lit(0))).where("active <> before")
    ends = changes.withColumn("valid_to", F.coalesce(F.lead("day").over(by), F.lit(OPEN_END).cast("date")))
    return ends.where("active = 1").select("list_name", "domain", F.col("day").alias("valid_from"), "valid_to")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def evaluate(captures: DataFrame, events: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """The captures with host, blocked, n_matches and matched ('list:domain', sorted and comma-joined).

    Columns of the captures with these names are replaced.
    """
    names = ("host", "blocked", "n_matches", "matched")
    captures = captures.select(*[F.col(f"`{c}`") for c in captures.columns if c not in names], host_of(F.col(url_col)).alias("host"))
    keys = captures.select("host", F.col(day_col).alias("_day")).where("host is not null and _day is not null").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = keys.select("host", "_day", _month(F.col("_day")).alias("month"), F.explode(suffixes).alias("domain"))
    # months outside those that captures span are never asked for
    first, last = keys.agg(F.min("_day"), F.max("_day")).first()
    first, last = (F.lit(x or "1970-01-01").cast("date") for x in (first, last))
    held = validity_intervals(events).where((F.col("valid_from") <= last) & (F.col("valid_to") > first))
    held = held.withColumn("month", F.explode(F.sequence(_month(F.greatest("valid_from", first)), _month(F.least("valid_to", last)))))
    found = asked.join(held, ["domain", "month"]).where("valid_from <= _day and _day < valid_to")
    entry = F.concat_ws(":", "list_name", "domain")
    verdicts = found.groupBy("host", "_day").agg(F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("matched")).withColumnRenamed("host", "_host")
    out = captures.join(verdicts, (F.col("host") == F.col("_host")) & (F.col(day_col) == F.col("_day")), "left").drop("_host", "_day")
    return out.withColumns({"blocked": F.col("n_matches").isNotNull(), "n_matches": F.coalesce("n_matches", F.lit(0).cast("long")), "matched": F.coalesce("matched", F.lit(""))})
