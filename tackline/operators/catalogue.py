"""Certificate and track catalogues: search, facets, upsert, identity, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tackline.functions.canonical import holds
from tackline.functions.text import compact, fold, joined_words, model_key

IDENTITY = ["country", "sail_no", "name", "model", "year", "certificate_year"]


def _query_words(query: str) -> Column:
    """The words of a query, folded as the entries are."""
    return F.filter(F.split(joined_words(F.lit(query)), " "), lambda w: w != "")


def with_keys(entries: DataFrame) -> DataFrame:
    """Adds what a search reads: folded words, compact sail numbers with and without the country, name and model."""
    sail, country, name = compact("sail_no"), compact("country"), compact("name")
    number = F.when(F.startswith(sail, country) & (F.length(sail) > F.length(country)), F.substring(sail, F.length(country) + 1, F.length(sail))).otherwise(sail)
    text = F.concat_ws(" ", F.lit(""), *[joined_words(c) for c in ("name", "sail_no", "country", "model")], sail, number, name, F.col("year").cast("string"), F.col("certificate_year").cast("string"))
    return entries.withColumns({"_hay": text, "_sail": sail, "_number": number, "_name": joined_words("name"), "_model": F.coalesce(joined_words("model"), F.lit(""))})


def admits(country: str | None = None, year: tuple[int | None, int | None] = (None, None), sizes: dict[str, tuple[float | None, float | None]] | None = None) -> Column:
    """The catalogue's filters: a missing value fails a bound that is set."""
    ok = F.lit(True)
    if country is not None:
        ok = ok & holds(F.lower("country") == country.lower())
    for name, (low, high) in {"year": year, **(sizes or {})}.items():
        if low is not None:
            ok = ok & holds(F.col(name) >= low)
        if high is not None:
            ok = ok & holds(F.col(name) <= high)
    return ok


def search(entries: DataFrame, query: str, limit: int, offset: int = 0, where: Column | None = None) -> DataFrame:
    """The best entries whose words begin with all of the query's: id, tier, total, in rank order. A query without words has no hits.

    Tiers: 1 exact sail number, 2 name begins with the phrase, 3 model does, 4 the rest; then newest certificate, name, id.
    """
    words = _query_words(query)
    phrase, whole = F.array_join(words, " "), F.array_join(words, "")
    rows = with_keys(entries).where(where if where is not None else F.lit(True))
    rows = rows.where((F.size(words) > 0) & F.forall(words, lambda w: F.contains("_hay", F.concat(F.lit(" "), w))))
    tier = F.when((F.col("_sail") == whole) | (F.col("_number") == whole), 1).when(F.startswith("_name", phrase), 2).when(F.startswith("_model", phrase), 3).otherwise(4)
    hits = rows.select("id", tier.alias("tier"), F.col("certificate_year").alias("_year"), fold("name").alias("_folded"))
    total = hits.agg(F.count("*").alias("total"))
    best = hits.orderBy("tier", F.desc_nulls_last("_year"), "_folded", "id").offset(offset).limit(limit)
    return best.join(F.broadcast(total)).select("id", "tier", "total")


def library_search(tracks: DataFrame, query: str, limit: int) -> DataFrame:
    """Tracks whose text holds the whole phrase first, then those that hold all its words; by name, newest start, id."""
    words = _query_words(query)
    rows = tracks.withColumn("_t", fold(F.concat_ws(" ", "boat", "event")))
    rows = rows.where((F.size(words) > 0) & F.forall(words, lambda w: F.contains("_t", w)))
    rows = rows.withColumn("tier", F.when(F.contains(F.col("_t"), F.array_join(words, " ")), 0).otherwise(1))
    return rows.orderBy("tier", F.lower("boat"), F.desc_nulls_last("start"), "track_id").limit(limit).select("track_id", "boat", "start", "tier")


def facets(entries: DataFrame) -> DataFrame:
    """One row: the countries in order, the years' range, and counts."""
    return entries.agg(F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("entries"), F.count_if(~F.col("withdrawn")).alias("current"))


def upsert(stored: DataFrame, incoming: DataFrame, listed: DataFrame, year: int) -> DataFrame:
    """The store after a scrape, with ``change`` (added, updated, withdrawn or kept).

    Of incoming rows with one reference the last (by ``seq``) counts. A stored entry of the year whose country has a list is
    withdrawn when the list leaves it out; countries without a list withdraw nothing. Both tables have ref_no, country,
    certificate_year, payload; stored also withdrawn.
    """
    fresh = incoming.groupBy("ref_no").agg(F.max(F.struct("seq", "country", "certificate_year", "payload")).alias("n"))
    both = stored.withColumn("_had", F.lit(True)).join(fresh, "ref_no", "full")
    new, old = F.struct("n.country", "n.certificate_year", "n.payload", F.lit(False)), F.struct("country", "certificate_year", "payload", "withdrawn")
    change = F.when(F.col("_had").isNull(), "added").when(F.col("n").isNotNull() & ~new.eqNullSafe(old), "updated").otherwise("kept")
    take = F.col("n").isNotNull()
    rows = both.select("ref_no", change.alias("change"), *[F.when(take, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in ("country", "certificate_year", "payload")], F.when(take, False).otherwise(F.col("withdrawn")).alias("withdrawn"))
    lists = listed.select(F.col("country").alias("_c")).distinct()
    on_list = listed.select(F.col("country").alias("_lc"), F.col("ref_no").alias("_lr")).distinct()
    rows = rows.join(lists, F.col("country") == F.col("_c"), "left").join(on_list, (F.col("country") == F.col("_lc")) & (F.col("ref_no") == F.col("_lr")), "left")
    gone = holds(~F.col("withdrawn") & (F.col("certificate_year") == year) & F.col("_c").isNotNull() & F.col("_lr").isNull())
    return rows.select("ref_no", "country", "certificate_year", "payload", (F.col("withdrawn") | gone).alias("withdrawn"), F.when(gone, "withdrawn").otherwise(F.col("change")).alias("change"))


def identity_match(scraped: DataFrame, embedded: DataFrame) -> DataFrame:
    """(scraped_id, embedded_id or null): the same certificate in both, missing fields equal; each entry is used once, in order of ids."""
    w = lambda i: Window.partitionBy(*IDENTITY).orderBy(i)
    s = scraped.withColumn("_k", F.row_number().over(w("scraped_id"))).select("scraped_id", "_k", *IDENTITY)
    e = embedded.withColumn("_k", F.row_number().over(w("embedded_id"))).select("embedded_id", "_k", *IDENTITY).toDF("embedded_id", "_ek", *[f"_{c}" for c in IDENTITY])
    on = F.col("_k") == F.col("_ek")
    for c in IDENTITY:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return s.join(e, on, "left").select("scraped_id", "embedded_id")


#: Metres and share by which lengths of one model may differ.
NEAR_M, NEAR_SHARE = 0.6, 0.05


#: Tasks that share the pairs of one model.
SHARES = 4


def model_matches(boats: DataFrame) -> DataFrame:
    """Pairs (a, b) of boats that share a model key and whose lengths, where both are known, differ by at most 0.6 m or 5 % of the shorter.

    There are as many pairs as the square of a model's boats. Both sides are shuffled, however small their files are: a
    broadcast would leave all pairs to the tasks that read them. A model's pairs are dealt by their first boat.
    """
    keyed = boats.withColumn("key", model_key("model")).where("key is not null")
    a = keyed.select("key", F.col("boat_id").alias("a"), F.col("length").alias("la"), F.pmod(F.xxhash64("boat_id"), F.lit(SHARES)).cast("int").alias("share"))
    b = keyed.select("key", F.col("boat_id").alias("b"), F.col("length").alias("lb"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    near = F.col("la").isNull() | F.col("lb").isNull() | (F.abs(F.col("la") - F.col("lb")) <= F.greatest(F.lit(NEAR_M), NEAR_SHARE * F.least("la", "lb")))
    parts = int(boats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (x.repartition(parts, "key", "share") for x in (a, b))
    return a.join(b.hint("merge"), ["key", "share"]).where((F.col("a") < F.col("b")) & near).select("a", "b", "key")


def model_classes(boats: DataFrame) -> DataFrame:
    """(boat_id, key, class_id, links): each boat's class and how many boats match it, one row a boat.

    Boats match as in :func:`model_matches`. A class is what matches connect, named by its smallest boat: of the lengths in
    order each reaches up to some longer one, and a length that none before it reaches starts a class; a boat of unknown length
    matches all of its model. Boats of one model and length are counted together, so that pairs are never made.
    """
    keyed = boats.withColumn("key", model_key("model")).where("key is not null").select("boat_id", "key", "length")
    sizes = keyed.groupBy("key", "length").agg(F.count(F.lit(1)).alias("n"), F.min("boat_id").alias("least"))
    by, x = Window.partitionBy("key"), F.col("length")
    up, down = F.greatest(x + NEAR_M, x * (1.0 + NEAR_SHARE)), F.least(x - NEAR_M, x / (1.0 + NEAR_SHARE))
    reached = F.max(up).over(by.orderBy("length").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumns({"_new": F.coalesce(x > reached, F.lit(False)).cast("int"), "_open": F.max(x.isNull()).over(by), "_all": F.sum("n").over(by), "_unknown": F.sum(F.when(x.isNull(), F.col("n")).otherwise(0)).over(by)})
    sizes = sizes.withColumn("_chain", F.when(F.col("_open"), 0).otherwise(F.sum("_new").over(by.orderBy("length"))))
    sizes = sizes.withColumn("class_id", F.min("least").over(Window.partitionBy("key", "_chain")))
    # as many as a model has different lengths
    lists = sizes.where("length is not null").groupBy("key").agg(F.collect_list(F.struct(F.col("length").alias("x"), "n")).alias("known"))
    sizes = sizes.join(lists, "key", "left").withColumns({"_up": up, "_down": down})
    near = F.aggregate(F.filter("known", lambda k: (k["x"] >= F.col("_down")) & (k["x"] <= F.col("_up"))), F.lit(0).cast("long"), lambda s, k: s + k["n"])
    sizes = sizes.select(F.col("key").alias("_key"), F.col("length").alias("_length"), "class_id", (F.when(x.isNull(), F.col("_all")).otherwise(near + F.col("_unknown")) - 1).alias("links"))
    return keyed.join(sizes, (F.col("key") == F.col("_key")) & F.col("length").eqNullSafe(F.col("_length"))).select("boat_id", "key", "class_id", "links")


def model_consensus(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The one model that all candidates agree on; keys with several are left out."""
    return candidates.where("model is not null").groupBy(*keys).agg(F.min("model").alias("model"), F.max("model").alias("_m")).where(F.col("model") == F.col("_m")).drop("_m")
