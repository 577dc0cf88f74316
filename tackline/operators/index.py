"""A written search index of certificates, and the search of a second catalogue.

The index has a posting for each word of an entry and field, in folders by the word's first
two characters and sorted by word within them, so that all words with a beginning are one
range of few folders; and a row an entry with what ranks it. A search reads the ranges of
its words, keeps the entries that have them all, and only then reads entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tackline.functions.text import compact, fold, joined_words

#: Fields that a search can ask for by themselves.
FIELDS = ("name", "sail_no", "model", "builder", "designer", "certificate_year")
#: Beside these, words of these fields answer plain words of a search.
OTHERS = ("country", "year")
LEAD = 2


def words_of(x) -> Column:
    x = x if isinstance(x, Column) else F.col(x)
    return F.filter(F.split(joined_words(F.coalesce(x.cast("string"), F.lit(""))), " "), lambda w: w != "")


def number_of(sail: Column, country: Column) -> Column:
    """A sail number without the country that it begins with."""
    return F.when(F.startswith(sail, country) & (F.length(country) > 0) & (F.length(sail) > F.length(country)), F.substring(sail, F.length(country) + 1, F.length(sail))).otherwise(sail)


def _whole(field: str) -> Column:
    return compact(F.coalesce(F.col(field).cast("string"), F.lit("")))


def postings(entries: DataFrame) -> DataFrame:
    """(lead, token, field, plain, id): the words of each field and its whole without separators; ``plain`` tells which answer words of no field.

    A row's own words are told apart within it, so that no task holds more than a row of them.
    """
    number = number_of(_whole("sail_no"), _whole("country"))

    def tokens(words: Column, field: str, plain: bool) -> Column:
        return F.transform(words, lambda w: F.struct(w.alias("token"), F.lit(field).alias("field"), F.lit(plain).alias("plain")))

    parts = []
    for f in (*FIELDS, *OTHERS):
        plain, whole = words_of(f), F.array(_whole(f))
        if f in ("name", "sail_no"):
            plain = F.concat(plain, whole, F.array(number)) if f == "sail_no" else F.concat(plain, whole)
        plain = F.array_distinct(plain)
        parts.append(tokens(plain, f, True))
        if f in FIELDS and f not in ("name", "sail_no", "certificate_year"):
            parts.append(tokens(F.array_except(whole, plain), f, False))
    rows = entries.select("id", F.explode(F.concat(*parts)).alias("p")).select("p.*", "id").where("token <> ''")
    return rows.select(F.substring("token", 1, LEAD).alias("lead"), "token", "field", "plain", "id")


def build(entries: DataFrame, path: str) -> None:
    """Write the index of entries: id, the fields, year, country, withdrawn and whatever a search may be bounded by."""
    # dealt first: an entry has many words, and a small file of entries would be one task
    postings(entries.repartition("id")).repartitionByRange("token", "id").sortWithinPartitions("lead", "token", "id").write.partitionBy("lead").parquet(f"{path}/postings")
    keys = {f"_{f}": _whole(f) for f in FIELDS} | {"_number": number_of(_whole("sail_no"), _whole("country")), "_words": F.array_join(words_of("name"), " "), "_model_words": F.array_join(words_of("model"), " "), "_folded": fold("name")}
    entries.withColumns(keys).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/entries")


def _text(spark: SparkSession, make, value: str):
    """What a text function makes of a query's text."""
    return spark.range(1).select(make(F.lit(value))).first()[0]


def _begins(word: str) -> Column:
    """token begins with the word, as a range that files are pruned by."""
    lead, token = F.col("lead"), F.col("token")
    after = word[:-1] + chr(ord(word[-1]) + 1)
    own = lead == word[:LEAD] if len(word) >= LEAD else (lead >= word) & (lead < after)
    return own & (token >= word) & (token < after)


def candidates(spark: SparkSession, path: str, needs: list[tuple[str | None, str]]) -> DataFrame:
    """The ids of entries that have a word beginning with each (field or None, word)."""
    read = spark.read.parquet(f"{path}/postings")
    wanted = [_begins(w) & (F.col("plain") if f is None else F.col("field") == f) for f, w in needs]
    some = wanted[0]
    for c in wanted[1:]:
        some = some | c
    bits = F.lit(0)
    for k, c in enumerate(wanted):
        bits = bits.bitwiseOR(F.when(c, 1 << k).otherwise(0))
    return read.where(some).groupBy("id").agg(F.bit_or(bits).alias("has")).where(F.col("has") == (1 << len(needs)) - 1).select("id")


def search(spark: SparkSession, path: str, query: str, limit: int, offset: int = 0, where: Column | None = None, **fields: str) -> DataFrame:
    """id, tier, total of a page of entries, in rank order. Without words, whatever ``where`` admits is listed, or nothing without one.

    Tiers: 0 a field is exactly what is asked of it, 1 the sail number is the query, 2 the name begins with it, 3 the model
    does, 4 the rest; then newest certificate, name, id.
    """
    if set(fields) - set(FIELDS):
        raise ValueError(f"unknown fields: {sorted(set(fields) - set(FIELDS))}")
    words = _text(spark, words_of, query)
    asked = {f: _text(spark, words_of, v) for f, v in fields.items()}
    asked = {f: w for f, w in asked.items() if w}
    needs = list(dict.fromkeys([(None, w) for w in words] + [(f, w) for f, ws in asked.items() for w in ws]))
    if len(needs) > 30:
        raise ValueError("a search has at most 30 words")
    rows = spark.read.parquet(f"{path}/entries")
    if needs:
        rows = rows.join(candidates(spark, path, needs), "id", "left_semi")
    elif where is None:
        rows = rows.where("false")
    rows = rows.where(F.lit(True) if where is None else where)
    tier = F.lit(4)
    if words:
        phrase, whole = " ".join(words), _text(spark, compact, query)
        tier = F.when((F.col("_sail_no") == whole) | (F.col("_number") == whole), 1).when(F.startswith("_words", F.lit(phrase)), 2).when(F.startswith("_model_words", F.lit(phrase)), 3).otherwise(4)
    for f in asked:
        whole = _text(spark, compact, fields[f])
        exact = F.col(f"_{f}") == whole
        tier = F.when(exact | (F.col("_number") == whole) if f == "sail_no" else exact, 0).otherwise(tier)
    hits = rows.select("id", tier.alias("tier"), "certificate_year", "_folded")
    total = hits.agg(F.count("*").alias("total"))
    best = hits.orderBy("tier", F.desc_nulls_last("certificate_year"), "_folded", "id").offset(offset).limit(limit)
    return best.join(F.broadcast(total)).select("id", "tier", "total")


def matches(text, query: str) -> Column:
    """Each word of the query begins a word of the text, or the text without separators."""
    return F.forall(words_of(F.lit(query)), lambda q: F.exists(words_of(text), lambda w: F.startswith(w, q)) | F.startswith(compact(F.coalesce(text if isinstance(text, Column) else F.col(text).cast("string"), F.lit(""))), q))


#: What a query without a field is matched against, in this order.
_TEXT = ("name", "sail_no", "_sail", "model", "certificate", "certificate_year", "variant", "builder", "designer")


def second_search(entries: DataFrame, query: str, limit: int, offset: int = 0, where: Column | None = None, **fields: str) -> DataFrame:
    """id and total of a page of the second catalogue, newest certificates first, then by name and id. Every condition must hold, and none is asked for by an empty text."""
    ok = F.lit(True) if where is None else where
    for f, text in fields.items():
        ok = ok & matches(f, text)
    whole = F.concat_ws(" ", *[F.coalesce(compact(F.col("sail_no")) if c == "_sail" else F.col(c).cast("string"), F.lit("")) for c in _TEXT])
    hits = entries.where(ok & matches(whole, query)).select("id", "certificate_year", "name")
    total = hits.agg(F.count("*").alias("total"))
    best = hits.orderBy(F.desc_nulls_last("certificate_year"), "name", "id").offset(offset).limit(limit)
    return best.join(F.broadcast(total)).select("id", "total")
