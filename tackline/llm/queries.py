"""The queries of this subpackage: each applies one operator to its whole table.

A query gives the columns that its contract names first, and may add more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from tackline.llm import mixing, negatives, neighbours, packing, paragraphs, pii, prefixes, quality, repetition, secrets, simhash, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(doc_id, parts: int = 4, part: int = 2):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Weights learnt from labelled rows outside the held-out fold."""
    labels = _table(spark, sf_dir, "labels")
    return quality.fit(docs, labels.where(~_held_out(F.col("doc_id"))))


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op5_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_table(spark, sf_dir, "documents"))


#: (list, domain, day, action) as a list's history would tell it.
URL_EVENTS = [
    ("spam", "spam-farm.example.org", "2023-02-01", "add"), ("spam", "spam-farm.example.org", "2023-09-15", "remove"), ("spam", "spam-farm.example.org", "2024-01-10", "add"),
    ("pharmacy", "cheap-pills.example.net", "2023-03-05", "add"), ("pharmacy", "cheap-pills.example.com", "2023-03-05", "add"), ("pharmacy", "cheap-pills.example.com", "2024-03-01", "remove"),
    ("gambling", "casino-win.example.net", "2023-01-01", "add"), ("gambling", "free-bets.example.net", "2023-06-01", "add"), ("gambling", "free-bets.example.net", "2023-06-20", "remove"),
    ("adult", "adult-x.example.com", "2022-11-01", "add"), ("tracking", "ads-track.example.com", "2023-12-31", "add"),
    ("review", "tionsh.example.net", "2023-07-01", "add"), ("review", "blog.tionsh.example.net", "2023-04-01", "add"), ("review", "tionsh.example.net", "2023-08-01", "remove"),
]


def op6_url_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch date: the page id tells the day, over two years."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")).alias("fetched_on"))
    events = spark.createDataFrame(URL_EVENTS, "list_name string, domain string, day string, action string").withColumn("day", F.col("day").cast("date"))
    found = urls.evaluate(pages, events)
    return found.select("page_id", "host", F.date_format("fetched_on", "yyyy-MM-dd").alias("fetched_on"), "blocked", "n_matches", "matched")


_URL_VALUES = ", ".join(f"('{a}', '{b}', DATE '{c}', '{d}')" for a, b, c, d in URL_EVENTS)
OP6_SQL = f"""
WITH events(list_name, domain, day, action) AS (VALUES {_URL_VALUES}),
held AS (
  SELECT a.list_name, a.domain, a.day AS valid_from,
         coalesce((SELECT min(r.day) FROM events r WHERE r.list_name = a.list_name AND r.domain = a.domain AND r.action = 'remove' AND r.day > a.day), DATE '9999-12-31') AS valid_to
  FROM events a WHERE a.action = 'add'
), captures AS (
  SELECT page_id, DATE '2023-01-01' + CAST((page_id * 37) % 730 AS INTEGER) AS fetched_on,
         nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)', 2), '') AS host
  FROM pages
)
SELECT c.page_id, c.host, strftime(c.fetched_on, '%Y-%m-%d') AS fetched_on, count(h.domain) > 0 AS blocked, count(h.domain) AS n_matches,
       coalesce(string_agg(h.list_name || ':' || h.domain, ',' ORDER BY h.list_name || ':' || h.domain), '') AS matched
FROM captures c LEFT JOIN held h ON (c.host = h.domain OR ends_with(c.host, '.' || h.domain)) AND h.valid_from <= c.fetched_on AND c.fetched_on < h.valid_to
GROUP BY c.page_id, c.host, c.fetched_on
"""


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op9_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op10_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.probabilities(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(_table(spark, sf_dir, "conversations"))


#: DuckDB has no crc32: it is worked out byte by byte from its table of 256 remainders.
OP11_SQL = """
WITH steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 20 AS b, n, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), steps
), built AS (
  SELECT v.c, t.i + 1 AS d, role, text FROM convs v JOIN turns t ON t.c = v.b AND t.i < v.h
  UNION ALL
  SELECT v.c, t.i + 1 - v.h + least(v.h, coalesce(b.n, 0)), role, text FROM convs v JOIN turns t ON t.c = v.c AND t.i >= v.h LEFT JOIN convs b ON b.c = v.b
), lengths AS (SELECT v.c, count(b.d) AS len FROM convs v LEFT JOIN built b USING (c) GROUP BY v.c
), paths AS (
  SELECT c, 0 AS d, '' AS node, '' AS text FROM convs
  UNION ALL
  SELECT c, d, sha256(string_agg(sha256(role || chr(1) || text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)), text FROM built
), nodes AS (
  SELECT node, d, min(c) AS conv, count(*) AS n, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS own,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '')) AS ends
  FROM paths JOIN lengths USING (c) GROUP BY node, d
), up AS (
  SELECT k.node, k.d, p.node AS above, p.d AS above_d FROM nodes k JOIN paths p ON p.c = k.conv AND p.d <= k.d
), parents AS (SELECT node, d, above FROM up WHERE above_d = d - 1
), children AS (SELECT above AS node, d - 1 AS d, count(*) AS n FROM parents GROUP BY above, d
), sums AS (
  SELECT u.above AS node, u.above_d AS d, count(*) FILTER (ch.n IS NULL) AS leaves, sum(k.own) AS saved
  FROM up u JOIN nodes k ON k.node = u.node AND k.d = u.d LEFT JOIN children ch ON ch.node = u.node AND ch.d = u.d GROUP BY u.above, u.above_d
)
SELECT k.conv AS conv_id, CAST(k.d AS BIGINT) AS depth, a.conv AS parent_conv_id, k.n AS n_convs, coalesce(ch.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, k.ends AS ends_sha256
FROM nodes k JOIN sums s ON s.node = k.node AND s.d = k.d LEFT JOIN children ch ON ch.node = k.node AND ch.d = k.d
LEFT JOIN parents p ON p.node = k.node AND p.d = k.d LEFT JOIN nodes a ON a.node = p.above AND a.d = p.d - 1
"""


def op12_text_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), _held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op13_blocked_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, label)


OP13_SQL = """
WITH held AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM held a JOIN held b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0
), positives AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) <= 5
"""


QUERIES = {
    "op1_pack_windows": op1_pack_windows,
    "op2_simhash_trie": op2_simhash_trie,
    "op3_paragraph_minhash": op3_paragraph_minhash,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_suffix_repetition": op5_suffix_repetition,
    "op6_url_temporal_lists": op6_url_temporal_lists,
    "op7_contextual_pii": op7_contextual_pii,
    "op8_secret_scan": op8_secret_scan,
    "op9_multiprobe_neighbours": op9_multiprobe_neighbours,
    "op10_raked_mixture": op10_raked_mixture,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_text_cnn": op12_text_cnn,
    "op13_blocked_negatives": op13_blocked_negatives,
}
ORACLE: dict[str, str] = {"op6_url_temporal_lists": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op13_blocked_negatives": OP13_SQL}
