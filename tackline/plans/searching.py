"""Queries of the written search index and of the second catalogue, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tackline.durable import shared_folder
from tackline.operators import catalogue, index
from tackline.plans import views as V
from tackline.plans.sql import d

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_YACHTS = f"""cert AS (SELECT c_custkey AS id, c_name AS name, concat(substring(n_name, 1, 3), CAST(c_custkey % 997 AS VARCHAR)) AS sail_no, substring(n_name, 1, 3) AS country, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS model, CASE WHEN c_custkey % 10 <> 0 THEN CAST(1990 + c_custkey % 35 AS INTEGER) END AS year, CASE WHEN c_custkey % 8 <> 0 THEN CAST(2019 + c_custkey % 7 AS INTEGER) END AS certificate_year, CASE WHEN c_custkey % 9 <> 0 THEN round(abs(c_acctbal)) / {d(500)} END AS loa, c_custkey % 17 = 0 AS withdrawn,
 CASE WHEN c_custkey % 6 <> 0 THEN concat('Yard ', CAST(c_custkey % 23 AS VARCHAR)) END AS builder, CASE WHEN c_custkey % 4 <> 0 THEN concat('D', CAST(c_custkey % 11 AS VARCHAR), ' & Co') END AS designer, concat('A-', CAST(c_custkey * 7 AS VARCHAR)) AS certificate, CASE WHEN c_custkey % 3 = 0 THEN 'double-handed' ELSE 'crew' END AS variant FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _w(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce(CAST({x} AS VARCHAR), '')), '[^a-z0-9]+', ' ', 'g'))"


def _c(x: str) -> str:
    return f"regexp_replace(lower(coalesce(CAST({x} AS VARCHAR), '')), '[^a-z0-9]', '', 'g')"


_KEYS = f"""{_YACHTS}, keys AS (SELECT *, {_c("sail_no")} AS sail, substring({_c("sail_no")}, 4) AS number, lower(name) AS folded,
 ' ' || {_w("name")} || ' ' || {_c("name")} || ' ' || {_w("sail_no")} || ' ' || {_c("sail_no")} || ' ' || substring({_c("sail_no")}, 4) || ' ' || {_w("country")} || ' ' || {_w("model")} || ' ' || {_w("builder")} || ' ' || {_w("designer")} || ' ' || {_w("year")} || ' ' || {_w("certificate_year")} AS hay,
 ' ' || {_w("builder")} || ' ' || {_c("builder")} AS h_builder, ' ' || {_w("designer")} || ' ' || {_c("designer")} AS h_designer, ' ' || {_c("sail_no")} || ' ' || substring({_c("sail_no")}, 4) AS h_sail FROM cert)"""


def _page(hits: str, limit: int, offset: int) -> str:
    return f"WITH {_KEYS}, hits AS ({hits}) SELECT id, tier, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY tier, certificate_year DESC NULLS LAST, folded, id LIMIT {limit} OFFSET {offset}"


def _index(spark, sf_dir) -> str:
    """The index of all certificates, written for the query at hand."""
    path = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    index.build(V.yachts(spark, sf_dir), path)
    return path


def search_index_words(spark, sf_dir):
    """Plain words in a written index, with bounds."""
    where = catalogue.admits(sizes={"loa": (2.0, None)}) & ~F.col("withdrawn")
    return index.search(spark, _index(spark, sf_dir), "12", 20, 0, where)


def search_index_fields(spark, sf_dir):
    """Words of two fields beside plain ones: what a field is exactly comes first."""
    return index.search(spark, _index(spark, sf_dir), "Customer", 25, 1, builder="yard-1", designer="d")


def search_index_sail(spark, sf_dir):
    """One field alone."""
    return index.search(spark, _index(spark, sf_dir), "", 12, 0, sail_no="11")


_SECOND_TEXT = f"(name || ' ' || sail_no || ' ' || {_c('sail_no')} || ' ' || coalesce(model, '') || ' ' || certificate || ' ' || coalesce(CAST(certificate_year AS VARCHAR), '') || ' ' || variant || ' ' || coalesce(builder, '') || ' ' || coalesce(designer, ''))"


def _matches(x: str, *words: str) -> str:
    return " AND ".join(f"(contains(' ' || {_w(x)}, ' {w}') OR starts_with({_c(x)}, '{w}'))" for w in words)


def second_catalogue_search(spark, sf_dir):
    """The second catalogue, field by field, with bounds and a page."""
    rows = V.yachts(spark, sf_dir)
    return index.second_search(rows, "crew 20", 15, 3, catalogue.admits(year=(1992, 2020), sizes={"loa": (1.0, 19.0)}), designer="D", model="", builder="yard1")


for _f, _sql in (
    (search_index_words, _page("SELECT id, CASE WHEN sail = '12' OR number = '12' THEN 1 WHEN starts_with(folded, '12') THEN 2 ELSE 4 END AS tier, certificate_year, folded FROM keys WHERE contains(hay, ' 12') AND loa >= 2 AND NOT withdrawn", 20, 0)),
    (search_index_fields, _page(f"SELECT id, CASE WHEN {_c('builder')} = 'yard1' OR {_c('designer')} = 'd' THEN 0 WHEN sail = 'customer' OR number = 'customer' THEN 1 WHEN starts_with({_w('name')}, 'customer') THEN 2 ELSE 4 END AS tier, certificate_year, folded FROM keys WHERE contains(hay, ' customer') AND contains(h_builder, ' yard') AND contains(h_builder, ' 1') AND contains(h_designer, ' d')", 25, 1)),
    (search_index_sail, _page("SELECT id, CASE WHEN sail = '11' OR number = '11' THEN 0 ELSE 4 END AS tier, certificate_year, folded FROM keys WHERE contains(h_sail, ' 11')", 12, 0)),
    (
        second_catalogue_search,
        f"WITH {_YACHTS}, hits AS (SELECT id, certificate_year, name FROM cert WHERE year BETWEEN 1992 AND 2020 AND loa BETWEEN 1 AND 19 AND {_matches('designer', 'd')} AND {_matches('builder', 'yard1')} AND {_matches(_SECOND_TEXT, 'crew', '20')}) SELECT id, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY certificate_year DESC NULLS LAST, name, id LIMIT 15 OFFSET 3",
    ),
):
    QUERIES[_f.__name__], ORACLE[_f.__name__] = _f, _sql
