"""Edit and measuring tools by hand-worked cases; their queries are held against SQL elsewhere."""

import pytest
from pyspark.sql import functions as F

from tackline.operators import edits, measure
from tackline.sources import polar_files

CELL = "source_id int, twa double, tws double, bsp double"


def test_written_and_reset_cells(spark):
    held = spark.createDataFrame([(1, 50.0, 8.0, 5.0), (2, 50.0, 8.0, 5.0)], CELL)
    chosen = spark.createDataFrame([(1, 50.0, 8.0, None), (2, 50.0, 8.0, None), (2, 60.0, 8.0, None)], CELL)
    typed = edits.write(chosen, 6.5)
    assert [tuple(r) for r in edits.changes(held, typed).collect()] == [(1, 50.0, 8.0, 5.0, 6.5)]
    assert [tuple(r) for r in edits.edited(held, typed).orderBy("source_id").collect()] == [(1, 50.0, 8.0, 6.5), (2, 50.0, 8.0, 5.0)]
    assert edits.edited(held, edits.reset(chosen)).isEmpty()
    assert edits.changes(held, edits.write(chosen, 5.0)).isEmpty()
    for wrong in (lambda: edits.write(chosen, 60.5), lambda: edits.scale(held, chosen, -100.0)):
        with pytest.raises(ValueError):
            wrong()


def test_points_of_a_plot(spark):
    curves = spark.createDataFrame([(1, a, 8.0, b) for a, b in ((40.0, 4.0), (60.0, 6.0))] + [(2, 50.0, 8.0, 7.0), (3, 70.0, 8.0, 9.0)], CELL)
    found = measure.crossings(curves, 50.0)
    assert [(r["source_id"], r["bsp"], r["place"]) for r in found.orderBy("place").collect()] == [(2, 7.0, 0), (1, 5.0, 1)]
    assert measure.nearest_crossing(found, 6.0).first()["source_id"] == 2
    got = spark.range(1).select(*[c.alias(n) for n, c in measure.between(350.0, 4.0, 20.0, 5.0).items()], measure.inside(F.lit(1.0), F.lit(1.0), [(0.0, 0.0), (2.0, 2.0)]).alias("in")).first()
    assert tuple(got) == (1.0, 1.25, 30.0, False)


def test_a_file_over_the_limit_is_named(spark):
    size = polar_files.MAX_FILE_BYTES
    files = spark.range(1).select(F.lit("big").alias("path"), F.encode(F.repeat(F.lit("8 45 6\n"), size // 7 + 1), "UTF-8").alias("content"))
    cells, problems = polar_files.polars_of(files)
    assert [tuple(r) for r in problems.collect()] == [("big", None, "too-large")] and cells.isEmpty()


def test_words_of_an_entry_are_told_apart_without_gathering_them(spark):
    from tackline.operators import index

    entries = spark.createDataFrame([(1, "Foo Foo bar", "FRA12", "FRA", "foobar", "Yard 1", "yard1", 2020, 2020)], "id long, name string, sail_no string, country string, model string, builder string, designer string, year int, certificate_year int")
    got = index.postings(entries)
    assert sorted((r["token"], r["field"], r["plain"]) for r in got.collect()) == sorted(
        [("foo", "name", True), ("bar", "name", True), ("foofoobar", "name", True), ("fra12", "sail_no", True), ("12", "sail_no", True), ("foobar", "model", True), ("yard", "builder", True), ("1", "builder", True), ("yard1", "builder", False), ("yard1", "designer", True), ("2020", "certificate_year", True), ("fra", "country", True), ("2020", "year", True)]
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_the_same_wind_meets_some_points_of_a_full_bin(spark, monkeypatch):
    """As by comparing all with all; equal points count once, and full bins are halved, near their edges and beside empty ones too."""
    import random

    from tackline.operators import measure

    rng = random.Random(8)
    rows = [(k, k % 3, rng.choice([rng.uniform(355, 360), rng.uniform(0, 4), 2.5, 90.0]), rng.choice([10.0, 10.1, 11.0, rng.gauss(10.5, 0.4)])) for k in range(1_500)] + [(k, 4, 180.0 + k % 2, 12.9) for k in range(2_000, 2_300)] + [(k, 5, 180.0 + k / 1_000, 12.0) for k in range(3_000, 3_090)]
    frame = spark.createDataFrame([*rows, (9_000, None, 1.0, 1.0), (9_001, 1, None, 1.0)], "id long, copy int, twa double, tws double")
    asked = [r for r in rows if r[0] % 10 == 0]
    want = {}
    for i, own, a, w in asked:
        for j, copy, b, v in rows:
            d = (b - a) % 360 % 360
            d = min(d, 360 - d)
            if copy != own and d <= 5 and abs(v - w) <= 1:
                want[i, copy] = min(want.get((i, copy), (9.0, 0)), (d * d / 25 + (v - w) * (v - w), j))
    for few in (2, 4, 5_000):
        monkeypatch.setattr(measure, "FEW", few)
        got = measure.same_wind(frame, frame.where("id % 10 = 0").withColumnRenamed("id", "asked_id"))
        assert {(r["asked_id"], r["copy"]): r["id"] for r in got.collect()} == {k: v[1] for k, v in want.items()}


def test_the_same_wind_sends_no_table_through_the_driver(spark):
    rows = spark.createDataFrame([(k, k % 3, 40.0 + k % 50 / 25, 10.0 + k % 7 / 14) for k in range(300)], "id long, copy int, twa double, tws double")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")  # a broadcast fails
    try:
        got = measure.same_wind(rows, rows.where("id % 10 = 0").withColumnRenamed("id", "asked_id"))
        assert {(r["asked_id"], r["copy"]) for r in got.collect()} == {(k, c) for k in range(0, 300, 10) for c in range(3) if c != k % 3}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_pairs_of_one_model_are_not_made_by_a_broadcast(spark):
    from tackline.operators import catalogue

    boats = spark.range(60).select(F.col("id").alias("boat_id"), F.lit("First 30").alias("model"), F.when(F.col("id") % 5 != 0, 8 + (F.col("id") % 7) / 4.0).alias("length"))
    got = catalogue.model_matches(boats)
    length = lambda k: None if k % 5 == 0 else 8 + k % 7 / 4
    want = [(a, b) for a in range(60) for b in range(a + 1, 60) if None in (length(a), length(b)) or abs(length(a) - length(b)) <= max(0.6, 0.05 * min(length(a), length(b)))]
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
