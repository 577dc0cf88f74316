"""Operators that split what is large: the same rows however it is cut, and against plain Python."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tackline.operators import chunks, filters, polar, ranks, tracks
from tackline.plans import views as V

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_percentiles_of_a_cell_with_nearly_all_rows(spark):
    rng = random.Random(4)
    rows = [(1, round(rng.gauss(9, 2) if k % 3 else 7.25, 6)) for k in range(9_000)] + [(k % 40 + 2, round(rng.uniform(0, 30), 6)) for k in range(900)] + [(None, x) for x in (3.0, 900.5, 901.5, 1e7)] + [(99, 5.0)]
    rows = [(k, abs(x)) for k, x in rows]
    frame = spark.createDataFrame(rows, "cell int, x double")
    groups = {}
    for k, x in rows:
        groups.setdefault(k, []).append(x)
    for fraction in (0.0, 0.5, 0.75, 0.9, 1.0):
        got = {r["cell"]: r for r in ranks.percentile_by(frame, ["cell"], "x", fraction).collect()}
        assert got.keys() == groups.keys()
        for k, xs in groups.items():
            assert got[k]["n"] == len(xs) and abs(got[k]["value"] - np.quantile(xs, fraction)) < 1e-9
            if len(xs) > 1:
                assert math.isclose(got[k]["spread"], statistics.stdev(xs), rel_tol=1e-9)
            else:
                assert got[k]["spread"] is None
    assert ranks.percentile_by(frame.where("false"), ["cell"], "x", 0.5).count() == 0


def test_buckets_ascend():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    xs = sorted([0.0, 0.1, 0.125, 1.0, 127.9, 127.999999, 128.0, 128.1, 140.0, 1e3, 1e9, 1e300, float("inf")])
    got = [r["b"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", ranks.bucket("x").alias("b")).orderBy("x").collect()]
    assert got == sorted(got) and got[0] == 0 and len(set(got)) > 6


def test_a_segment_of_one_full_cell(spark):
    rows = [(90.0, 10.0, 5.0 + k % 7) for k in range(700)] + [(0.0, 10.0, 1.0), (91.0, 10.0, float("nan")), (92.0, 10.0, None), (80.0, 10.0, 4.0)]
    got = polar.segment(spark.createDataFrame(rows, "twa double, tws double, bsp double"), [0.0, 80.0, 90.0, 100.0], [10.0], "p90", 5).orderBy("i").collect()
    assert [(r["i"], r["n"], r["bsp"]) for r in got] == [(1, 1, None), (2, 700, 11.0)]


def test_the_first_group_that_fills_a_cell(spark):
    rows = [(90.0, 10.0, float(k), k % 10) for k in range(40)] + [(120.0, 10.0, float(k), 9) for k in range(8)] + [(150.0, 10.0, 1.0, 0)]
    frame = spark.createDataFrame(rows, "twa double, tws double, bsp double, w int")
    groups = [F.col("w") < 1, F.col("w") < 5, F.lit(True)]
    got = polar.priority_segment(frame, [0.0, 90.0, 120.0, 150.0], [10.0], groups, 5, 0.5).orderBy("i").collect()
    assert [(r["i"], r["grp"], r["n"]) for r in got] == [(1, 1, 20), (2, 2, 8)]
    rows = polar.choose_priority(frame, [0.0, 90.0, 120.0, 150.0], [10.0], groups, 5)
    assert rows_of(rows.groupBy("i", "grp").count()) == [(1, 1, 20), (2, 2, 8)]


@pytest.mark.parametrize("chunk", [1, 40_000, 1_000_000, 10**12])
def test_chunks_of_any_length_give_the_same_samples(spark, chunk):
    fixes = tracks.normalise(V.fixes(spark, SF), V.ENVIRONMENT)
    assert rows_of(tracks.derive(fixes, V.MAX_GAP_S, chunk_s=chunk)) == rows_of(tracks.derive(fixes, V.MAX_GAP_S, chunk_s=None))
    samples = V.samples(spark, SF)
    for f in (filters.SampleFilters(exclude_tacks=True), filters.SampleFilters(max_wind_speed_change_kn=8.0, max_awa_change_deg=60.0, max_wind_direction_change_deg=90.0)):
        marked = [rows_of(filters.mark(samples, f, True, 500_000, c).select("track_id", "t", "fix_idx", "filtered")) for c in (chunk, None)]
        assert marked[0] == marked[1] and len({r[-1] for r in marked[0]}) == 2


def brute_known(rows):
    """The last and next known value with no break between; a breaking row belongs to the stretch that it starts."""
    out = []
    rows = sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2]))
    for k, (track, t, i, breaks, known) in enumerate(rows):
        before = after = None
        if not breaks:
            for r in reversed(rows[:k]):
                if r[0] != track:
                    break
                if r[4] is not None:
                    before = r[4]
                if r[3] or r[4] is not None:
                    break
        for r in rows[k + 1 :]:
            if r[0] != track or r[3]:
                break
            if r[4] is not None:
                after = r[4]
                break
        out.append((track, t, i, before, after))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [3, 10, 64, None])
def test_states_are_carried_over_chunks(spark, chunk):
    rng = random.Random(9)
    rows = []
    for track in (1, 2, None):
        for i in range(220):
            breaks, known = rng.random() < 0.06, rng.random() < 0.12
            rows.append((track, i // 2 * rng.choice([1, 1, 1]) if rng.random() < 0.98 else None, i, breaks, rng.randint(0, 99) if known and not breaks else None))
    frame = spark.createDataFrame(rows, "track_id int, t long, fix_idx int, b boolean, v int")
    got = chunks.with_last_known(frame, F.col("b"), F.when(F.col("v").isNotNull(), F.struct("v")), chunk)
    assert rows_of(got.select("track_id", "t", "fix_idx", F.col("_before")["v"], F.col("_after")["v"])) == brute_known(rows)
    got = chunks.with_neighbours(frame, ["fix_idx"], chunk).select("track_id", "t", "fix_idx", F.col("_before")["fix_idx"], F.col("_after")["fix_idx"])
    order, want = sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2])), []
    for k, r in enumerate(order):
        side = [order[n][2] if 0 <= n < len(order) and order[n][0] == r[0] else None for n in (k - 1, k + 1)]
        want.append((*r[:3], *side))
    assert rows_of(got) == sorted(want, key=repr)


# ---- written index


def yachts(spark):
    rows = [(1, "Blue Fin", "NOR-11", "NOR", "Swan 42", "Yard 1", "D & Co", 2001, 2024), (2, "blue-finch", "NOR11", "NOR", None, "Yard 12", None, None, None), (3, "Ébène", "12", "", "J/70", "yard one", "Deux", 1999, 2022), (4, None, None, None, None, None, None, None, 2024), (5, "Fin", "SWE 11", "SWE", "Blue 11", "Yard 1", "D", 2001, 2023)]
    return spark.createDataFrame(rows, "id int, name string, sail_no string, country string, model string, builder string, designer string, year int, certificate_year int")


def test_index_finds_fields_and_ranks_exact_ones_first(spark, tmp_path):
    from tackline.operators import index

    path = str(tmp_path / "index")
    index.build(yachts(spark), path)
    ask = lambda *a, **k: [(r["id"], r["tier"], r["total"]) for r in index.search(spark, path, *a, **k).collect()]
    assert ask("blue fin", 9) == [(1, 2, 3), (2, 2, 3), (5, 4, 3)]
    assert ask("", 9, builder="Yard-1") == [(1, 0, 3), (5, 0, 3), (2, 4, 3)]
    assert ask("", 9, sail_no="11") == [(1, 0, 3), (5, 0, 3), (2, 0, 3)]
    assert ask("11", 9) == [(1, 1, 3), (5, 1, 3), (2, 1, 3)]
    assert ask("ebene", 9) == [(3, 2, 1)] and ask("j70", 9) == [] and ask("", 9, model="j70") == [(3, 0, 1)]
    assert ask("blue", 1, 1, builder="yard") == [(2, 2, 3)]
    assert ask("", 9) == [] and ask("", 9, where=F.col("year") == 2001) == [(1, 4, 2), (5, 4, 2)] and ask("zz", 9) == []
    with pytest.raises(ValueError, match="unknown"):
        ask("a", 9, colour="b")


def test_a_search_reads_a_part_of_the_index(spark, tmp_path):
    from tackline.operators import index

    path = str(tmp_path / "index")
    index.build(yachts(spark), path)
    plan = index.candidates(spark, path, [(None, "blue"), ("builder", "y")])._jdf.queryExecution().executedPlan().toString()
    assert "(lead" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(token,blue)" in plan and "LessThan(token,bluf)" in plan


def test_second_catalogue_asks_every_field(spark):
    from tackline.operators import index

    rows = yachts(spark).withColumns({"certificate": F.concat(F.lit("A-"), F.col("id").cast("string")), "variant": F.lit("crew")})
    ask = lambda *a, **k: [(r["id"], r["total"]) for r in index.second_search(rows, *a, **k).collect()]
    assert ask("", 9) == [(4, 5), (1, 5), (5, 5), (3, 5), (2, 5)]
    assert ask("crew a", 2, 1) == [(1, 5), (5, 5)]
    assert ask("", 9, name="bluefin") == [(1, 2), (2, 2)] and ask("", 9, name="fin") == [(1, 3), (5, 3), (2, 3)]
    assert ask("", 9, designer="d", builder="yard1") == [(1, 2), (5, 2)] and ask("nor11", 9) == [(1, 2), (2, 2)]


# ---- written archives


def test_a_reading_scans_the_blocks_of_its_points(spark, tmp_path):
    from tackline.operators import archive
    from tackline.operators.weather import Axes

    axes = Axes(t0=0, dt=100, steps=40, lat0=0.0, dlat=1.0, lats=30, lon0=0.0, dlon=1.0, lons=40)
    cells = spark.range(40).toDF("step").join(spark.range(30).toDF("i")).join(spark.range(40).toDF("j"))
    cells = cells.select("step", "i", "j", *[(F.col("i") * 2.0 + F.col("j") + F.col("step") * 0.5 + k).alias(c) for k, c in enumerate(("u10", "v10", "ucur", "vcur", "hs", "period"))], F.when(F.col("i") != 3, 350.0).otherwise(10.0).alias("wave_from"))
    archive.write(cells.withColumn("vcur", F.when(F.col("j") > 2, F.col("vcur"))), str(tmp_path / "a"))
    source = archive.Source(str(tmp_path / "a"), axes)
    points = spark.createDataFrame([(1, 150, 2.5, 3.5), (2, 100, 3.0, 1.0), (3, 99_999, 1.0, 1.0), (4, 100, 1.0, 0.5)], "point_id long, t long, lat double, lon double")
    got = {r["point_id"]: r for r in archive.combined(points, source).collect()}
    assert set(got) == {1, 2, 4}
    assert math.isclose(got[1]["wind"]["u"], 5 + 3.5 + 0.75) and math.isclose(got[1]["current"]["v"], 5 + 3.5 + 0.75 + 3)
    assert got[2]["current"] is None and got[4]["wind"]["v"] == 2 + 0.5 + 0.5 + 1
    assert abs(got[1]["waves"]["wave_from"]) < 1e-9 or abs(got[1]["waves"]["wave_from"] - 360) < 1e-9
    plan = archive.pruned(spark.read.parquet(source.path), spark.createDataFrame([(1, 2, 3), (2, 3, 4)], "step int, i int, j int"))._jdf.queryExecution().executedPlan().toString()
    assert "i_block" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert archive.pruned(spark.read.parquet(source.path), spark.createDataFrame([], "step int, i int, j int")).count() == 0


def test_tiers_fall_through_regions_and_what_cannot_be_read(spark, tmp_path):
    from tackline.operators import archive
    from tackline.operators.weather import Axes

    axes = Axes(t0=0, dt=100, steps=3, lat0=0.0, dlat=1.0, lats=6, lon0=0.0, dlon=1.0, lons=6)
    base = spark.range(3).toDF("step").join(spark.range(6).toDF("i")).join(spark.range(6).toDF("j"))
    for name, value, missing in (("one", 1.0, 5), ("two", 2.0, 99)):
        archive.write(base.withColumns({"u": F.when(F.col("i") != missing, F.lit(value)), "v": F.lit(value), "tu": F.lit(0.5), "tv": F.when(F.col("j") < 4, F.lit(0.25))}), str(tmp_path / name))
    points = spark.createDataFrame([(1, 50, 1.0, 1.0), (2, 50, 5.0, 1.0), (3, 50, 1.0, 5.0), (4, 900, 1.0, 1.0)], "point_id long, t long, lat double, lon double")
    one, two, gone = (archive.Source(str(tmp_path / n), axes) for n in ("one", "two", "gone"))
    tiers = [(gone, [("u", "v")]), (archive.Source(one.path, axes, (0.0, 5.0, 0.0, 2.0)), [("u", "v")]), (two, [("u", "v"), ("tu", "tv")]), (one, [("u", "v")])]
    assert rows_of(archive.tiered(points, tiers)) == [(1, 1.0, 1.0, 1), (2, 2.5, 2.25, 2), (3, 1.0, 1.0, 3)]
    early = Axes(t0=0, dt=10, steps=3, lat0=0.0, dlat=1.0, lats=6, lon0=0.0, dlon=1.0, lons=6)
    assert rows_of(archive.switched(points, archive.Source(one.path, early), two, "u", "v")) == [(1, 2.0, 2.0, 1), (2, 2.0, 2.0, 1), (3, 2.0, 2.0, 1)]
    assert archive.switched(points, gone, gone, "u", "v").count() == 0


def test_positions_of_more_teams_and_moments_than_16_bits_count(spark, tmp_path):
    from tackline.plans import reading

    users = F.when(F.col("id") < 66_000, 3).when(F.col("id") < 66_002, 65_535).when(F.col("id") < 66_005, 65_536).otherwise(131_092)
    events = spark.range(66_010).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"), users.cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = reading.positions_binary(spark, str(tmp_path))
    assert {(r["file"], r["team"]): (r["count"], r["first"], r["last"]) for r in got.groupBy("file", "team").agg(F.count("*").alias("count"), F.min("t").alias("first"), F.max("t").alias("last")).collect()} == {
        (f"file-{u % 20}", u): (b - a, 1_700_000_000 + a, 1_699_999_999 + b) for u, a, b in ((3, 0, 66_000), (65_535, 66_000, 66_002), (65_536, 66_002, 66_005), (131_092, 66_005, 66_010))
    }
    want = V.fixes(spark, str(tmp_path)).select((F.col("track_id")).alias("team"), "t", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))
    assert rows_of(got.select("team", "t", "lat", "lon")) == rows_of(want)
