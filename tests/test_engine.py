"""Hand-worked cases of single operators."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from tackline.functions import sailing
from tackline.functions.canonical import angle_between, rounded, wrap_360, wrap_lon
from tackline.functions.geo import distance_m, final_bearing, initial_bearing, mean_direction
from tackline.functions.text import compact, fold, maker, model_key
from tackline.operators import blend, catalogue, compare, export, filters, polar, tracks, weather
from tackline.sources import polar_files, times, track_files
from tackline.streaming import fixes as live


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_rounding_and_angles(spark):
    got = one(spark, a=rounded(F.lit(2.5), 0), b=rounded(F.lit(-2.5), 0), c=rounded(F.lit(-1e-9), 6), d=rounded(F.lit(3e15), 6), e=wrap_360(F.lit(-10.0)), f=wrap_360(F.lit(360.0)), g=wrap_lon(F.lit(180.0)), h=angle_between(350.0, 10.0), i=wrap_360(F.lit(None).cast("double")))
    assert tuple(got) == (3.0, -3.0, 0.0, 3e15, 350.0, 0.0, -180.0, 20.0, None)


def test_geodesy(spark):
    got = one(spark, d=distance_m(0.0, 0.0, 0.0, 1.0), n=initial_bearing(0.0, 0.0, 1.0, 0.0), f=final_bearing(0.0, 179.5, 0.0, -179.5), s=initial_bearing(1.0, 1.0, 1.0, 1.0), m=mean_direction(350.0, 10.0), o=mean_direction(0.0, 180.0))
    assert abs(got["d"] - 6_371_229 * 3.141592653589793 / 180) < 1e-6
    assert (round(got["n"], 9), round(got["f"], 9), got["s"], got["o"]) == (0.0, 90.0, None, None)
    assert min(got["m"], 360 - got["m"]) < 1e-9


def test_apparent_wind_and_current(spark):
    base = spark.createDataFrame([(0.0, 6.0, 6.0, 90.0, None, None), (0.0, 6.0, 6.0, 90.0, 2.0, 0.0)], "heading double, speed double, tws double, twd_from double, current_speed double, current_toward double")
    rows = sailing.relate(base.withColumns({"sup_tws": F.lit(None).cast("double"), "sup_twd": F.lit(None).cast("double"), "wave_from": F.lit(30.0)}))
    a, b = rows.select("twa", "tack", "bsp_corrected", "wave_angle", sailing.apparent_wind_angle(True).alias("awa")).collect()
    assert (a["twa"], a["tack"], a["bsp_corrected"], a["wave_angle"], a["awa"]) == (90.0, "starboard", None, 30.0, 45.0)
    assert b["bsp_corrected"] == 4.0 and b["awa"] == 45.0
    # 5 and 12 give 13 m/s, 25.27 kn, that blows from the south-west quarter; -2 m/s east is 3.89 kn toward the west
    knots, direction = sailing.from_components(5.0, 12.0, "from")
    c, d = sailing.from_components(-2.0, 0.0, "toward")
    assert tuple(one(spark, a=knots, b=direction, c=c, d=d)) == (25.27, 202.6, 3.89, 270.0)


def test_supplied_wind_is_a_pair(spark):
    rows = spark.createDataFrame([(5.0, None, 9.0, 90.0), (5.0, 45.0, 9.0, 90.0)], "sup_tws double, sup_twd double, tws double, twd_from double")
    speed, direction = sailing.effective_wind()
    assert [tuple(r) for r in rows.select(speed, direction).collect()] == [(9.0, 90.0), (5.0, 45.0)]


def test_change_filter_marks_both_neighbours(spark):
    rows = [(1, k, t, h) for k, (t, h) in enumerate([(0, 200.0), (60, 203.0), (120, 221.0), (180, 218.0), (240, 358.0), (300, 2.0), (50_000, 90.0)])]
    s = spark.createDataFrame(rows, "track_id int, fix_idx int, t long, heading double").withColumns({c: F.lit(None).cast("double") for c in ("heading_corrected", "speed", "twa", "twa_corrected", "tws_corrected", "bsp_corrected", "wind_speed")})

    def out(limit):
        return [r["filtered"] for r in filters.mark(s, filters.SampleFilters(min_bsp_kn=None, max_heading_change_deg=limit), True, 10_800).orderBy("fix_idx").collect()]

    assert out(145.0) == [False] * 7
    assert out(17.5) == [False, True, True, True, True, False, False]
    assert out(3.5) == [False, True, True, True, True, True, False]
    with pytest.raises(ValueError):
        filters.SampleFilters(min_bsp_kn=-1.0)


def test_filters_fail_missing_values(spark):
    s = spark.createDataFrame([(None,), (5.0,)], "x double")
    assert [r[0] for r in s.select(~filters.in_range(F.col("x"), (1.0, 9.0))).collect()] == [True, False]


def test_motion_at_the_ends_and_across_gaps(spark):
    rows = [(1, k, t, 0.0, x, None, None, None, None) for k, (t, x) in enumerate([(0, 0.0), (3600, 0.1), (7200, 0.2), (90_000, 0.3)])]
    f = spark.createDataFrame(rows, "track_id int, fix_idx int, t long, lat double, lon double, cog double, sog double, tws double, twd_from double")
    got = tracks.derive(f, 10_800).orderBy("t").collect()
    assert [r["heading"] and round(r["heading"], 6) for r in got] == [90.0, 90.0, 90.0, None]
    assert [r["speed_origin"] for r in got] == ["derived"] * 3 + [None]
    assert abs(got[0]["speed"] - got[1]["speed"]) < 1e-9


def cells(spark, rows, source=0):
    return spark.createDataFrame([(source, *map(float, r[:2]), None if r[2] is None else float(r[2])) for r in rows], "source_id int, twa double, tws double, bsp double")


def read(frame, twa, tws, **more):
    return {(twa[r["i"]], tws[r["j"]]): round(r["bsp"], 9) for r in polar.resample(frame, twa, tws, **more).collect()}


def test_bilinear_reads_and_never_extrapolates(spark):
    # a plane: a twentieth of a knot a degree and a quarter of one a knot of wind, which reading between nodes keeps
    plane = lambda a, s: a / 20 + s / 4
    grid = cells(spark, [(a, s, plane(a, s)) for a in (50, 70, 110, 170) for s in (8, 16)])
    got = read(grid, [44.0, 58.0, 96.0, 250.0, 172.0], [10.0, 16.0, 17.0])
    assert got == {(a, s): round(plane(min(a, 360 - a), s), 9) for a in (58.0, 96.0, 250.0) for s in (10.0, 16.0)}
    ragged = cells(spark, [(50, 16, 7), (64, 8, 5), (110, 8, 8), (110, 16, 10)])
    assert (55.0, 8.0) not in read(ragged, [55.0, 80.0], [8.0, 16.0])
    gone = spark.createDataFrame([(0, 50.0, 8.0)], "source_id int, twa double, tws double")
    assert set(read(grid, [58.0, 96.0], [10.0, 16.0], excluded=gone)) == {(58.0, 16.0), (96.0, 10.0), (96.0, 16.0)}


def test_resampling_on_its_own_axes_changes_nothing(spark):
    rows = [(a, s, a / 20 + s / 7) for a in (40, 60, 90, 140) for s in (6, 10, 16)]
    got = read(cells(spark, rows), [40.0, 60.0, 90.0, 140.0], [6.0, 10.0, 16.0])
    assert got == {(float(a), float(s)): round(v, 9) for a, s, v in rows}


def test_pchip_keeps_shape(spark):
    # a straight line stays one, a flat stretch stays flat, steps never overshoot, and nothing is read outside
    line = polar.pchip(cells(spark, [(40, 9, 4), (60, 9, 5), (100, 9, 7)]), [45.0, 85.0, 39.0, 101.0]).collect()
    assert {r["i"]: round(r["bsp"], 6) for r in line} == {0: 4.25, 1: 6.25}
    at = [float(x) for x in range(30, 121, 5)]
    step = {at[r["i"]]: r["bsp"] for r in polar.pchip(cells(spark, [(30, 9, 3), (60, 9, 3), (90, 9, 8), (120, 9, 8)]), at).collect()}
    assert all(step[a] == 3.0 for a in at if a <= 60) and all(step[a] == 8.0 for a in at if a >= 90) and step[75.0] == 5.5
    assert all(step[a] <= step[b] for a, b in zip(at, at[1:], strict=False))


def test_directional(spark):
    half = polar.directional(cells(spark, [(52, 14, 6), (120, 14, 9), (240, 14, 7), (308, 14, 6.5)]), False)
    assert {(r["twa"], r["bsp"]) for r in half.collect()} == {(52.0, 6.25), (120.0, 8.0)}
    full = polar.directional(cells(spark, [(70, 14, 7.5), (180, 14, 6)]), True)
    assert {(r["twa"], r["bsp"]) for r in full.collect()} == {(70.0, 7.5), (290.0, 7.5), (180.0, 6.0)}


def test_bins_take_halfway_up(spark):
    axis = [40.0, 52.0, 60.0]
    x = [33.9, 34.0, 46.0, 45.999, 56.0, 64.0, 64.1]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(polar.bin_index("x", axis)).collect()
    assert [r[0] for r in got] == [None, 0, 1, 0, 2, 2, None]


def test_statistics(spark):
    # ranks of five values: 0.9 * 4 = 3.6, 0.75 * 4 = 3
    p = spark.createDataFrame([(90.0, 10.0, float(v)) for v in (3, 5, 6, 9, 10)], "twa double, tws double, bsp double")
    got = {s: polar.segment(p, [80.0, 90.0, 100.0], [10.0], s, 1).first() for s in ("p90", "median", "mean", "p75")}
    assert [got[s]["bsp"] for s in ("p90", "median", "mean", "p75")] == [9.6, 6.0, 6.6, 9.0]
    assert round(got["p90"]["spread"], 4) == round((33.2 / 4) ** 0.5, 4)
    assert polar.segment(p, [80.0, 90.0, 100.0], [10.0], "p90", 6).first()["bsp"] is None


def test_one_source_blends_to_itself_and_fills_between(spark):
    twa, tws = [0.0, 40.0, 60.0, 90.0, 120.0], [6.0, 10.0]
    ev = spark.createDataFrame([(1, 1, 0, 4.0, 0.5), (1, 3, 0, 7.0, 0.5), (1, 1, 1, 6.0, 0.5), (1, 2, 1, 6.5, 0.0)], "source_id int, i int, j int, bsp double, weight double")
    got = {(r["i"], r["j"]): (r["bsp"], r["origin"]) for r in blend.blend(ev, twa, tws).collect()}
    assert got[(1, 0)] == (4.0, "direct") and got[(2, 0)] == (5.2, "filled") and got[(0, 0)] == (0.0, "filled") and got[(2, 1)] == (None, "empty") and got[(4, 0)] == (None, "empty")
    assert blend.coverage(blend.blend(ev, twa, tws)).first().asDict() == {"direct": 3, "filled": 1, "empty": 4}


def test_a_full_circle_never_mirrors_or_anchors_on_the_zero_row(spark):
    b = cells(spark, [(0, 14, 0), (60, 14, 5), (120, 14, 8), (200, 14, 7), (360, 14, 0)])
    got = [r["bsp"] for r in blend.resampled(b, [0.0, 35.0, 84.0, 160.0, 250.0, 360.0], [14.0]).orderBy("i").collect()]
    assert got == [0.0, None, 6.2, 7.5, None, 0.0]


def test_comparing_with_itself_is_zero(spark):
    axes = polar.grid(spark, [0.0, 45.0, 90.0], [8.0, 12.0])
    a = spark.createDataFrame([(1, 0, 6.0), (2, 0, 0.05), (2, 1, 7.0)], "i int, j int, bsp double")
    c = compare.cells(a, a, axes)
    s = compare.stats(c).first()
    assert (s["both"], s["pct_excluded"], s["max_abs_kn"], s["zero_row"]) == (3, 1, 0.0, 2) and compare.regions(c).count() == 0


def test_stencil_leaves_missing_corners_out(spark):
    axes = weather.Axes(0, 3600, 3, 0.0, 1.0, 3, 0.0, 1.0, 3)
    arc = [(s, i, j, "u", None if (i, j) == (0, 0) else float(10 * s + i + j)) for s in range(3) for i in range(3) for j in range(3) if s != 2]
    arc = spark.createDataFrame(arc, "step long, i long, j long, var string, value double")
    pts = spark.createDataFrame([(1, 0, 0.5, 0.5), (2, 1800, 1.0, 1.0), (3, 5000, 1.0, 1.0), (4, 6000, 1.0, 1.0), (5, 0, 0.0, 0.0), (6, 0, 9.0, 0.0)], "point_id long, t long, lat double, lon double")
    got = {r["point_id"]: round(r["value"], 9) for r in weather.sample(pts, arc, axes).collect()}
    assert got == {1: round(4 / 3, 9), 2: 7.0, 3: 12.0}


def test_reports_go_to_the_nearest_fix(spark):
    f = spark.createDataFrame([(1, 0), (1, 100), (1, 200)], "track_id int, t long")
    r = spark.createDataFrame([(1, 50, 7), (1, 60, 8), (1, 199, 9), (1, 201, 10), (1, 400, 11)], "track_id int, t long, report_id long")
    assert sorted((x["t"], x["report_id"], x["gap"]) for x in weather.match_reports(f, r).collect()) == [(0, 7, 50), (100, 8, 40), (200, 9, 1)]


def test_names(spark):
    rows = spark.createDataFrame([("Señal ÉTÉ",), ("BLÅ ØYE",), ("Großer Ægir",), ("Čárka",)], "x string").select(fold("x"), compact("x")).collect()
    assert [r[0] for r in rows] == ["senal ete", "bla oye", "grosser aegir", "carka"]
    got = spark.createDataFrame([("Jeanneau Sun Odyssey 36.2",), ("Class40",), ("A/35",), ("Optimist",), ("Bavaria",), ("Zephyr",)], "x string").select(model_key("x")).collect()
    assert [r[0] for r in got] == ["sunodyssey36.2", None, "a35", "optimist", None, None]
    assert one(spark, a=maker(F.lit("Nautor Swan")), b=maker(F.lit("Elan Yachts")))["a"] == "nautor"


def test_searches_fold_the_query_and_find_nothing_for_none(spark):
    rows = [(1, "Señal Été", "ESP 12", "ESP", "First 40", 2001, 2024), (2, "Senales", "FRA12", "FRA", None, None, None), (3, "Blå Øye", "NOR 7", "NOR", "J/109", 2010, 2023)]
    entries = spark.createDataFrame(rows, "id long, name string, sail_no string, country string, model string, year int, certificate_year int")
    found = lambda q, **more: [(r["id"], r["tier"], r["total"]) for r in catalogue.search(entries, q, 10, **more).collect()]
    assert found("SEÑAL") == found("senal") == [(1, 2, 2), (2, 2, 2)]
    assert found("senal", offset=1) == [(2, 2, 2)]
    assert found("øye blå") == [(3, 4, 1)] and found("12") == [(1, 1, 2), (2, 1, 2)] and found("j 109") == [(3, 3, 1)]
    assert found("") == found(" -!") == []
    tracks_ = entries.select(F.col("id").alias("track_id"), F.col("name").alias("boat"), F.lit("Régate").alias("event"), F.lit(1).alias("start"))
    assert [r["track_id"] for r in catalogue.library_search(tracks_, "été régate", 5).collect()] == [1]
    assert catalogue.library_search(tracks_, "", 5).count() == 0


def test_times(spark):
    cases = [("2025-07-26T12:00:00Z", "auto", 1753531200), ("2025/7/26 14:00+02:00", "auto", 1753531200), ("2025-07-26", "auto", 1753488000), ("1753531200", "auto", 1753531200), ("1753531200499", "auto", 1753531200), ("2025-07-26 24:00:00", "iso", 1753574400), ("2025-13-01", "auto", None), ("", "auto", None), ("26.Jul.25 12h", "%d.%b.%y %Hh", 1753531200), ("x", "epoch_s", None)]
    for text, how, want in cases:
        assert one(spark, t=times.seconds(F.lit(text), how))["t"] == want, text
    with pytest.raises(ValueError):
        times.check_format("%H:%M")


def test_csv_and_geojson(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Time,Latitude,Longitude,COG,SOG (km/h),TWS (m/s),TWD,Boat\n2025-07-26T12:00:00Z,50,-200,370,18.52,10,-10,"A ""x"""\nbad,50,1,,,,,\n')
    got = track_files.read_csv(spark, str(tmp_path / "a.csv")).orderBy("boat").collect()
    bad, good = got
    assert (good["t"], good["boat"], round(good["sog"], 9), good["cog"], good["twd_from"], good["problem"]) == (1753531200, 'A "x"', 10.0, None, 350.0, "bad-position")
    assert bad["problem"] == "bad-time"
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"time":0,"TWS":12,"TWD":350,"Boat":" B "},"geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","properties":{"times":[0,60],"sog":[5,6],"cog":90},"geometry":{"type":"LineString","coordinates":[[1,2],[1.5,2.5]]}},{"type":"Feature","properties":{"times":[0]},"geometry":{"type":"LineString","coordinates":[[1,2],[1,3]]}},{"type":"Feature","properties":{},"geometry":null}]}'
    rows = track_files.read_geojson(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("feature", "at").collect()
    assert [(r["t"], r["lat"], r["lon"], r["sog"], r["cog"], r["tws"], r["boat"], r["problem"]) for r in rows] == [(0, 2.0, 1.0, None, None, 12.0, "B", None), (0, 2.0, 1.0, 5.0, 90.0, None, None, None), (60, 2.5, 1.5, 6.0, 90.0, None, None, None), (None, None, None, None, None, None, None, "times-mismatch")]


def test_binary_positions_add_up_deltas(spark):
    data = struct.pack(">BI", 0, 1000) + struct.pack(">HH", 7, 3) + struct.pack(">Iii", 500, 5_000_000, -100_000) + struct.pack(">Hhh", 0x8000 | 60, 10, -20) + struct.pack(">Hhh", 0x8000 | 40, 5, 5)
    files = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    got = track_files.resolved(track_files.binary_moments(files)).orderBy("t").collect()
    assert [(r["t"], r["lat"], r["lon"]) for r in got] == [(1400, 50.00015, -1.00015), (1440, 50.0001, -1.0002), (1500, 50.0, -1.0)]


def test_polar_files_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("! note\npol Twa0 Bsp0\n8 45 6 90 7.5\n6\t40  5   90 6.5\n")
    (tmp_path / "b.csv").write_bytes("﻿TWA\\TWS;6;8\r\n40;5,5;\r\n90;6;7\r\n".encode())
    (tmp_path / "c.txt").write_text("hello there\n")
    (tmp_path / "d.txt").write_text("8 45 6 90\n")
    got, problems = polar_files.read_polars(spark, str(tmp_path / "*"))
    by = {(r["path"][-5], r["twa"], r["tws"]): r["bsp"] for r in got.collect()}
    assert by == {("a", 45.0, 8.0): 6.0, ("a", 90.0, 8.0): 7.5, ("a", 40.0, 6.0): 5.0, ("a", 90.0, 6.0): 6.5, ("b", 40.0, 6.0): 5.5, ("b", 90.0, 6.0): 6.0, ("b", 90.0, 8.0): 7.0}
    assert {(r["path"][-5], r["problem"]) for r in problems.collect()} == {("c", "unknown-format"), ("d", "missing-bsp")}
    lines = export.expedition_lines(got.where("path like '%a.txt'"), ["path"]).orderBy("tws").collect()
    assert [r["line"] for r in lines] == ["6\t40\t5.00\t90\t6.50", "8\t45\t6.00\t90\t7.50"]
    assert export.table_header([6.0, 8.5]) == "TWA\\TWS;6;8.5"


def test_sessions_of_a_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1, t0 + datetime.timedelta(hours=h)) for h in (0, 1, 2, 9, 10, 40)]
    spark.createDataFrame(rows, "track_id int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("track_id int, ts timestamp").parquet(str(tmp_path / "in"))
    q = live.sessions(stream).writeStream.outputMode("append").format("memory").queryName("live_sessions").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["fixes"] for r in spark.sql("select * from live_sessions").collect()) == [2, 3]
