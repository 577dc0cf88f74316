"""Readers of nested and of race files, by hand-written files."""

import json

from tackline.sources import certificates


def test_each_certificate_is_read_or_says_why_not(spark):
    fine = {"RefNo": "A1", "YachtName": " Kestrel ", "Class": "C 31", "Allowances": {"WindAngles": [60, 92.5], "WindSpeeds": [7, 11], "R60": [720, 600], "R92.5": [500, 450.5], "BeatAngle": [43, 41], "Beat": [900, 800], "GybeAngle": [140, 150], "Run": [800, 700]}}

    def but(**changes):
        out = json.loads(json.dumps(fine))
        for k, v in changes.items():
            (out["Allowances"] if k in fine["Allowances"] or k.startswith("R9") else out)[k] = v
        return out

    cases = [
        (fine, None), (but(RefNo=" "), "no reference number"), (but(Allowances=[]), "no allowances"), (but(WindAngles="x"), "no list WindAngles"), (but(WindAngles=[60, "92.5"]), "not a number in WindAngles"),
        (but(WindSpeeds=[7, 61]), "out of range in WindSpeeds"), (but(WindSpeeds=[]), "WindSpeeds is empty"), (but(WindAngles=[60, 60.001]), "WindAngles is not increasing"), (but(WindAngles=[60, 95]), "no list R95"), (but(R60=[720]), "wrong length of R60"),
        (but(R60=[720, -1]), "no time allowance in R60"), (but(R60=[720, 10]), "no boat speed in R60"), (but(BeatAngle=[43, 91]), "out of range in BeatAngle"), (but(Beat=[900, None]), "no time allowance in Beat"), (but(GybeAngle=[140]), "wrong length of GybeAngle"), (but(Run=5), "no list Run"), ("text", "no reference number"), (but(YachtName=None, Class=7), None),
    ]
    docs = [("X", 2025, "﻿" + json.dumps({"rms": [c for c, _ in cases]})), ("Y", 2025, '{"rms": ['), ("Z", 2025, '{"rms": {}}'), ("W", 2025, '{"rms": []}'), ("V", 2025, None)]
    frame = certificates.read(spark.createDataFrame(docs, "country string, year int, text string"))
    rows = {(r["country"], r["place"]): r for r in frame.collect()}
    assert {k: r["problem"] for k, r in rows.items()} == {("X", k): p for k, (_, p) in enumerate(cases)} | {("Y", None): "not JSON", ("Z", None): "no list of certificates", ("V", None): "not JSON"}
    assert rows["X", 0]["name"] == "Kestrel" and rows["X", 0]["bsp"] == [[5.0, 6.0], [7.2, 7.99]] and rows["X", 1]["bsp"] is None
    cells = certificates.table_cells(frame.where("place = 0")).collect()
    assert sorted(tuple(r) for r in cells) == [("A1", 60.0, 7.0, 5.0), ("A1", 60.0, 11.0, 6.0), ("A1", 92.5, 7.0, 7.2), ("A1", 92.5, 11.0, 7.99)]
    best = certificates.optimum_points(frame.where("place = 0")).collect()
    assert sorted(tuple(r) for r in best) == [("A1", 7.0, 43.0, 4.0, True), ("A1", 7.0, 140.0, 4.5, False), ("A1", 11.0, 41.0, 4.5, True), ("A1", 11.0, 150.0, 5.14, False)]


def test_race_files_name_their_columns(spark):
    from tackline.sources import race_files

    line = lambda who, vertices, **more: {"type": "Feature", "properties": {"vesselParticipantId": who, **more}, "geometry": {"type": "LineString", "coordinates": vertices}}
    many = lambda *features: json.dumps({"type": "FeatureCollection", "features": features})
    files = [
        (1, many(line("a", [[190, 10, 0, 1_500, 6.5, 359.5], ["-20.5", "11", 0, "2999.9", -1, 360, 7]]), line("z", [["x"]]))),
        (2, json.dumps(line("a", [[1, 2, 3, 4000, 12.34, 300, 5]], detail={"SOG": 4, "sog": 6, "windSpeed": 4, "TWD": 5}))),
        (3, many(line("b", [[1, 2, 3, 4000, 201]], detail={"tws": 4}))), (4, many(line("a", [[1, 2, 3, 4000]]), line("b", [[1, 2, 3, 4000], [1, 95, 3, 4000]]))), (5, many({"type": "Feature", "properties": {"id": "b"}, "geometry": {"type": "Point", "coordinates": [1, 2]}})),
        (6, "{"), (7, '{"type": "Other"}'), (8, many(line("z", [[1, 2, 3, 4]]))), (9, many(line("a", []))), (10, None), (11, many(line("a", [[1, 2, 3, 5000, 5, 400]], detail={"twd": 5}))),
    ]
    who = spark.createDataFrame([("a",), ("b",), ("a",)], "participant string")
    got = sorted((tuple(r) for r in race_files.read_race(spark.createDataFrame(files, "file int, text string"), who).collect()), key=repr)
    none = (None,) * 8
    assert got == sorted([
        (1, "a", 0, 1, 10.0, -170.0, 359.5, 6.5, None, None, None), (1, "a", 1, 2, 11.0, -20.5, None, None, None, None, None), (2, "a", 0, 4, 2.0, 1.0, None, 5.0, 12.34, 300.0, None),
        (3, None, *none, "wind speed out of range"), (4, None, *none, "no place and time"), (5, None, *none, "no line"), (6, None, *none, "not JSON"), (7, None, *none, "no features"), (10, None, *none, "not JSON"), (11, None, *none, "wind direction out of range"),
    ], key=repr)


def test_a_race_is_put_together(spark):
    from tackline.operators import races

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    boats = frame([(1, 10), (2, 11), (3, None), (4, 12)], "boat_id int, class_id int")
    fixes = frame([(1, 100), (1, 180), (2, 150), (9, 999)], "boat_id int, t int")
    reports = frame([(1, 1, 50, "RAC"), (1, 2, 60, "RET"), (2, 3, 70, "ABD"), (3, 4, 80, "RAC"), (3, 5, 85, None), (4, 6, 90, "???")], "boat_id int, seq int, t int, code string")
    classes, runs = frame([(10, "Fast", 1), (11, "", 2), (12, "Slow", None)], "class_id int, name string, run_id int"), frame([(1, 7), (2, None)], "run_id int, start int")
    arrivals, hidden = frame([(2, 140)], "boat_id int, t int"), frame([(2, 141), (4, 130)], "boat_id int, t int")
    got = sorted(tuple(r) for r in races.assembled(boats, fixes, reports, classes, runs, arrivals, hidden, 5).collect())
    assert got == [(1, "Fast", "RETIRED", 7, 180, 2), (2, None, "FINISHED", 5, 140, 1), (3, None, None, 5, 180, 0), (4, "Slow", "???", 5, 130, 0)]
    none = fixes.where("false")
    assert {r["finish"] for r in races.assembled(boats, none, reports, classes, runs, none, none, None).collect()} == {90}
    assert races.assembled(boats.where("false"), fixes, reports, classes, runs, arrivals, hidden, 5).count() == 0


def test_kml_tracks_pair_times_and_places(spark):
    from tackline.sources import race_files

    mark = lambda name, whens, coords: f"<Placemark id='x'><name>{name}</name><gx:Track><altitudeMode>m</altitudeMode>{''.join(f'<when>{w}</when>' for w in whens)}{''.join(f'<gx:coord>{c}</gx:coord>' for c in coords)}</gx:Track></Placemark>"
    kml = lambda *marks: f'<?xml version="1.0"?><kml xmlns:gx="g"><Folder><name>All</name>{"".join(marks)}</Folder></kml>'
    files = [
        (1, kml(mark(" A &lt;1&gt; &amp;amp; ", ["1970-01-01T00:01:40Z", "1970-01-01T00:03:20+00:00"], ["12.3456789,45.1,7", " 200 , -10.000004"]), mark("", ["1970-01-01T00:00:01Z"], ["1,2"]))),
        (2, kml(mark("A", ["1970-01-01T00:00:01Z"], ["1,2", "3,4"]))), (3, kml(mark("A", ["1970-01-01T00:00:01Z"], ["1,2"]), mark("B", ["later"], ["1,2"]))), (4, kml(mark("A", ["1970-01-01T00:00:01Z"], ["1,95"]))),
        (5, "<kml><Placemark>"), (6, None), (7, kml()), (8, kml(mark("A", [], []))),
    ]
    got = sorted((tuple(r) for r in race_files.read_kml(spark.createDataFrame(files, "file int, text string")).collect()), key=repr)
    none = (None,) * 6
    assert got == sorted([
        (1, 0, "A <1> &amp;", 0, 100, 45.1, 12.34568, None), (1, 0, "A <1> &amp;", 1, 200, -10.0, -160.0, None), (1, 1, "", 0, 1, 2.0, 1.0, None),
        (2, *none, "times and places differ in number"), (3, *none, "no time"), (4, *none, "no place"), (5, *none, "not XML"), (6, *none, "not XML"),
    ], key=repr)


def test_a_list_of_certificates_in_several_documents_is_read_once(spark):
    from tackline.sources import certificates as reader

    one = '{"RefNo":"%s","Allowances":{"WindAngles":[90],"WindSpeeds":[6],"R90":[600],"BeatAngle":[44.5],"Beat":[720],"GybeAngle":[140],"Run":[900]}}'
    texts = [("A", 2025, 0, '{"rms":[%s,%s]}' % (one % "a", one % "")), ("A", 2025, 2, '{"rms":[%s]}' % (one % "b"))]
    got = reader.read(spark.createDataFrame(texts, "country string, year int, first int, text string"))
    assert sorted((r["place"], r["ref_no"], r["problem"]) for r in got.collect()) == [(0, "a", None), (1, None, "no reference number"), (2, "b", None)]
    best = reader.optimum_points(got)
    assert best.columns == ["ref_no", "tws", "twa", "vmg", "upwind"]
    assert sorted(tuple(r) for r in best.collect()) == [(n, 6.0, a, v, u) for n in "ab" for a, v, u in ((44.5, 5.0, True), (140.0, 4.0, False))]
    # good certificates once; the other branch holds documents without a list
    assert best._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
