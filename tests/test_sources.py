"""Sources on small hand-made files."""

import gzip
import json
import struct
import zipfile

import pytest

from roadweave.operators.relational import first_and_latest
from roadweave.sources import binary_feeds, ingest, json_feeds, xml_feeds

NS = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns="http://d"'


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode() if isinstance(text, str) else text)
    return str(p)


def test_sites(spark, tmp_path):
    text = f"""<d {NS}><measurementSiteRecord id="GEO01_1" version="3"><measurementSiteName><values><value lang="nl">009hrl057760</value></values></measurementSiteName><measurementSiteNumberOfLanes>2</measurementSiteNumberOfLanes>
    <measurementSpecificCharacteristics index="1"><measurementSpecificCharacteristics><specificLane>lane2</specificLane><period>60</period><specificMeasurementValueType>trafficSpeed</specificMeasurementValueType>
    <specificVehicleCharacteristics><lengthCharacteristic><comparisonOperator>greaterThan</comparisonOperator><vehicleLength>5.6</vehicleLength></lengthCharacteristic></specificVehicleCharacteristics></measurementSpecificCharacteristics></measurementSpecificCharacteristics>
    <measurementSiteLocation><pointByCoordinates><pointCoordinates><latitude>52.1</latitude><longitude>4.7</longitude></pointCoordinates></pointByCoordinates><alertCDirection><alertCDirectionCoded>positive</alertCDirectionCoded></alertCDirection>
    <alertCMethod4PrimaryPointLocation><alertCLocation><specificLocation>123</specificLocation></alertCLocation></alertCMethod4PrimaryPointLocation><openlrBearing>90</openlrBearing></measurementSiteLocation></measurementSiteRecord></d>"""
    sites, chars = xml_feeds.measurement_sites(spark, put(tmp_path, "s.xml.gz", text))
    s, c = sites.first(), chars.first()
    assert (s.id, s.road, s.carriageway, s.km, s.num_lanes, s.version, s.openlr_bearing, s.tmc_primary, s.tmc_secondary, s.tmc_direction, tuple(s.geom)) == ("GEO01_1", "A9", "L", 57.76, 2, 3, 90, 123, None, "positive", (4.7, 52.1))
    assert tuple(c) == ("GEO01_1", 1, 2, 60, "TrafficSpeed", 5.6, None)


def test_speed_and_time(spark, tmp_path):
    value = lambda i, body: f'<measuredValue index="{i}"><measuredValue>{body}</measuredValue></measuredValue>'
    speed = lambda v, a="": f'<basicData xsi:type="TrafficSpeed"><averageVehicleSpeed {a}><speed>{v}</speed></averageVehicleSpeed></basicData>'
    text = f"""<d {NS}><siteMeasurements><measurementSiteReference id="S"/><measurementTimeDefault>2024-01-01T00:00:00Z</measurementTimeDefault>
    {value(1, speed(80, 'numberOfInputValuesUsed="3" standardDeviation="1.5"'))}{value(2, speed(-1))}{value(3, speed(90, 'numberOfInputValuesUsed="0"'))}{value(4, speed(70))}
    {value(5, '<basicData xsi:type="TrafficFlow"><vehicleFlow><vehicleFlowRate>120</vehicleFlowRate></vehicleFlow></basicData>')}
    {value(6, '<basicData xsi:type="TravelTimeData"><travelTimeType>best</travelTimeType><travelTime accuracy="90"><duration>33.5</duration></travelTime></basicData><measuredValueExtension><x><basicDataReferenceValue><travelTimeData><travelTime><duration>30</duration></travelTime></travelTimeData></basicDataReferenceValue></x></measuredValueExtension>')}
    </siteMeasurements></d>"""
    path = put(tmp_path, "v.xml", text)
    got = {r["index"]: (r.speed_kmh, r.n_inputs, r.std_dev, r.flow_veh_h) for r in xml_feeds.traffic_speed(spark, path).collect()}
    assert {k: got[k] for k in range(1, 6)} == {1: (80.0, 3, 1.5, None), 2: (None, 1, None, None), 3: (None, 0, None, None), 4: (70.0, 1, None, None), 5: (None, None, None, 120.0)}
    t = xml_feeds.travel_time(spark, path).first()
    assert (t["index"], t.travel_time_type, t.duration_s, t.ref_duration_s, t.accuracy) == (6, "best", 33.5, 30.0, 90.0)


def test_situations(spark, tmp_path):
    text = """<d xmlns:sit="s" xmlns:loc="l" xmlns:com="c" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><sit:situation id="S1"><sit:overallSeverity>high</sit:overallSeverity>
    <sit:situationRecord id="R1" xsi:type="sit:SpeedManagement"><sit:safetyRelatedMessage>true</sit:safetyRelatedMessage><sit:source><com:sourceName><com:values><com:value>RWS</com:value></com:values></com:sourceName></sit:source><sit:validity><com:validityTimeSpecification><com:overallStartTime>2024-01-01T00:00:00Z</com:overallStartTime></com:validityTimeSpecification></sit:validity>
    <sit:locationReference xsi:type="loc:PointLocation"><loc:latitude>52.1</loc:latitude><loc:longitude>4.7</loc:longitude></sit:locationReference><sit:temporarySpeedLimit>70.0</sit:temporarySpeedLimit></sit:situationRecord>
    <sit:situationRecord id="R2" xsi:type="sit:Accident"><sit:locationReference><loc:posList>52.1 4.7 52.2 4.8</loc:posList></sit:locationReference></sit:situationRecord></sit:situation></d>"""
    a, b = xml_feeds.situations(spark, put(tmp_path, "t.xml", text), "incident").orderBy("record_id").collect()
    assert (a.id, a.severity, a.record_type, a.safety_related, a.source, a.speed_limit_kmh, tuple(a.point), a.line) == ("S1", "high", "SpeedManagement", True, "RWS", 70, (4.7, 52.1), None)
    assert a.valid_from is not None and (b.record_type, b.speed_limit_kmh, b.point, [tuple(p) for p in b.line]) == ("Accident", None, None, [(4.7, 52.1), (4.8, 52.2)])


def test_panels_parking_zones(spark, tmp_path):
    text = """<d xmlns:v="v" xmlns:c="c"><v:vmsController id="C"><v:vms vmsIndex="1"><v:vms><v:description><c:values><c:value>A10 zuid</c:value></c:values></v:description><v:vmsLocation><v:bearing>45</v:bearing><v:latitude>52.1</v:latitude><v:longitude>4.7</v:longitude></v:vmsLocation></v:vms></v:vms></v:vmsController>
    <v:vmsControllerStatus><v:vmsControllerReference id="C"/><v:statusUpdateTime>2024-01-01T00:00:00Z</v:statusUpdateTime><v:vmsStatus vmsIndex="1"><v:vmsStatus><v:workingStatus>working</v:workingStatus><v:vmsMessage><v:vmsMessage><v:textLine>FILE</v:textLine><v:textLine> 2 km </v:textLine></v:vmsMessage></v:vmsMessage></v:vmsStatus></v:vmsStatus></v:vmsControllerStatus></d>"""
    p = xml_feeds.panels(spark, put(tmp_path, "p.xml", text)).first()
    assert (p.controller_id, p.vms_index, p.description, p.bearing, p.working_status, p.display_text, p.status_update_time) == ("C", 1, "A10 zuid", 45, "working", "FILE\n2 km", "2024-01-01T00:00:00Z")
    text = '<d><parkingRecordStatus><parkingRecordReference id="P"/><parkingStatusOriginTime>2024-01-01T00:00:00Z</parkingStatusOriginTime><parkingOccupancy><parkingNumberOfVacantSpaces>5</parkingNumberOfVacantSpaces><parkingOccupancy>50.5</parkingOccupancy></parkingOccupancy></parkingRecordStatus></d>'
    s = xml_feeds.parking_status(spark, put(tmp_path, "k.xml", text)).first()
    assert (s.parking_id, s.vacant, s.occupied, s.occupancy_pct) == ("P", 5, None, 50.5)
    text = '<d><parkingRecord id="P"><parkingName><values><value>Rest</value></values></parkingName><operator><x><name>Op</name></x></operator><parkingNumberOfSpaces>40</parkingNumberOfSpaces><parkingLocation><latitude>52</latitude><longitude>5</longitude></parkingLocation></parkingRecord></d>'
    k = xml_feeds.truck_parking(spark, put(tmp_path, "r.xml", text)).first()
    assert (k.id, k.name, k.operator, k.capacity, tuple(k.geom)) == ("P", "Rest", "Op", 40, (5.0, 52.0))
    text = '<d><urbanVehicleAccessRegulation id="Z"><name><values><value>Zone</value></values></name><status>active</status><trafficRegulationOrder><issuingAuthority><values><value>City</value></values></issuingAuthority><posList>52 4 52 5 53 5 52 4</posList></trafficRegulationOrder></urbanVehicleAccessRegulation></d>'
    z = xml_feeds.emission_zones(spark, put(tmp_path, "z.xml", text)).first()
    assert (z.id, z.name, z.status, z.authority, len(z.polygon)) == ("Z", "Zone", "active", "City", 4)


def test_matrix_signs(spark, tmp_path):
    event = lambda u, body: f"<event><sign_id><uuid>{u}</uuid></sign_id>{body}</event>"
    where = lambda lane: f"<lanelocation><road>A9</road><carriageway>R</carriageway><lane>{lane}</lane><km>12.3</km></lanelocation>"
    text = "<d>" + event("u", where(1)) + event("u", where(2)) + event("u", '<ts_state>2024-01-01T00:00:02Z</ts_state><display><blank/><speedlimit flashing="true">70</speedlimit></display>') + event("u", "<ts_state>2024-01-01T00:00:01Z</ts_state><display><lane_open/></display>") + event("v", "<ts_state>2024-01-01T00:00:01Z</ts_state><display><lane_closed/></display>") + "</d>"
    got = {r.uuid: r for r in first_and_latest(*xml_feeds.matrix_events(spark, put(tmp_path, "m.xml", text))).collect()}
    assert (got["u"].lane, got["u"].km, got["u"].aspect_type, got["u"].value, got["u"].flashing, got["u"].red_ring) == (1, 12.3, "speedlimit", "70", True, False)
    assert (got["v"].lane, got["v"].aspect_type) == (None, "lane_closed")


def test_json_and_csv(spark, tmp_path):
    item = {"id": 7, "road": "A9", "polyline": "_p~iF~ps|U_ulLnnqC", "fromLoc": {"lat": 52.0, "lon": 4.0}, "toLoc": {"lat": 52.1, "lon": 4.1}, "start": "2024-01-01T00:00:00Z"}
    feed = {"success": True, "dateTime": "2024-01-01T00:00:00Z", "roads": [{"segments": [{"jams": [item, {"id": "x"}], "radars": [{"id": 8, "loc": {"lat": 52.0, "lon": 5.0}}]}]}]}
    got = {r.record_id: r for r in json_feeds.incidents(spark, put(tmp_path, "i.json", json.dumps(feed))).collect()}
    assert set(got) == {"jams:7", "radars:8"} and [tuple(p) for p in got["jams:7"].line] == [(4.0, 52.0), (4.1, 52.1)] and tuple(got["radars:8"].point) == (5.0, 52.0)
    with pytest.raises(Exception, match="no success"):
        json_feeds.incidents(spark, put(tmp_path, "j.json", json.dumps({"success": False, "roads": []}))).collect()
    assert json_feeds.incidents(spark, put(tmp_path, "e.json", json.dumps({"success": True, "roads": []}))).collect() == []
    cams = [{"id": "5", "land": "NL", "status": "A", "lat": "52", "lng": "5", "vmax": "80", "richtung": "370"}, {"id": "6", "land": "BE", "status": "A", "lat": "51", "lng": "4"}, {"id": "7", "land": "NL", "status": "A", "lat": "80", "lng": "5"}]
    c = json_feeds.speed_cameras(spark, put(tmp_path, "c.json", json.dumps({"result": cams}))).collect()
    assert [(r.id, r.speed_limit_kmh, r.bearing_deg) for r in c] == [(5, 80, None)]
    geo = {"features": [{"id": "cp", "geometry": {"coordinates": [4.7, 52.1]}, "properties": {"city": "X", "availabilities": [{"total": 2, "available": 1}, {"total": 1, "available": None, "tariff_ids": ["t"]}]}}]}
    points, rows = json_feeds.charging(spark, put(tmp_path, "g.json", json.dumps(geo)))
    assert points.first().lon == 4.7 and [(r.cp_id, r.idx, r.available) for r in rows.orderBy("idx").collect()] == [("cp", 0, 1), ("cp", 1, None)]
    assert json_feeds.tariffs(spark, put(tmp_path, "t.json", json.dumps([{"id": "t", "elements": [{"a": 1}]}]))).first().id == "t"
    csv = 'id,rvvCode,latitude,longitude,bearing,firstSeenOn,textSigns\n1,A1,52.1,4.7,90,2024-01-02T00:00:00,"[{""a"":1}]"\n2,A1,,4.7,,,\n3,A1,x,4.7,,,\n'
    s = json_feeds.traffic_signs(spark, put(tmp_path, "s.csv.gz", csv)).collect()
    assert [(r.id, r.bearing, str(r.first_seen), r.lat) for r in s] == [("1", 90, "2024-01-02", 52.1)]


def dbf(fields, records):
    head = struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(records), 32 + 32 * len(fields) + 1, 1 + sum(w for _, w in fields))
    for n, w in fields:
        head += n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15
    return head + b"\r" + b"".join(b" " + b"".join(str(v).encode().ljust(w) for v, (_, w) in zip(r, fields, strict=True)) for r in records) + b"\x1a"


def shp(lines):
    out = b""
    for i, pts in enumerate(lines):
        body = struct.pack("<I", 1) + struct.pack("<2d", *pts[0]) if len(pts) == 1 else struct.pack("<I4d2I", 3, 0, 0, 0, 0, 1, len(pts)) + struct.pack("<I", 0) + b"".join(struct.pack("<2d", *p) for p in pts)
        out += struct.pack(">2I", i + 1, len(body) // 2) + body
    return b"\0" * 100 + out


def test_shapefiles(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/WGS84/lines.shp", shp([[(4.0, 52.0), (4.1, 52.1)], [(5.0, 52.0)]]))
        z.writestr("x/WGS84/lines.dbf", dbf([("LOC_NR", 6), ("NAME", 4)], [(11, "a"), (12, "b")]))
        z.writestr("VILD6.13.A.dbf", dbf([("LOC_NR", 6), ("POS_OFF", 6), ("ROADNUMBER", 5)], [(11, 12, "A9"), (0, 1, "x"), (12, "", "")]))
    path = str(tmp_path / "a.zip")
    got = {r.id: [[tuple(p) for p in part] for part in r.parts] for r in binary_feeds.chain_shapes(spark, path).collect()}
    assert got == {11: [[(4.0, 52.0), (4.1, 52.1)]], 12: [[(5.0, 52.0)]]}
    assert {(r.loc_nr, r.pos_off, r.road_number) for r in binary_feeds.chain_table(spark, path).collect()} == {(11, 12, "A9"), (12, None, None)}


def test_ingest_and_ledger(spark, tmp_path):
    folder = str(tmp_path / "lake")
    cam = lambda *ids: put(tmp_path, "c.json", json.dumps({"result": [{"id": i, "land": "NL", "status": "A", "lat": "52", "lng": "5"} for i in ids]}))
    feed = ingest.BY_NAME["speed_cameras"]
    assert tuple(ingest.ingest(spark, feed, cam(1, 2), folder, "2024-01-01 00:00:00").first())[:3] == ("speed_cameras", "ok", 2)
    ingest.ingest(spark, feed, cam(2, 3), folder, "2024-01-02 00:00:00")
    assert {(r.id, r.ingested_at.day) for r in ingest.stored(spark, folder, feed).collect()} == {(2, 2), (3, 2)}
    bad = ingest.ingest(spark, feed, put(tmp_path, "b.json", "{}"), folder, "2024-01-03 00:00:00").first()
    assert bad.status == "error" and ingest.stored(spark, folder, feed).count() == 2
    empty = ingest.ingest(spark, feed, cam(), folder, "2024-01-03 01:00:00").first()
    assert empty.status == "error" and ingest.stored(spark, folder, feed).count() == 2
    same = ingest.ingest(spark, feed, "nowhere", folder, "2024-01-04 00:00:00", changed=False, etag="e1").first()
    assert same.status == "not_modified" and ingest.conditions(spark, folder, "speed_cameras") == ("e1", None)
    ledger = spark.read.parquet(f"{folder}/runs").orderBy("finished").collect()
    assert [r.status for r in ledger] == ["ok", "ok", "error", "error", "not_modified"]
    assert len(ingest.FEEDS) == 24 and ingest.registry(spark).count() == 24


def test_merges_of_feeds(spark, tmp_path):
    """Unique keys, unchanged rows keep their stamp, categories that vanished stay, children go with their parents."""
    folder = str(tmp_path / "lake")
    tables = {}
    feed = lambda name, **o: ingest.Feed(name, "realtime", 60, ("k",), lambda spark, path: tables[path], **o)
    put_rows = lambda path, rows, schema="k long, v long": tables.__setitem__(path, spark.createDataFrame(rows, schema).coalesce(1))
    read = lambda f: {tuple(r[:-1]): r[-1].day for r in ingest.stored(spark, folder, f).collect()}
    speed = feed("speed", merge="changed")
    put_rows("a", [(1, 5), (2, 5), (1, 6)])
    put_rows("b", [(2, 5), (1, 7), (3, None)])
    assert ingest.ingest(spark, speed, "a", folder, "2024-01-01 00:00:00").first().rows == 2
    assert read(speed) == {(1, 6): 1, (2, 5): 1}
    ingest.ingest(spark, speed, "b", folder, "2024-01-02 00:00:00")
    assert read(speed) == {(1, 7): 2, (2, 5): 1, (3, None): 2}
    kinds = feed("kinds", absent="guarded", category="c")
    put_rows("c", [(1, "x"), (2, "x"), (3, "y")], "k long, c string")
    put_rows("d", [(1, "x")], "k long, c string")
    put_rows("e", [], "k long, c string")
    for day, path in ((1, "c"), (2, "d"), (3, "e")):
        ingest.ingest(spark, kinds, path, folder, f"2024-01-0{day} 00:00:00")
    assert read(kinds) == {(1, "x"): 2, (3, "y"): 1}
    pruned = feed("pruned", absent="prune")
    for day, path in ((1, "a"), (2, "b")):
        ingest.ingest(spark, pruned, path, folder, f"2024-01-0{day} 00:00:00")
    assert set(read(pruned)) == {(2, 5), (1, 7), (3, None)}
    tables["p"] = tuple(spark.createDataFrame(r, s) for r, s in (([(1, 0), (2, 0)], "k long, v long"), ([(1, "a"), (2, "b"), (2, "c")], "parent long, child string")))
    tables["q"] = tuple(spark.createDataFrame(r, s) for r, s in (([(2, 0), (3, 0)], "k long, v long"), ([(3, "d")], "parent long, child string")))
    whole = feed("parents", children=("children", "k", "parent"))
    for day, path in ((1, "p"), (2, "q")):
        assert ingest.ingest(spark, whole, path, folder, f"2024-01-0{day} 00:00:00").first().status == "ok"
    assert {tuple(r) for r in ingest.stored(spark, folder, whole, "children").collect()} == {(1, "a"), (3, "d")}
