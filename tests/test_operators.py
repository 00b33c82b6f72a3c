"""Snapshot, lane, routing, selection and streaming operators on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from roadweave.operators import ahead, geojson, lanes, relational, routing, schedule, snapshot, spatial
from roadweave.operators.buckets import Store
from roadweave.streaming import snapshots


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def stored(spark, rows):
    return spark.createDataFrame(rows, "id long, a string, b double").withColumn("ingested_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def test_upsert_is_idempotent_and_overwrites_by_null(spark):
    s, batch = stored(spark, [(1, "x", 1.0), (2, "y", 2.0)]), spark.createDataFrame([(2, "z"), (3, "w")], "id long, a string")
    once = snapshot.upsert(s, batch, ["id"], now())
    assert sorted((r.id, r.a, r.b) for r in once.collect()) == [(1, "x", 1.0), (2, "z", None), (3, "w", None)]
    assert sorted(once.collect(), key=str) == sorted(snapshot.upsert(once, batch, ["id"], now()).collect(), key=str)


def test_merge_changed_keeps_stamps(spark):
    s = stored(spark, [(1, "x", None), (2, "y", 2.0), (3, "z", 3.0)])
    batch = spark.createDataFrame([(1, "x", None, 1), (2, "y", 9.0, 1), (2, "y", 5.0, 2), (4, None, None, 1)], "id long, a string, b double, seq int")
    got = {r.id: (r.a, r.b, r.ingested_at.month) for r in snapshot.merge_changed(s, batch, ["id"], ["a", "b"], now(), "seq").collect()}
    assert got == {1: ("x", None, 1), 2: ("y", 5.0, 2), 3: ("z", 3.0, 1), 4: (None, None, 2)}


def test_prunes_and_guards(spark):
    s = stored(spark, [(1, "p", 0.0), (2, "p", 0.0), (3, "q", 0.0)])
    empty = s.limit(0)
    assert {r.id for r in snapshot.prune(s, empty, ["id"], "a", "p").collect()} == {3}
    assert {r.id for r in snapshot.guarded_prune(s, s.where("id = 1"), ["id"], "a").collect()} == {1, 3}
    with pytest.raises(ValueError):
        snapshot.shrinks(s, s.where("id = 1"))


def test_assignments(spark):
    a = "source_kind string, source_key string, version string, status string"
    old = spark.createDataFrame([("m", "1", "v7", "matched"), ("m", "2", "v8", "matched"), ("m", "3", "v8", "matched")], a)
    links = spark.createDataFrame([("m", k, 0) for k in "123"], "source_kind string, source_key string, link_index int")
    new = spark.createDataFrame([("m", "2", "v8", "ambiguous"), ("m", "4", "v8", "matched")], a)
    kept, left = snapshot.replace_assignments(old, links, new, spark.createDataFrame([("m", "2", 0), ("m", "4", 0)], links.schema), "v8")
    assert {(r.source_key, r.status) for r in kept.collect()} == {("3", "matched"), ("2", "ambiguous"), ("4", "matched")}
    assert {r.source_key for r in left.collect()} == {"3", "4"}


def test_publish_and_stream_equal_batch(spark, tmp_path):
    feed, folder = str(tmp_path / "in"), str(tmp_path / "lake")
    for n, rows in enumerate(([(1, "a", 1.0), (2, "b", 2.0)], [(2, "c", 3.0)], [(3, "d", 4.0), (1, "e", None)])):
        spark.createDataFrame(rows, "id long, a string, b double").coalesce(1).write.mode("append").parquet(f"{feed}/{n}")
        stream = snapshots.feed_stream(spark, f"{feed}/*", "id long, a string, b double")
        merge = lambda s, b: snapshot.upsert(s, b, ["id"], now())
        snapshots.maintain(stream, folder, str(tmp_path / "cp"), merge, stored(spark, []).limit(0), ["id"]).awaitTermination(120)
    assert {(r.id, r.a, r.b) for r in Store(spark, folder).read(snapshots.ROWS).collect()} == {(1, "e", None), (2, "c", 3.0), (3, "d", 4.0)}
    assert Store(spark, str(tmp_path / "none")).read(snapshots.ROWS) is None


def test_keyed_state(spark, tmp_path):
    for n, rows in enumerate(([("s", 1, 5, 10.0)], [("s", 1, 3, 20.0), ("t", 1, 1, 1.0)])):
        spark.createDataFrame(rows, "site string, lane int, ts int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}" if n < 0 else tmp_path / "in"))
    for guard, want in ((False, None), (True, 10.0)):
        stream = snapshots.feed_stream(spark, str(tmp_path / "in"), "site string, lane int, ts int, v double")
        name = f"kept_{guard}"
        q = snapshots.latest_values(stream, ["site", "lane"], "ts", ["v"], guard).writeStream.outputMode("update").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        rows = spark.table(name).collect()
        assert {r.site for r in rows} == {"s", "t"}
        if want:
            assert [r.v for r in rows if r.site == "s" and r.ts == 5] == [want]


def test_cross_sections(spark):
    rows = [({"oneway": "yes", "lanes": "3"}, "oneway", 3, 0), ({"lanes": "4"}, "even", 2, 2), ({"lanes": "3", "lanes:forward": "2"}, "tagged", 2, 1), ({"lanes": "3", "lanes:forward": "2", "lanes:backward": "2"}, "conflict", None, None), ({}, "assumed", 1, 1), ({"lanes": "1"}, "shared", None, None), ({"lanes": "5"}, "odd", None, None), ({"junction": "roundabout"}, "oneway", 1, 0), ({"oneway": "yes", "turn:lanes": "left||right"}, "oneway", 3, 0)]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "way long, tags map<string,string>")
    got = {r.way: (r.rule, r.forward, r.backward) for r in lanes.cross_section(df).collect()}
    assert got == {i: tuple(w) for i, (_, *w) in enumerate(rows)}
    sides = {(r.way, r.direction, r.lane): r.side for r in lanes.lane_rows(lanes.cross_section(df)).collect()}
    assert [sides[0, "fwd", k] for k in (1, 2, 3)] == [-3.5, 0.0, 3.5] and sides[1, "fwd", 1] == 1.75 and sides[1, "bwd", 2] == -5.25


def test_offset_lines(spark):
    line = [{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 50.0}, {"x": 50.0, "y": 50.0}]
    df = spark.createDataFrame([("s", "fwd", 1, line, 2.0), ("s", "bwd", 1, line, -2.0), ("d", "fwd", 1, line[:1] * 2, 2.0)], "segment string, direction string, lane int, line array<struct<x:double,y:double>>, side double")
    got = {(r.segment, r.direction): r for r in lanes.lane_lines(df).collect()}
    assert [tuple(p) for p in got["s", "fwd"].line] == [(2.0, 0.0), (2.0, 48.0), (50.0, 48.0)]
    assert [tuple(p) for p in got["s", "bwd"].line] == [(50.0, 52.0), (-2.0, 52.0), (-2.0, 0.0)]
    assert got["d", "fwd"].line is None and got["d", "fwd"].failure == "degenerate"


def network(spark):
    s = "segment string, way long, direction string, start_node string, end_node string, line array<struct<x:double,y:double>>, ref string, highway string"
    at = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    return spark.createDataFrame([("a", 1, "fwd", "1", "2", at((0, 0), (0, 100)), "A9", "motorway"), ("b", 2, "fwd", "2", "3", at((0, 100), (0, 200)), "A9", "motorway"), ("c", 3, "fwd", "2", "4", at((0, 100), (60, 160)), None, "motorway_link"), ("e", 4, "both", "9", "8", at((0, 203), (0, 300)), "A9", "motorway"), ("x", 5, "unknown", "2", "7", at((0, 100), (0, 0)), None, "primary")], s)


def test_movements_and_lanes(spark):
    walks = lanes.traversals(network(spark)).cache()
    assert walks.count() == 5
    moves = lanes.movements(walks)
    pick = lanes.chosen(lanes.undominated(moves, walks))
    got = {(r.s_segment, r.t_segment, r.kind, r.role) for r in pick.collect()}
    assert got == {("a", "b", "exact", "primary"), ("a", "c", "exact", "branch"), ("b", "e", "junction", "primary")}
    sized = pick.withColumns({"s_lanes": F.lit(3), "t_lanes": F.when(F.col("t_segment") == "c", 1).otherwise(3)})
    pairs = lanes.classified(lanes.assigned(sized)).collect()
    assert {(r.s_lane, r.t_lane) for r in pairs if (r.s_segment, r.t_segment) == ("a", "b")} == {(1, 1), (2, 2), (3, 3)}
    assert [(r.s_lane, r.t_lane, r.kind_of_lane) for r in pairs if r.t_segment == "c"] == [(3, 1, "continuation")]
    wide = spark.createDataFrame([("a", "fwd", x, "b", "fwd", y) for x, y in ((1, 1), (2, 1), (2, 2), (2, 3), (3, 3))], "s_segment string, s_travel string, s_lane int, t_segment string, t_travel string, t_lane int")
    assert {(r.s_lane, r.t_lane, r.kind_of_lane) for r in lanes.classified(wide).collect()} == {(1, 1, "continuation"), (2, 1, "join"), (2, 2, "split"), (2, 3, "split"), (3, 3, "join")}
    rules = spark.createDataFrame([("block", "a", "fwd", 3, "c", "fwd", 1), ("connect", "a", "fwd", 2, "c", "fwd", 1)], "action string, s_segment string, s_travel string, s_lane int, t_segment string, t_travel string, t_lane int")
    after = lanes.overridden(lanes.assigned(sized), rules).where("t_segment = 'c'").collect()
    assert [(r.s_lane, r.t_lane) for r in after] == [(2, 1)]


def test_trims_and_connectors(spark):
    c = spark.createDataFrame([("s", "fwd", "start", 4.0, 10.0), ("s", "fwd", "start", 6.0, 10.0), ("s", "fwd", "end", 6.0, 10.0), ("t", "fwd", "end", 1.0, 10.0)], "segment string, travel string, end string, wish double, length double")
    got = {(r.segment, r.end): r.trim for r in lanes.trims(c).collect()}
    assert got == {("s", "start"): 4.0, ("s", "end"): 4.0, ("t", "end"): 1.0}
    e = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 10.0, 0.0, 3.0), (2, 0.0, 0.0, 0.0, 10.0, 10.0, 90.0, 3.0), (3, 0.0, 0.0, 0.0, 0.0, 0.01, 0.0, 3.0)], "id int, x0 double, y0 double, b0 double, x1 double, y1 double, b1 double, handle double")
    assert {r.id: len(r.line) for r in lanes.connectors(e).collect()} == {1: 2, 2: 13}
    assert [tuple(r) for r in spark.range(1).select(lanes.compatible(F.lit("left"), F.lit(-90.0)), lanes.compatible(F.lit("left"), F.lit(90.0)), lanes.compatible(F.lit("through; Right"), F.lit(90.0)), lanes.compatible(F.lit("merge_to_left"), F.lit(0.0)), lanes.compatible(F.lit("through"), F.lit(30.0)), lanes.compatible(F.lit(None).cast("string"), F.lit(30.0))).collect()] == [(True, False, True, False, False, True)]


def test_markings(spark):
    df = spark.createDataFrame([({"oneway": "yes", "turn:lanes": "left|through", "change:lanes": "not_right|yes"}, "fwd", 2, 1)], "tags map<string,string>, direction string, lane_count int, lane int")
    r = lanes.markings(df).first()
    assert (r.turn_mark, r.change_left, r.change_right) == ("left", True, False)


def test_routes(spark):
    e = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "c", 1.0), (1, "a", "c", 5.0), (2, "a", "b", 1.0)], "pair long, a string, b string, w double")
    both = e.unionByName(e.select("pair", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    ends = spark.createDataFrame([(1, "c", "a"), (2, "a", "z"), (3, "a", "a")], "pair long, start string, goal string")
    assert {(r.pair, tuple(r.path), r.dist) for r in routing.shortest(both, ends).collect()} == {(1, ("c", "b", "a"), 2.0), (3, ("a",), 0.0)}
    d = routing.distances(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (7, 8, 1.0)], "a long, b long, w double"), spark.createDataFrame([(0,)], "node long"))
    assert {tuple(r) for r in d.collect()} == {(0, 0.0), (1, 1.0), (2, 2.0)}
    line = [{"x": 0.0, "y": 0.0}, {"x": 100.0, "y": 0.0}]
    s = routing.splice(spark.createDataFrame([(line, 50.0, 3.0), (line, 2.0, 0.0)], "line array<struct<x:double,y:double>>, px double, py double")).collect()
    assert [tuple(p) for p in s[0].line] == [(0.0, 0.0), (50.0, 0.0), (100.0, 0.0)] and len(s[1].line) == 2
    cams = spark.createDataFrame([(1, "A9", 4.0, 52.0, 4.1, 52.1), (2, "Main", 4.0, 52.0, 4.1, 52.1), (3, None, 4.0, 52.0, 4.1, 52.1)], "pair long, street string, min_lon double, min_lat double, max_lon double, max_lat double")
    ways = spark.createDataFrame([(1, "a9", "Main", 4.05, 52.0, 4.06, 52.1), (2, "N1", "main", 4.05, 52.0, 4.06, 52.1), (3, "A9", None, 5.0, 53.0, 5.1, 53.1)], "way long, ref string, name string, w_min_lon double, w_min_lat double, w_max_lon double, w_max_lat double")
    assert {(r.pair, r.way) for r in routing.ways_of_street(ways, cams).collect()} == {(1, 1), (2, 1), (2, 2), (3, 1), (3, 2)}


SENSORS = "site_id long, lon double, lat double, road string, carriageway string, km double, bearing double"


def test_upcoming_and_context(spark):
    east = 4.7105 + 1900 / (111320 * 0.6085)
    rows = [(1, east, 52.5182 + 300 / 110540, "A9", "R", 14.0, 90.0), (2, 4.7105, 52.5190, "A9", "R", None, 0.0), (3, 4.7105, 52.5190, "A9", "L", 11.0, 180.0), (4, 4.7105, 52.5190, "A2", "R", 12.5, 0.0)]
    df = spark.createDataFrame(rows, SENSORS)
    device = {"lon": 4.7105, "lat": 52.5182, "heading": 0.0}
    got = {r.site_id: (r.placement, round(r.along)) for r in ahead.upcoming(df, device, {"road": "A9", "carriageway": "R", "km": 12.0}).collect()}
    assert got == {1: ("km", 2000), 2: ("geometry", 88)}
    c = ahead.road_context(df, device).first()
    assert (c.road, c.carriageway) == ("A9", "R")
    back = ahead.road_context(df, {**device, "heading": 180.0}).first()
    assert (back.road, back.carriageway) == ("A9", "L")
    assert ahead.road_context(df, {**device, "heading": 270.0}).count() == 0
    assert ahead.next_signs(df.withColumns({"kind": F.lit("gantry"), "id": F.col("site_id")}), {**device, "heading": None}).count() == 0


def test_states_over_fixes(spark):
    f = spark.createDataFrame([("d", f"2024-01-01 00:00:{s:02d}", x, 0.0, h, r) for s, x, h, r in ((0, 0.0, 0.0, "A9"), (5, 10.0, 0.0, "A9"), (10, 200.0, 0.0, "A9"), (15, 210.0, 130.0, "A9"), (20, 215.0, 130.0, "A2"))], "device string, ts string, x double, y double, heading double, road string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.action for r in ahead.context_states(f).orderBy("ts").collect()] == ["fetch", "keep", "fetch", "discard", "discard"]
    # ten metres a fix: the fetch is the one 150 m after the last fetch, not after the fix before
    slow = spark.createDataFrame([("d", s, s * 10.0, 0.0, None if s < 20 else 0.0, "A9") for s in range(24)], "device string, s int, x double, y double, heading double, road string").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.s for r in ahead.context_states(slow).where("action = 'fetch'").orderBy("s").collect()] == [0, 15, 20]
    h = spark.createDataFrame([("c", f"2024-01-01 00:00:{s:02d}", i) for s, i in ((0, "x"), (3, None), (9, None))], "channel string, ts string, id string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.shown for r in ahead.held_selection(h).orderBy("ts").collect()] == ["x", "x", None]


def test_current_lane_and_progress(spark):
    df = spark.createDataFrame([("a", 6.0), ("b", 3.0), ("c", 40.0)], "lane_id string, dist double")
    assert ahead.current_lane(df, "a").first().lane_id == "a" and ahead.current_lane(df, None).first().lane_id == "b" and ahead.current_lane(df.where("dist > 35"), None).count() == 0
    line = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 100.0, "y": 0.0}],)], "line array<struct<x:double,y:double>>")
    r = ahead.section_progress(line, F.lit(25.0), F.lit(5.0)).first()
    assert (r.progress, r.left) == (0.25, 75.0) and ahead.section_progress(line, F.lit(0.0), F.lit(70.0)).count() == 0
    s = spark.createDataFrame([(2, [{"lane": 1}, {"lane": 3}])], "lane_count int, lanes array<struct<lane:int>>")
    r = ahead.main_and_extra(s).first()
    assert ([x.lane for x in r.main], [x.lane for x in r.extra]) == ([1], [3])


def test_grid_join_plan_and_brute_force(spark):
    p = spark.range(200).selectExpr("id as k", "cast(id * 37 % 101 as double) as x", "cast(id * 53 % 97 as double) as y")
    s = spark.range(150).selectExpr("id as l", "cast(id * 31 % 103 as double) as ax", "cast(id * 17 % 89 as double) as ay", "cast(id * 31 % 103 + id % 9 - 4 as double) as bx", "cast(id * 17 % 89 + id % 5 as double) as by")
    got = spatial.distance_join(p, s, 3.0)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()
    from roadweave.functions import geo

    want = p.crossJoin(s).where(geo.segment_distance("x", "y", "ax", "ay", "bx", "by") <= 3.0)
    assert {(r.k, r.l) for r in got.collect()} == {(r.k, r.l) for r in want.collect()}
    empty = spatial.nearest(p, s.limit(0), "k", "l", 5.0)
    assert empty.count() == 0 and spatial.nearest(p, s, "k", "l", 1.0).count() == 200


def test_geojson(spark):
    df = spark.createDataFrame([(1, 4.7, 52.5, {"ref": "A9", "name": None, "id": "x"}), (2, None, None, None)], "id long, lon double, lat double, tags map<string,string>")
    text = geojson.collection(df.select("id", geojson.feature(geojson.point("lon", "lat"), {"id": F.col("id")}).alias("feature")), order="id")
    fc = json.loads(text)
    assert fc["features"][0] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [4.7, 52.5]}, "properties": {"id": 1}} and "geometry" not in fc["features"][1]
    assert df.where("id = 1").select(geojson.tag_properties("tags", {"id": F.col("id")})).first()[0] == {"ref": "A9", "id": "1"}


def test_schedule(spark):
    rows = [("r", "realtime", 60, False, 60), ("busy", "realtime", 60, True, 600), ("new", "background", 60, False, None), ("old", "background", 60, False, 900), ("m", "maintenance", 60, False, 900)]
    df = spark.createDataFrame(rows, "feed string, class string, cadence int, in_flight boolean, age int")
    names = lambda **o: {r.feed for r in schedule.due(df, **o).collect()}
    assert names(idle=0) == {"r"} and names(idle=300) == {"r", "new", "old"} and names(idle=900) == {"r", "new", "old", "m"} and names(idle=900, bulk=1) == {"r", "m"}
    held = df.unionByName(spark.createDataFrame([("b", "maintenance", 60, True, 5)], df.schema))
    assert {r.feed for r in schedule.due(held, idle=900, bulk=3).collect()} == {"r", "m", "new"}


def test_pages_and_truncation(spark):
    df = spark.range(10)
    assert [tuple(r) for r in relational.page(df, [F.col("id")], 2).collect()] == [(0, True), (1, True)]
    assert [r.truncated for r in relational.page(df, [F.col("id")], 10).collect()] == [False] * 10


def test_distances_over_many_edges(spark):
    """A path of 70 edges, and a direct edge to its end that is longer than all of them."""
    edges = [(i, i + 1, 1.0) for i in range(70)] + [(0, 70, 100.0)]
    d = routing.distances(spark.createDataFrame(edges, "a long, b long, w double").coalesce(1), spark.createDataFrame([(0,)], "node long").coalesce(1))
    assert {(r.node, r.dist) for r in d.collect()} == {(i, float(i)) for i in range(71)}


def test_gradient_joins_near_readings_and_has_both_ends(spark):
    from roadweave.operators import ahead

    rows = [("a", 1, 0.0, 50.0, 100.0), ("a", 2, 0.4, 60.0, 100.0), ("a", 3, 80.0, 71.0, 100.0), ("b", 1, 5.0, 50.0, 60.0), ("b", 2, 5.5, 70.0, 60.0), ("c", 1, 3.0, None, 9.0)]
    got = ahead.gradient(spark.createDataFrame(rows, "line string, seq int, along double, speed double, total double")).orderBy("piece").collect()
    assert {r.line for r in got} == {"a"} and [r.piece for r in got] == [*range(1, 10)]
    assert (got[0].start, got[0].stop, got[0].speed) == (0.0, 10.0, 56.0) and (got[-1].start, got[-1].stop, got[-1].speed) == (80.0, 100.0, 71.0)


def test_site_names_are_read_as_text_where_they_are_no_codes(spark):
    from roadweave.functions import refs

    rows = [(p, "N457 hmp 4.75 Re") for p in ("GEO01_1", "RWS01_1", "PZH_1")] + [("RWS08_1", "N457 hmp 4.75 Re"), ("GEO01_1", "009hrl057760")]
    rows += [("P_1", t) for t in ("A  12 Km 3,5 Links km 7", "N9a km 1 Rex", "B9 km 1 Re", "AB 9 km 1 Re", "N9 KM 1 Re", "N9 km x Re", "N9 km 1 re", " N9 km 1 Re", "N9 km 1", "", "hmp")]
    df = spark.createDataFrame(rows, "site string, name string")
    got = [tuple(r) for r in df.select(refs.site_location("site", "name").alias("s")).select("s.road", "s.carriageway", "s.km").collect()]
    assert got == [("N457", "R", 4.75)] * 3 + [(None, None, None), ("A9", "L", 57.76), ("A12", "L", 3.5), ("N9a", "R", 1.0)] + [(None, None, None)] * 9


def test_json_has_no_nan(spark):
    import json

    from roadweave.operators import geojson

    df = spark.createDataFrame([(1.5, 2.0), (float("nan"), float("inf")), (None, 1.0)], "a double, b double")
    got = [json.loads(r[0]) for r in df.select(geojson.feature(geojson.point("a", "b"), {"a": geojson.number("a"), "b": geojson.number("b")})).collect()]
    assert [g["properties"] for g in got] == [{"a": 1.5, "b": 2.0}, {}, {"b": 1.0}] and [g.get("geometry") is None for g in got] == [False, True, True]


def test_a_cut_camera_file_is_refused(spark):
    from pyspark.sql import functions as F

    from roadweave.sources import ingest

    feed = ingest.BY_NAME["speed_cameras"]
    cameras = lambda n: spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(1.0).alias("x"))
    stored = ingest.merged(None, cameras(100), feed, F.lit("2024-01-01").cast("timestamp"))
    with pytest.raises(ValueError, match="refused"):
        ingest.merged(stored, cameras(10), feed, F.current_timestamp())
    assert ingest.merged(stored, cameras(60), feed, F.current_timestamp()).count() == 60
