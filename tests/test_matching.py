"""Golden matching cases: evidence order, refusal of what can't be told apart."""

import math
import random

from pyspark.sql import functions as F

from roadweave.operators import chains, matching
from roadweave.plans import network

PAIRS = "site_id long, road_ref string, bearing double, num_lanes int, source_id long, dist double, line_bearing double, ref string, lane_count int, connected array<long>"


def match(spark, site, candidates):
    """site: (ref, bearing, lanes); candidates: (distance, bearing, ref, lanes[, connected])."""
    rows = [(1, *site, i + 1, float(c[0]), float(c[1]), c[2], c[3], list(c[4]) if len(c) > 4 else []) for i, c in enumerate(candidates)]
    return matching.match_sites(spark.createDataFrame(rows, PAIRS)).first()


def test_winner(spark):
    assert match(spark, ("A9", 20.0, 2), [(1, 200, "A9", 2), (2, 22, "A8", 2), (8, 25, "A9", 2)]).source_id == 3
    assert match(spark, ("N203", 90.0, 2), [(1, 90, None, 2), (5, 92, "N203", 1), (10, 95, "N203", 2)]).source_id == 3
    assert match(spark, ("N208", 20.0, None), [(5, 20, "A208", 1), (12, 21, "N208", 1)]).source_id == 2
    assert match(spark, ("N200", 355.0, 3), [(2.5, 350, "A200", 2), (23.9, 356.4, "N200", 3)]).source_id == 1
    assert match(spark, ("A9", 0.0, 3), [(5.0, 0, "A9", 1), (2.0, 16, "A9", 1), (10, 1, "A9", 3)]).source_id == 3


def test_refusal(spark):
    r = match(spark, ("A9", 0.0, 2), [(5.0, 1, "A9", 2), (5.5, 2, "A9", 2)])
    assert (r.source_id, r.failure) == (None, "ambiguous_candidates")
    assert match(spark, ("A9", 0.0, 2), [(5.0, 1, "A9", 2, [2]), (5.5, 2, "A9", 2)]).source_id == 1
    assert match(spark, ("A9", None, 2), [(1, 1, "A9", 2)]).failure == "bearing_mismatch"
    assert match(spark, ("A9", 0.0, 2), [(1, 1, "A8", 2)]).failure == "road_ref_conflict"
    assert match(spark, ("A9", 0.0, 2), [(1, 90, "A9", 2)]).failure == "bearing_mismatch"


SIGNS = "gantry long, sign long, road string, carriageway string, lane int, bearing double"
LANES = "gantry long, sign long, segment string, direction string, lane_id long, lane_nr int, lane_count int, road_id long, ref string, lane_carriageway string, highway string, line_bearing double, dist double"


def gantry(spark, signs, lanes):
    """signs: (sign, road, carriageway, lane, bearing); lanes: (sign, segment, direction, angle, dist[, options])."""
    rows = []
    for i, (s, segment, direction, angle, dist, *more) in enumerate(lanes):
        o = {"lane_nr": 1, "lane_count": 1, "road": 7, "ref": "A9", "label": None, "highway": "motorway"} | (more[0] if more else {})
        rows.append((1, s, segment, direction, i + 1, o["lane_nr"], o["lane_count"], o["road"], o["ref"], o["label"], o["highway"], float(angle), float(dist)))
    got = matching.match_gantries(spark.createDataFrame([(1, *x) for x in signs], SIGNS), spark.createDataFrame(rows, LANES)).collect()
    return {r["sign"]: r for r in got}


def test_gantries(spark):
    one = [(1, "A9", "R", 1, 90.0)]
    r = gantry(spark, one, [(1, "1:5:6", "fwd", 90, 1.0), (1, "1:5:6", "bwd", 270, 1.1)])[1]
    assert (r.status, r.direction, r.confidence, r.reason, r.applies_to) == ("matched", "fwd", "high", None, 1)
    # parallel roads of one number can't be told apart; the road going on at the shared node can; against the travel order it doesn't go on
    pair = lambda a, b: gantry(spark, one, [(1, a, "fwd", 90, 5.0), (1, b, "fwd", 90, 5.5)])[1]
    assert (pair("200:1:2", "201:3:4").status, pair("200:1:2", "201:3:4").reason) == ("ambiguous", "bearing_ambiguous")
    assert pair("200:1:2", "201:2:4").status == "matched" and pair("200:1:2", "201:3:2").status == "ambiguous" and pair("200:0:0", "201:0:0").status == "ambiguous"
    # without a bearing two directions of one road never are, however far apart
    assert gantry(spark, [(1, "A9", "R", 1, None)], [(1, "1:5:6", "fwd", 90, 1.0), (1, "1:5:6", "bwd", 270, 4.0)])[1].status == "ambiguous"
    assert gantry(spark, [(1, "A9", "R", 1, None)], [(1, "1:5:6", "fwd", 90, 1.0), (1, "2:7:8", "bwd", 270, 4.0, {"road": 8})])[1].confidence == "medium"
    assert gantry(spark, [(1, "A9", "R", 1, 0.0)], [(1, "1:5:6", "fwd", 90, 1.0)])[1].reason == "bearing_mismatch"
    assert gantry(spark, one, [(1, "1:5:6", "fwd", 90, 1.0, {"ref": "A8"})])[1].reason == "road_ref_conflict"
    link = {"ref": "A8", "highway": "motorway_link"}
    assert gantry(spark, one, [(1, "1:5:6", "fwd", 90, 5.0, link)])[1].ref_quality == "connector" and gantry(spark, one, [(1, "1:5:6", "fwd", 90, 5.1, link)])[1].reason == "road_ref_conflict"
    # the sign's own label decides near ties; both bear it: the nearer
    labelled = lambda a, b: gantry(spark, one, [(1, "1:5:6", "fwd", 90, 2.0, {"label": a}), (1, "2:7:8", "fwd", 90, 1.0, {"label": b})])[1]
    assert labelled("Re", "Li").segment == "1:5:6" and labelled("Re", "Re").segment == "2:7:8" and labelled("b", None).segment == "2:7:8"


def test_gantry_as_a_whole(spark):
    three = [(k, "A9", "R", k, 0.0) for k in (1, 2, 3)]
    lane = lambda n: {"lane_nr": n, "lane_count": 3}
    lanes = [(s, "1:1:2", "fwd", 0, 9.0 + n, lane(n)) for s in (1, 2, 3) for n in (1, 2, 3)] + [(1, "2:3:4", "fwd", 0, 1.0)]
    got = gantry(spark, three, lanes)
    assert {(r.segment, r.status, r.confidence) for r in got.values()} == {("1:1:2", "matched", "high")}
    assert [got[k].applies_to for k in (1, 2, 3)] == [1, 5, 9] and got[3].dist == 12.0 and got[1].candidates == 2
    two = gantry(spark, three, [x for x in lanes if x[5:] != (lane(3),)])
    assert (two[3].reason, two[3].lane_id is not None, two[3].applies_to, two[1].reason) == ("lane_mapping_missing", True, None, None)
    assert {r.reason for r in gantry(spark, three[:2], lanes).values()} == {"lane_count_mismatch"}
    part = gantry(spark, three, [x for x in lanes if x[0] != 3])
    assert (part[1].confidence, part[3].status, part[3].reason) == ("low", "unmatched", "no_major_road")
    report = matching.gantry_report(matching.match_gantries(spark.createDataFrame([(1, *x) for x in three], SIGNS), spark.createDataFrame([], LANES))).collect()
    assert [(r.status, r.reason, r.signs) for r in report] == [("unmatched", "no_major_road", 3)]


PANEL = "panel long, segment string, direction string, lane_id long, road_id long, ref string, line_bearing double, dist double"


def panel(spark, bearing, rows, description=None):
    p = spark.createDataFrame([(1, bearing, description)], "panel long, bearing double, description string")
    return matching.match_panels(spark.createDataFrame([(1, *r) for r in rows], PANEL), p).first()


def test_panels(spark):
    near, far = ("a", "fwd", 1, 1, "A9", 10.0, 20.0), ("b", "fwd", 2, 2, "A9", 12.0, 300.0)
    assert tuple(panel(spark, 10.0, [near, far], "A9")[1:5]) == ("matched", None, "high", 2)
    assert panel(spark, 10.0, [near], "DRIP A-4").ref_quality == "conflict" and panel(spark, 10.0, [near]).ref_quality == "corridor"
    assert tuple(panel(spark, 10.0, [far])[1:4]) == ("matched", None, "medium")
    assert panel(spark, 40.0, [far]).reason == "extended_bearing_too_weak"
    assert panel(spark, None, [far]).reason == "extended_requires_bearing"
    # without a bearing two directions of a road are never told apart; two roads are from 2 m on
    assert panel(spark, None, [near, ("a", "bwd", 3, 1, "A9", 190.0, 40.0)], "A9").reason == "direction_ambiguous"
    assert panel(spark, None, [near, ("c", "bwd", 3, 5, "A9", 190.0, 23.0)]).status == "matched"
    # the named road tells two near ones apart, also on one traversal at equal distance
    other = ("c", "fwd", 3, 5, "A4", 10.0, 20.5)
    assert panel(spark, 10.0, [near, other]).reason == "bearing_ambiguous" and panel(spark, 10.0, [near, other], "A 04 west").segment == "c"
    assert panel(spark, 10.0, [near, ("a", "fwd", 0, 1, "A4", 10.0, 20.0)], "n9 a9").lane_id == 0
    assert panel(spark, 10.0, [near, ("a", "fwd", 0, 1, "A4", 10.0, 20.0)], "a9").lane_id == 1
    assert panel(spark, 100.0, [near]).reason == "bearing_mismatch" and panel(spark, 10.0, []).status == "unsupported"


def test_chain_direction(spark):
    schema = "line array<struct<x:double,y:double>>, tx double, ty double, nx double, ny double, x double, y double, neighbour_is_positive boolean, tmc_direction string, hecto_dir int, carriageway string"
    base = ([(0.0, 0.0), (0.0, 100.0)], 0.0, 20.0, 0.0, 80.0, 2.0, 50.0, True)
    rows = [(*base, "positive", 1, "R"), (*base, "negative", 1, "R"), (*base, "positive", 0, None), ([(0.0, 0.0), (0.0, 100.0)], 90.0, 20.0, 0.0, 80.0, 2.0, 50.0, True, "positive", 1, None)]
    got = [(r.chain_bearing, r.derived_carriageway, r.carriageway_conflict) for r in chains.direction(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert got == [(0.0, "R", False), (180.0, "L", True), (0.0, None, None), (None, "R", None)]


def test_direction_chooses_its_part_of_the_road(spark):
    schema = "parts array<array<struct<x:double,y:double>>>, tx double, ty double, nx double, ny double, x double, y double, neighbour_is_positive boolean, tmc_direction string, hecto_dir int, carriageway string"
    up, down, far = [(0.0, 0.0), (0.0, 100.0)], [(30.0, 100.0), (30.0, 0.0)], [(500.0, 0.0), (500.0, 100.0)]
    at = lambda parts, x, way="positive", hecto=1: (parts, x, 20.0, x, 80.0, x, 50.0, True, way, hecto, "L")
    rows = [
        at([far, up, down], 2.0),  # the nearest of two that are near
        at([up, down], 28.0),
        at([up, down], 15.0),  # both as near: none
        at([up, down], 15.1),  # within half a metre
        at([far], 2.0),  # none near
        at([up], 2.0, "negative", -1),
        at([up], 2.0, None),
        ([up], 2.0, 20.0, 2.0, 20.3, 2.0, 50.0, True, "positive", 1, "R"),  # the places are one
        ([[(0.0, 0.0), (0.0, 0.2)]], 0.0, 0.0, 0.0, 0.2, 0.0, 0.1, True, "positive", 1, "R"),
    ]
    got = [(r.chain_bearing, r.derived_carriageway, r.carriageway_conflict) for r in chains.direction(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    # a neighbour ahead of the place along the chain: the chain runs from the place to it, whichever way the part is drawn
    assert got == [(0.0, "R", True), (0.0, "R", True), (None, "R", True), (None, "R", True), (None, "R", True), (180.0, "R", True), (None, None, None), (None, "R", False), (None, "R", False)]


def test_chain_walks_guard_against_circles(spark):
    tmc = spark.createDataFrame([(1, 2, None), (2, 3, 1), (3, 1, 2), (4, None, 3)], "loc_nr long, pos_off long, neg_off long")
    got = chains.walk_both(tmc, spark.createDataFrame([(1, 3), (4, 1), (1, 9), (2, 2)], "start long, goal long")).collect()
    assert {(r.start, r.goal, tuple(r.path), r.way) for r in got} == {(1, 3, (1, 2, 3), "pos"), (4, 1, (4, 3, 2, 1), "neg"), (2, 2, (2,), "pos")}
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 1.0)], "loc long, x double, y double")
    line = chains.line_of(chains.walk_both(tmc, spark.createDataFrame([(1, 3)], "start long, goal long")), points).first().line
    assert [tuple(p) for p in line] == [(0.0, 0.0), (1.0, 1.0)]


def test_lane_speeds(spark):
    lanes = spark.createDataFrame([(1, "fwd", 1), (1, "fwd", 2)], "source_id long, direction string, lane int")
    readings = spark.createDataFrame([(1, "fwd", 1, 80.0, 5, 3.0, "a"), (1, "fwd", 1, 90.0, 6, 9.0, "b"), (1, "fwd", 1, None, 7, 1.0, "c"), (1, "fwd", 2, None, 7, 1.0, "d")], "source_id long, direction string, lane int, speed double, ts long, dist double, sensor string")
    r = matching.lane_speeds(lanes, readings).collect()
    assert len(r) == 1 and (r[0].speed, r[0].sensor, r[0].sensors) == (90.0, "b", ["a", "b", "c"])
    assert matching.lane_speeds(lanes, readings.limit(0)).count() == 0 and F is not None


def test_walks_by_doubling_equal_single_steps(spark):
    import random

    rng = random.Random(6)
    after = {i: i + 1 for i in range(700)} | {i: rng.choice([None, *range(1000, 1060)]) for i in range(1000, 1060)}
    pairs = {(rng.randrange(700), rng.randrange(701)) for _ in range(300)} | {(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(200)} | {(0, 400), (0, 401), (5, 5)}

    def plain(start, goal, most):
        path = [start]
        while path[-1] != goal:
            nxt = after.get(path[-1])
            if nxt is None or len(path) > most:
                return None
            path.append(nxt)
        return tuple(path)

    df = spark.createDataFrame([*after.items()], "loc long, next long")
    for most in (400, 7):
        got = {(r.start, r.goal): tuple(r.path) for r in chains.walk(df, spark.createDataFrame([*pairs], "start long, goal long"), most).collect()}
        assert got == {p: w for p in pairs if (w := plain(*p, most))}


def test_lines_follow_the_shared_road(spark):
    paths = spark.createDataFrame([(1, 3, [1, 2, 3]), (3, 1, [3, 2, 1]), (4, 9, [4, 9]), (9, 8, [9, 8])], "start long, goal long, path array<long>")
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 10.0, -1.0), (3, 20.0, 5.0), (4, 1.0, 1.0)], "loc long, x double, y double")
    chain = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 7), (9, 7)], "loc long, lin_ref long")
    roads = spark.createDataFrame([(7, [(-5.0, 0.0), (4.0, 0.0), (12.0, 0.0)])], "lin_ref long, line array<struct<x:double,y:double>>")
    got = {(r.start, r.goal): [tuple(p) for p in r.line] for r in chains.road_line_of(paths, points, chain, roads).collect()}
    there = [(0.0, 0.0), (4.0, 0.0), (10.0, 0.0), (10.0, -1.0), (20.0, 5.0)]
    back = [(20.0, 5.0), (10.0, -1.0), (10.0, 0.0), (4.0, 0.0), (0.0, 0.0)]
    assert got == {(1, 3): there, (3, 1): back}


def test_gantry_query_searches_80_metres(spark):
    r = network.gantry_consensus(spark, "/root/testdata/sf0.001").agg(F.max("dist").alias("far")).first()
    assert 20 < r.far <= 80


def test_lanes_near_equals_brute_force(spark):
    rng = random.Random(4)
    spread = lambda n, size: [(rng.uniform(0, size), rng.uniform(0, size)) for _ in range(n)]
    # one place full of lanes, few elsewhere, and one lane twice
    lanes = [(i, x, y, x + rng.uniform(-20, 20), y + rng.uniform(-20, 20), f"s{i}") for i, (x, y) in enumerate(spread(200, 30) + spread(60, 900))]
    lanes.append(lanes[0])
    places = [(i, x, y) for i, (x, y) in enumerate(spread(10, 40) + spread(20, 900) + [(5000.0, 5000.0)])]

    def dist(x, y, a, b, c, d):
        t = max(0.0, min(1.0, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
        return math.hypot(a + t * (c - a) - x, b + t * (d - b) - y)

    expected = []
    for p, x, y in places:
        near = sorted((dist(x, y, *n[1:5]), n[0], n[5]) for n in lanes)
        expected += [(p, i, segment) for d, i, segment in [n for n in near if n[0] <= 80][:64]]
    shape = "source_id long, ax double, ay double, bx double, by double, segment string"
    found = lambda rows: matching.lanes_near(spark.createDataFrame(places, "sign long, x double, y double"), spark.createDataFrame(rows, shape), "sign", 80.0)
    assert sorted((r.sign, r.source_id, r.segment) for r in found(lanes).collect()) == sorted(expected)
    assert found([]).count() == 0
