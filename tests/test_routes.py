"""Edge cases of the list routes and of the geometry that they stand on."""

import pytest
from pyspark.sql import functions as F

from roadweave.functions import geo, refs
from roadweave.operators import routes

BOX = (0.0, 0.0, 10.0, 10.0)


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_polygon_meets_box(spark):
    around = ring((-5, -5), (20, -5), (20, 20), (-5, 20))
    inside = ring((2, 2), (4, 2), (3, 4), (2, 2))
    corner = ring((10, 10), (12, 10), (12, 12))
    apart = ring((-5, -5), (-1, -5), (-1, 20), (-5, 20))
    hook = ring((-5, -5), (20, -5), (20, -1), (-1, -1), (-1, 20), (-5, 20))  # its hull covers the box, it doesn't
    got = spark.range(1).select(*[geo.polygon_in_box(r, BOX).alias(f"c{i}") for i, r in enumerate((around, inside, corner, apart, hook))]).first()
    assert list(got) == [True, True, True, False, False]


def test_lateral_shift(spark):
    of = lambda *v: geo.lateral_shift(*[F.lit(float(x)) for x in v])
    got = spark.range(1).select(of(0, 0, 10, 0, 20, 3.5, 30, 3.5).alias("aside"), of(0, 0, 10, 0, 20, 0, 30, 0).alias("straight"), of(0, 0, 0, 0, 20, 0, 30, 0).alias("none")).first()
    assert got.aside == pytest.approx(3.5) and got.straight == pytest.approx(0.0) and got.none is None


def test_road_flags_without_tags(spark):
    row = spark.createDataFrame([(None, None), ("trunk_link", {"junction": "roundabout", "oneway": "no"})], "highway string, tags map<string,string>")
    assert [tuple(r.f) for r in row.select(refs.road_flags("highway", "tags").alias("f")).collect()] == [(False, False, False), (True, True, False)]


def test_situations(spark):
    feed = spark.createDataFrame([("b", 1.0, 1.0), ("a", 1.0, 1.0), ("far", 50.0, 1.0), ("none", None, None)], "record_id string, lon double, lat double")
    got = routes.situations({"incident": feed, "closure": feed.limit(0)}, BOX, 10)
    assert [(r.record_id, r.category) for r in got.collect()] == [("a", "incident"), ("b", "incident")]
    with pytest.raises(ValueError):
        routes.situations({"incident": feed}, BOX, 10, "weather")


def test_selection_of_roads(spark):
    roads = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0, [1, 2]), (2, 50.0, 50.0, 51.0, 51.0, [2, 3]), (3, 90.0, 90.0, 91.0, 91.0, [7]), (4, 70.0, 70.0, 71.0, 71.0, None)], "osm_id long, ax double, ay double, bx double, by double, node_refs array<int>")
    with pytest.raises(ValueError):
        routes.selected_roads(roads)
    selected = routes.selected_roads(roads, BOX)
    extra = spark.createDataFrame([(4,)], "osm_id long")
    ids = lambda df: sorted(r.osm_id for r in df.collect())
    assert ids(selected) == [1] and ids(routes.context_roads(roads, selected, 0.1, extra)) == [1, 2, 4]
    assert ids(routes.context_roads(roads, selected.limit(0), 0.1, extra)) == [4]


def test_speed_without_readings(spark):
    sites = spark.createDataFrame([], "site_id string, name string, lon double, lat double, road string, carriageway string, carriageway_source string, tmc_direction string, side string, km double, num_lanes int, openlr_bearing int, vild_bearing double, tmc_primary int")
    measured = spark.createDataFrame([], "site_id string, index int, value_type string, speed_kmh double, flow_veh_h double, n_inputs int, std_dev double, measured_at timestamp")
    lanes = spark.createDataFrame([], "site_id string, index int, lane int, veh_length_min int, veh_length_max int")
    chains = spark.createDataFrame([], "loc_nr int, road_number string, hecto_dir int")
    assert routes.speed_locations(measured, sites, lanes, chains, 5, by_km=True).count() == 0


NEAR = (4.705, 52.505, 4.715, 52.515)


def test_panels_keep_rows_without_match(spark):
    shown = spark.createDataFrame([('a "b" c', 1, 4.71, 52.51), ('a "b" c', 0, 4.71, 52.51), (None, 0, 4.71, 52.51), ("far", 0, 9.0, 52.51)], "controller_id string, vms_index int, lon double, lat double")
    status = spark.createDataFrame([('["a \\"b\\" c",1]', "matched"), ('["a \\"b\\" c",0]', "ambiguous")], "source_key string, match_status string")
    links = spark.createDataFrame([('["a \\"b\\" c",1]', 1, 7, 1.0, 2.0), ('["a \\"b\\" c",1]', 0, 5, 4.0, 52.0), ('["a \\"b\\" c",0]', 0, 5, 4.0, 52.0)], "source_key string, link_index int, matched_road_id int, matched_lon double, matched_lat double")
    roads = spark.createDataFrame([(5, "Ring")], "osm_id int, matched_road_name string")
    got = {(r.controller_id, r.vms_index): (r.match_status, r.matched_road_name, r.lon) for r in routes.panels(shown, status, links, roads, NEAR, 10, "best").collect()}
    assert got == {('a "b" c', 1): ("matched", "Ring", 4.0), ('a "b" c', 0): ("ambiguous", "Ring", 4.71), (None, 0): (None, None, 4.71)}
    assert routes.panels(shown, status, links, roads, NEAR, 1).first().controller_id is None


def test_location_codes(spark):
    kind = "id long, lon double, lat double, raw map<string,string>"
    rows = spark.createDataFrame([(2, 4.71, 52.51, {"a": "x", "b": None}), (1, 4.71, 52.51, None), (3, None, 52.51, {}), (4, 4.71, 52.51, {"id": "own"}), (5, 4.9, 52.51, {})], kind)
    got = routes.location_codes(rows, NEAR, 10, "point").collect()
    assert [(r.id, r.properties) for r in got] == [(1, {"id": "1"}), (2, {"id": "2", "a": "x"}), (4, {"id": "own"})]
    lines = spark.createDataFrame([(1, [(4.7, 52.51), (4.72, 52.51)], None), (2, None, None)], "id long, line array<struct<x:double,y:double>>, raw map<string,string>")
    assert [r.id for r in routes.location_codes(lines, NEAR, 10, "line").collect()] == [1], "a line that only crosses the box, and one without a place"
