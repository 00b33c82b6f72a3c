"""Golden values of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from roadweave.functions import geo, refs


@pytest.fixture
def one(spark):
    row = spark.range(1)
    return lambda **c: row.select(*[v.alias(k) for k, v in c.items()]).first()


LINE = "array<struct<x:double,y:double>>"


def line(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_references(one):
    r = one(a=refs.first_ref(F.lit("A009")), b=refs.first_ref(F.lit("N 203")), c=refs.first_ref(F.lit("001")), d=refs.road_refs(F.lit("A9;A200")), e=refs.first_ref(F.lit("a02")), f=refs.first_ref(F.lit("Kruisweg")))
    assert tuple(r) == ("A9", "N203", "1", ["A9", "A200"], "A2", None)
    q = lambda a, b: refs.ref_quality(F.lit(a), F.lit(b))
    assert tuple(one(a=q("A9", "A9;N3"), b=q("N208", "A208"), c=q("A9", None), d=q("A9", "A8"))) == (2, 1, 0, -1)
    assert one(a=refs.matcher_refs(F.lit("a 09, N-200;")))[0] == ["A9", "N200"]
    assert tuple(one(a=refs.route_hint(F.lit("richting A 10 noord")), b=refs.route_hint(F.lit("centrum")))) == ("A10", None)


@pytest.mark.parametrize(
    ("site", "name", "want"),
    [
        ("GEO01_X", "009hrl057760", ("A9", "L", "measurement_site_name", 57.76)),
        ("RWS01_MONIBAS_1", "0091hrl0572ra", ("A9", "L", "measurement_site_name", 57.2)),
        ("RWS08_6_HRL_096.6_1", None, ("A6", "L", "measurement_site_id", 96.6)),
        ("RWS08_A30_HRR_021.8_1", None, ("A30", "R", "measurement_site_id", 21.8)),
        ("PZH01_1", "N457 hmp 4,75 Re", ("N457", "R", "measurement_site_name", 4.75)),
        ("PZH01_1", "somewhere", (None, None, None, None)),
        ("GEO01_X", "109vwa057760", ("N109", None, None, 57.76)),
    ],
)
def test_site_locations(one, site, name, want):
    assert tuple(one(s=refs.site_location(F.lit(site), F.lit(name).cast("string")))["s"]) == want


def test_roadway_codes(one):
    r = one(a=refs.roadway_code(F.lit("0091hrl0337ra")), b=refs.roadway_code(F.lit("001-HRR-Amersfoort")), c=refs.roadway_code(F.lit("009vwB0337")), d=refs.roadway_code(F.lit("through")))
    assert tuple(r) == ("Li", "Re", "b", None)


def tags(**kv):
    return F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("__", ":")), F.lit(v))]) if kv else F.lit(None).cast("map<string,string>")


def test_tags(one):
    m = lambda d, **kv: refs.maxspeed_kmh(tags(**kv), F.lit(d))
    r = one(a=m("fwd", maxspeed="100"), b=m("bwd", maxspeed="100", maxspeed__backward="50 mph"), c=m("fwd", maxspeed="signals"), d=m("fwd", oneway="-1", maxspeed="80", maxspeed__backward="60"), e=m("fwd", maxspeed="100", maxspeed__forward="none"), f=m("fwd"))
    assert tuple(r) == (100.0, 80.5, None, 60.0, None, None)
    assert tuple(one(a=refs.carriageway_ref(tags(carriageway__ref=" Re ")), b=refs.carriageway_ref(tags(carriageway_ref="")))) == ("Re", None)
    v = lambda n, i: refs.lane_value(F.lit("left||right"), F.lit(n), F.lit(i))
    assert tuple(one(a=v(3, 1), b=v(3, 2), c=v(3, 3), d=v(2, 1))) == ("left", None, "right", None)
    assert tuple(one(a=refs.small_count(F.lit("3")), b=refs.small_count(F.lit("2;3")), c=refs.small_count(F.lit("13")))) == (3, None, None)
    assert tuple(one(p=refs.placement(F.lit("right_of:2")))["p"]) == ("right_of", 2)
    assert one(a=refs.panel_key(F.lit('c"1'), F.lit(1)))[0] == '["c\\"1",1]'
    assert one(a=refs.structure(tags(bridge="yes", layer="1")))[0] == "bridge:1"
    assert tuple(one(a=refs.change_allowed(F.lit("not_left"), "left"), b=refs.change_allowed(F.lit("not_left"), "right"), c=refs.change_allowed(F.lit(None).cast("string"), "left"))) == (False, True, True)


def test_polyline(one):
    r = one(a=refs.polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")), b=refs.polyline(F.lit("_p~iF~ps|U_")), c=refs.polyline(F.lit("é")))
    assert [(p.y, p.x) for p in r.a] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert r.b is None and r.c is None


def test_gantry_ids(one):
    g = lambda *a: refs.gantry_id(*[F.lit(x) for x in a])
    r = one(a=g("A 009", "R", 12.304), b=g("A9", "R", 12.3), c=g("A9", "r", 12.3))
    assert r.a == r.b != r.c and r.a.startswith("matrix-gantry-") and len(r.a) == 30


def test_angles_and_sphere(one):
    a = lambda x, y: geo.angle_between(F.lit(x), F.lit(y))
    assert tuple(one(a=a(350.0, 10.0), b=a(10.0, 350.0), c=a(0.0, 180.0), d=a(-1.0, 1.0))) == (20.0, 20.0, 180.0, 2.0)
    assert tuple(one(a=geo.turn(F.lit(350.0), F.lit(10.0)), b=geo.turn(F.lit(10.0), F.lit(350.0)), c=geo.turn(F.lit(0.0), F.lit(180.0)))) == (20.0, -20.0, 180.0)
    lon, lat = geo.destination(F.lit(4.7), F.lit(52.5), F.lit(30.0), F.lit(1000.0))
    r = one(d=geo.haversine(F.lit(4.7), F.lit(52.5), lon, lat), b=geo.initial_bearing(F.lit(4.7), F.lit(52.5), lon, lat), g=geo.geodesic(F.lit(4.7), F.lit(52.5), lon, lat))
    assert r.d == pytest.approx(1000, abs=1e-6) and r.b == pytest.approx(30, abs=1e-6) and r.g == pytest.approx(1000, abs=4)
    assert one(a=geo.along(F.lit(10.0), F.lit(0.0), F.lit(90.0)), b=geo.along(F.lit(10.0), F.lit(0.0), F.lit(None).cast("double")))[:] == (pytest.approx(10), 0.0)


def test_grid_coordinates(one):
    x, y = geo.to_rd(F.lit(5.38720621), F.lit(52.15517440))
    assert tuple(one(x=x, y=y)) == (155000.0, 463000.0)
    x, y = geo.to_rd(F.lit(4.7), F.lit(52.5))
    lon, lat = geo.from_rd(x, y)
    r = one(lon=lon, lat=lat)
    assert math.hypot((r.lon - 4.7) * 67e3, (r.lat - 52.5) * 111e3) < 0.01


def test_lines(one):
    way = line((0, 0), (3, 4), (3, 10))
    r = one(n=geo.line_length(way), p=geo.project(way, F.lit(5.0), F.lit(7.0)), at=geo.point_at(way, F.lit(2.5)), far=geo.point_at(way, F.lit(99.0)), c=geo.clip(way, F.lit(2.5), F.lit(8.0)), rev=geo.clip(way, F.lit(8.0), F.lit(2.5)), none=geo.line_length(line((1, 1))))
    assert r.n == 11 and r.none == 0 and tuple(r.at) == (1.5, 2.0) and tuple(r.far) == (3.0, 10.0)
    assert tuple(r.p) == (2.0, 8.0, 11.0, 3.0, 7.0, 0.0)
    assert [tuple(p) for p in r.c] == [(1.5, 2.0), (3.0, 4.0), (3.0, 7.0)] and r.rev == r.c[::-1]
    curve = one(c=geo.bezier(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0), F.lit(90.0), F.lit(4.0)))["c"]
    assert len(curve) == 13 and tuple(curve[0]) == (0.0, 0.0) and tuple(curve[-1]) == pytest.approx((10.0, 10.0))


def test_boxes(one):
    box = (0.0, 0.0, 10.0, 10.0)
    s = lambda *p: geo.segment_in_box(*[F.lit(float(v)) for v in p], box)
    assert tuple(one(a=s(-5, 5, 15, 5), b=s(-5, 5, -1, 5), c=s(-1, 9, 2, 12), d=s(-3, 9, 2, 14), e=s(10, -5, 10, 15), f=s(3, 3, 4, 4), g=s(20, 5, 20, 5))) == (True, False, True, False, True, True, False)
    assert one(a=geo.line_in_box(line((-5, -5), (-5, 5), (5, 5)), box))[0]
    for bad in ("1,2,3", "3,2,1,4", "0,0,90,90", "a,b,c,d"):
        with pytest.raises(ValueError):
            geo.parse_bbox(bad)
    assert geo.parse_bbox("1,2,3,4") == (1, 2, 3, 4)


def test_positions_and_tables(one):
    r = one(a=geo.positions(F.lit("52.1 4.7 52.2 4.8")), b=geo.positions(F.lit("52.1 4.7 52.2")), c=geo.positions(F.lit("1 2 3 4"), polygon=True))
    assert [(p.x, p.y) for p in r.a] == [(4.7, 52.1), (4.8, 52.2)] and r.b is None and r.c is None
    t = [(0.0, 17.0), (50.0, 16.0), (100.0, 14.0)]
    assert tuple(one(a=geo.interpolated(F.lit(25.0), t), b=geo.interpolated(F.lit(-3.0), t), c=geo.interpolated(F.lit(200.0), t), d=geo.interpolated(F.lit(75.0), t))) == (16.5, 17.0, 14.0, 15.0)
    assert one(a=geo.smoothed_angle(F.array(F.lit(350.0), F.lit(10.0))))[0] == pytest.approx(358)


def test_bearing_around_a_fraction(one):
    bend = line((0, 0), (10, 0), (10, 10))
    of = lambda f, span=0.001, path=bend: geo.bearing_at(path, F.lit(f), span)
    got = one(first=of(0.0), before=of(0.4), bend=of(0.5), wide=of(0.5, 0.5), last=of(1.0), still=of(0.5, path=line((1, 1), (1, 1))), none=of(0.5, path=F.lit(None).cast(LINE)), unknown=of(None))
    assert (got.first, got.before, got.last) == pytest.approx((90.0, 90.0, 0.0))
    assert (got.bend, got.wide) == pytest.approx((45.0, 45.0)) and (got.still, got.none, got.unknown) == (None, None, None)


def test_forward_box(one):
    """Against the four corners, turned and placed one by one."""
    for heading in (0.0, 37.0, 90.0, 200.0, 359.0):
        lon, lat, h = 4.7, 52.5, math.radians(heading)
        xs, ys = [], []
        for along in (-700, 2500):
            for cross in (-700, 700):
                xs.append(lon + (along * math.sin(h) + cross * math.cos(h)) / (111320 * math.cos(math.radians(lat))))
                ys.append(lat + (along * math.cos(h) - cross * math.sin(h)) / 111320)
        got = one(**dict(zip("abcd", geo.forward_box(F.lit(lon), F.lit(lat), F.lit(heading)))))
        assert list(got) == pytest.approx([min(xs), min(ys), max(xs), max(ys)], abs=1e-6)
    around = one(**dict(zip("abcd", geo.forward_box(F.lit(4.7), F.lit(0.0), F.lit(None).cast("double")))))
    assert list(around) == pytest.approx([4.7 - 2500 / 111320, -2500 / 111320, 4.7 + 2500 / 111320, 2500 / 111320], abs=1e-6)
    assert geo.padded_box((4.0, 52.0, 4.1, 52.01)) == (3.925, 51.99, 4.175, 52.02)
