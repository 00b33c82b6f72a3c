"""Registered queries for column functions and small operators over made values of the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, refs
from ..operators import ahead, lanes, routing
from ..session import table

C = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _orders(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), *[F.expr(e).alias(c) for c, e in columns.items()])


CODE = "CASE o_orderkey % 8 WHEN 0 THEN 'A2 hrR 10.2' WHEN 1 THEN 'HRL' WHEN 2 THEN 'a vwB 3' WHEN 3 THEN 'xhrl' WHEN 4 THEN 'hrlx' WHEN 5 THEN '7vwc9' WHEN 6 THEN '' END"


@query(f"SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'Re' WHEN 1 THEN 'Li' WHEN 2 THEN 'b' WHEN 5 THEN 'c' END AS code FROM (SELECT *, {CODE} AS t FROM orders)")
def roadway_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, t=CODE).select("id", refs.roadway_code("t").alias("code"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'A' || (o_orderkey % 90 + 1) WHEN 1 THEN 'N' || (o_orderkey % 300 + 1) WHEN 2 THEN 'A' || (o_orderkey % 9 + 1) END AS hint FROM orders")
def route_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda m: f"CAST(o_orderkey % {m} + 1 AS STRING)"
    text = f"CASE o_orderkey % 5 WHEN 0 THEN concat('Paneel a ', {n(90)}, ' oost') WHEN 1 THEN concat('langs n-', {n(300)}, ' en A1') WHEN 2 THEN concat('(A / 0', {n(9)}, ')') WHEN 3 THEN concat('BA', {n(9)}, ' A12345') END"
    return _orders(spark, sf_dir, t=text).select("id", refs.route_hint("t").alias("hint"))


LANE_LIST = "concat(CAST(o_orderkey % 7 AS VARCHAR(9)), '| through |', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'right' END)"


@query(f"""WITH t AS (SELECT o_orderkey AS id, {LANE_LIST} AS v, o_orderkey % 2 + 2 AS n, o_orderkey % 4 AS lane FROM orders)
SELECT id, CASE WHEN n = 3 AND lane BETWEEN 1 AND 3 THEN nullif(trim(split_part(v, '|', lane::INTEGER)), '') END AS value FROM t""")
def lane_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, v=LANE_LIST, n="o_orderkey % 2 + 2", lane="o_orderkey % 4").select("id", refs.lane_value("v", "n", "lane").alias("value"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 AND o_orderkey % 20 BETWEEN 1 AND 12 THEN o_orderkey % 20 END::INTEGER AS n, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN split_part('left_of middle_of right_of', ' ', (o_orderkey % 5 + 1)::INTEGER) END AS kind,
CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN o_orderkey % 6 END::INTEGER AS lane FROM orders""")
def tag_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = "CASE o_orderkey % 4 WHEN 0 THEN concat(' ', CAST(o_orderkey % 20 AS STRING)) WHEN 1 THEN CAST(o_orderkey % 20 AS STRING) WHEN 2 THEN concat(CAST(o_orderkey % 20 AS STRING), '.5') ELSE '2;3' END"
    place = "CASE o_orderkey % 5 WHEN 0 THEN concat('left_of:', CAST(o_orderkey % 6 AS STRING)) WHEN 1 THEN concat(' middle_of : ', CAST(o_orderkey % 6 AS STRING)) WHEN 2 THEN concat('right_of:', CAST(o_orderkey % 6 AS STRING), ' ') WHEN 3 THEN 'transition' END"
    rows = _orders(spark, sf_dir, c=count, p=place).withColumn("at", refs.placement("p"))
    return rows.select("id", refs.small_count("c").alias("n"), "at.kind", "at.lane")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'tunnel' WHEN o_orderkey % 5 = 0 THEN 'bridge' ELSE 'ground' END || ':' || CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 4 - 1 END AS structure,
o_orderkey % 2 = 0 AS is_link, o_orderkey % 11 = 0 AS is_roundabout, o_orderkey % 4 IN (0, 1) OR (o_orderkey % 11 = 0 AND o_orderkey % 4 <> 2) AS is_oneway, o_orderkey % 6 NOT IN (0, 1) AS left_allowed, o_orderkey % 6 NOT IN (0, 2) AS right_allowed FROM orders""")
def road_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = """map_filter(map('tunnel', CASE WHEN o_orderkey % 3 = 0 THEN 'yes' WHEN o_orderkey % 3 = 1 THEN 'no' END, 'bridge', CASE WHEN o_orderkey % 5 = 0 THEN 'viaduct' END,
      'layer', CASE WHEN o_orderkey % 7 = 0 THEN 'upper' ELSE CAST(o_orderkey % 4 - 1 AS STRING) END, 'junction', CASE WHEN o_orderkey % 11 = 0 THEN 'Roundabout' END,
      'oneway', CASE o_orderkey % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END), (k, v) -> v IS NOT NULL)"""
    change = "CASE o_orderkey % 6 WHEN 0 THEN 'no' WHEN 1 THEN ' Not_Left' WHEN 2 THEN 'only_left' WHEN 3 THEN 'yes' WHEN 4 THEN 'odd' END"
    rows = _orders(spark, sf_dir, tags=tags, highway="CASE WHEN o_orderkey % 2 = 0 THEN 'trunk_link' END", change=change).withColumn("flags", refs.road_flags("highway", "tags"))
    return rows.select("id", refs.structure("tags").alias("structure"), "flags.*", refs.change_allowed("change", "left").alias("left_allowed"), refs.change_allowed("change", "right").alias("right_allowed"))


@query("""WITH t AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 360)::DOUBLE AS a, (o_custkey * 91 % 360)::DOUBLE AS b FROM orders)
SELECT id, least(abs(a - b), 360 - abs(a - b)) AS apart, CASE WHEN b - a > 180 THEN b - a - 360 WHEN b - a <= -180 THEN b - a + 360 ELSE b - a END AS turn FROM t""")
def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, a="CAST(o_orderkey * 37 % 360 AS DOUBLE)", b="CAST(o_custkey * 91 % 360 AS DOUBLE)")
    return rows.select("id", geo.angle_between("a", "b").alias("apart"), geo.turn("a", "b").alias("turn"))


@query("""WITH t AS (SELECT o_orderkey AS id, 4.0 + (o_orderkey % 1000) / 400.0 AS lon, 51.0 + (o_custkey % 1000) / 500.0 AS lat, radians((o_orderkey * 37 % 360)::DOUBLE) AS h, (o_orderkey % 5000)::DOUBLE / 6371000.0 AS d FROM orders),
e AS (SELECT *, asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(h)) AS b FROM t)
SELECT id, round(lon + degrees(atan2(sin(h) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(b))), 7) AS lon, round(degrees(b), 7) AS lat FROM e""")
def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, lon="4.0 + (o_orderkey % 1000) / 400.0D", lat="51.0 + (o_custkey % 1000) / 500.0D", h="CAST(o_orderkey * 37 % 360 AS DOUBLE)", m="CAST(o_orderkey % 5000 AS DOUBLE)")
    lon, lat = geo.destination("lon", "lat", "h", "m")
    return rows.select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


BEND = {"x1": "CAST(o_orderkey % 40 AS DOUBLE)", "y1": "CAST(o_orderkey % 30 + 1 AS DOUBLE)", "x2": "CAST(o_orderkey % 40 + o_custkey % 50 + 1 AS DOUBLE)", "y2": "CAST(o_custkey % 60 AS DOUBLE)", "m": "CAST(o_orderkey * 13 % 150 - 10 AS DOUBLE)"}


@query(f"""WITH t AS (SELECT o_orderkey AS id, {", ".join(f"{e} AS {c}" for c, e in BEND.items())} FROM orders), l AS (SELECT *, sqrt(x1 * x1 + y1 * y1) AS a, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS b FROM t),
f AS (SELECT *, greatest(0, least(1, m / a)) AS p, greatest(0, least(1, (m - a) / b)) AS q FROM l)
SELECT id, round(a + b, 6) AS length, round(CASE WHEN m <= a THEN p * x1 ELSE x1 + q * (x2 - x1) END, 6) AS x, round(CASE WHEN m <= a THEN p * y1 ELSE y1 + q * (y2 - y1) END, 6) AS y, round(a + b - greatest(0, least(m, a + b)), 6) AS "left" FROM f""")
def points_on_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rows = _orders(spark, sf_dir, **BEND).withColumn("line", F.array(point(F.lit(0.0), F.lit(0.0)), point(C("x1"), C("y1")), point(C("x2"), C("y2"))))
    rows = rows.withColumns({"length": geo.line_length("line"), "at": geo.point_at("line", "m")})
    rest = geo.line_length("rest")
    return rows.withColumn("rest", geo.clip("line", "m", "length")).select("id", F.round("length", 6).alias("length"), F.round("at.x", 6).alias("x"), F.round("at.y", 6).alias("y"), F.round(rest, 6).alias("left"))


TRIANGLE = {"x1": "CAST(o_orderkey % 97 AS DOUBLE)", "y1": "CAST(o_custkey % 89 AS DOUBLE)", "x2": "CAST(o_orderkey % 97 + o_custkey % 61 + 1 AS DOUBLE)", "y2": "CAST(o_custkey % 89 - o_orderkey % 53 AS DOUBLE)", "x3": "CAST(o_orderkey % 97 + o_orderkey % 7 AS DOUBLE)", "y3": "CAST(o_custkey % 89 + o_orderkey % 83 + 1 AS DOUBLE)"}


def _axis(p: str, q: str) -> str:
    """Whether the shadows of triangle and box (20, 20, 60, 50) on this axis meet."""
    own, box = [f"({p}) * x{i} + ({q}) * y{i}" for i in (1, 2, 3)], [f"({p}) * {x} + ({q}) * {y}" for x in (20, 60) for y in (20, 50)]
    return f"least({', '.join(own)}) <= greatest({', '.join(box)}) AND greatest({', '.join(own)}) >= least({', '.join(box)})"


@query(f"""WITH t AS (SELECT o_orderkey AS id, {", ".join(f'{e} AS "{c}"' for c, e in TRIANGLE.items())} FROM orders)
SELECT id, {" AND ".join(_axis(p, q) for p, q in (("1", "0"), ("0", "1"), ("y2 - y1", "x1 - x2"), ("y3 - y2", "x2 - x3"), ("y1 - y3", "x3 - x1")))} AS meets FROM t""")
def zones_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*[F.struct(C(f"x{i}").alias("x"), C(f"y{i}").alias("y")) for i in (1, 2, 3)])
    return _orders(spark, sf_dir, **TRIANGLE).select("id", geo.polygon_in_box(ring, (20.0, 20.0, 60.0, 50.0)).alias("meets"))


@query("""WITH t AS (SELECT o_orderkey AS id, radians((o_orderkey * 37 % 360)::DOUBLE) AS a, radians((o_orderkey * 37 % 360 + o_custkey % 100)::DOUBLE) AS b, (o_orderkey % 23 - 11)::DOUBLE AS x, (o_custkey % 19 - 9)::DOUBLE AS y FROM orders)
SELECT id, round(abs(x * cos((a + b) / 2) - y * sin((a + b) / 2)), 6) AS shift FROM t""")
def lateral_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, a="radians(CAST(o_orderkey * 37 % 360 AS DOUBLE))", b="radians(CAST(o_orderkey * 37 % 360 + o_custkey % 100 AS DOUBLE))", x="CAST(o_orderkey % 23 - 11 AS DOUBLE)", y="CAST(o_custkey % 19 - 9 AS DOUBLE)")
    a, b, x, y = C("a"), C("b"), C("x"), C("y")
    return rows.select("id", F.round(geo.lateral_shift(-8 * F.sin(a), -8 * F.cos(a), F.lit(0.0), F.lit(0.0), x, y, x + 3 * F.sin(b), y + 3 * F.cos(b)), 6).alias("shift"))


@query("""WITH t AS (SELECT l_orderkey AS segment_id, CASE WHEN l_suppkey % 2 = 0 THEN 'fwd' ELSE 'bwd' END AS direction, l_linenumber AS nr, l_partkey AS id FROM lineitem)
SELECT segment_id, direction, string_agg(nr::VARCHAR || ':' || id::VARCHAR, ',' ORDER BY nr, id) AS lanes, (list(id ORDER BY nr, id))[1] AS representative FROM t GROUP BY 1, 2""")
def traversal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("segment_id"), F.when(C("l_suppkey") % 2 == 0, F.lit("fwd")).otherwise(F.lit("bwd")).alias("direction"), C("l_linenumber").alias("lane_nr"), C("l_partkey").alias("lane_id"))
    text = F.array_join(F.transform("lanes", lambda x: F.concat(x["lane_nr"].cast("string"), F.lit(":"), x["lane_id"].cast("string"))), ",")
    return lanes.traversal_groups(rows).withColumn("lanes", text)


@query("""WITH t AS (SELECT o_orderkey AS id, (o_orderkey % 70)::DOUBLE AS s, (o_custkey % 70)::DOUBLE AS e, (o_orderkey % 10000)::DOUBLE AS dist, 4.0 + (o_custkey % 50) / 1000.0 AS lon FROM orders)
SELECT id, dist FROM t WHERE s <= 60 AND e <= 60 AND dist >= 20 AND dist <= 8000 AND dist <= 4 * 2 * 6371000.0 * asin(sqrt(cos(radians(52.0::DOUBLE)) ** 2 * sin(radians(lon - 4.0) / 2) ** 2))""")
def accepted_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, start_gap="CAST(o_orderkey % 70 AS DOUBLE)", end_gap="CAST(o_custkey % 70 AS DOUBLE)", dist="CAST(o_orderkey % 10000 AS DOUBLE)", lon1="4.0 + (o_custkey % 50) / 1000.0D", lon0="4.0D", lat0="52.0D", lat1="52.0D")
    return routing.accepted(rows).select("id", "dist")


@query("""WITH t AS (SELECT c_custkey AS pair, CASE WHEN c_custkey % 4 <> 0 THEN 'r' || c_custkey % 6 END AS street, c_custkey % 100 AS x FROM customer), w AS (SELECT p_partkey AS way, 'R' || p_size % 9 AS ref, 'R' || p_partkey % 12 AS name, p_partkey % 100 AS x FROM part),
m AS (SELECT pair, way, CASE WHEN street IS NULL THEN 0 WHEN upper(street) = ref THEN 1 WHEN upper(street) = name THEN 2 END AS how FROM t, w WHERE abs(t.x - w.x) <= 3),
b AS (SELECT pair, min(how) AS how FROM m GROUP BY 1) SELECT m.pair, count(*) AS ways, min(way) AS first, max(m.how)::INTEGER AS how FROM m JOIN b ON m.pair = b.pair AND m.how = b.how GROUP BY 1""")
def street_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = C("c_custkey"), C("p_partkey")
    sides = lambda x, pad, lead: {f"{lead}min_lon": (x * 10 - pad) / 100, f"{lead}max_lon": (x * 10 + pad) / 100, f"{lead}min_lat": F.lit(52.0), f"{lead}max_lat": F.lit(52.1)}
    cameras = table(spark, sf_dir, "customer").select(k.alias("pair"), F.when(k % 4 != 0, F.concat(F.lit("r"), (k % 6).cast("string"))).alias("street"), *[c.alias(n) for n, c in sides(k % 100, 15, "").items()])
    ways = table(spark, sf_dir, "part").select(p.alias("way"), F.concat(F.lit("R"), (C("p_size") % 9).cast("string")).alias("ref"), F.concat(F.lit("R"), (p % 12).cast("string")).alias("name"), *[c.alias(n) for n, c in sides(p % 100, 16, "w_").items()])
    return routing.street_summary(ways, cameras).select("pair", "ways", "first", "how")


@query("""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 2 WHEN 0 THEN 'gantry' ELSE 'panel' END AS kind, 4.7 + (o_orderkey * 7 % 1009) / 50000.0 AS lon, 52.5 + (o_custkey * 11 % 1013) / 50000.0 AS lat FROM orders),
o AS (SELECT *, (lon - 4.71::DOUBLE) * 111320.0::DOUBLE * cos(radians(52.51::DOUBLE)) AS dx, (lat - 52.51::DOUBLE) * 110540.0::DOUBLE AS dy FROM t),
p AS (SELECT *, dx * sin(radians(30.0::DOUBLE)) + dy * cos(radians(30.0::DOUBLE)) AS along, dx * cos(radians(30.0::DOUBLE)) - dy * sin(radians(30.0::DOUBLE)) AS across FROM o)
SELECT kind, id, round(along, 6) AS along FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY along, id) AS r FROM p WHERE abs(across) <= 60 AND along >= 0 AND along <= 3000) WHERE r = 1""")
def signs_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, kind="CASE o_orderkey % 2 WHEN 0 THEN 'gantry' ELSE 'panel' END", lon="4.7 + (o_orderkey * 7 % 1009) / 50000.0D", lat="52.5 + (o_custkey * 11 % 1013) / 50000.0D")
    return ahead.next_signs(rows, {"lon": 4.71, "lat": 52.51, "heading": 30.0}).select("kind", "id", F.round("along", 6).alias("along"))


@query("""WITH t AS (SELECT o_orderkey AS id, (470000 + o_orderkey * 7919 % 3001)::DOUBLE / 100000 AS lon, (5250000 + o_orderkey * 104729 % 3011)::DOUBLE / 100000 AS lat,
CASE WHEN o_orderkey % 5 <> 0 THEN radians((o_orderkey * 37 % 360)::DOUBLE) END AS h FROM orders),
m AS (SELECT *, CASE WHEN h IS NULL THEN 2500 ELSE greatest(2500 * sin(h), -700 * sin(h)) + 700 * abs(cos(h)) END AS e, CASE WHEN h IS NULL THEN 2500 ELSE greatest(-2500 * sin(h), 700 * sin(h)) + 700 * abs(cos(h)) END AS w,
CASE WHEN h IS NULL THEN 2500 ELSE greatest(2500 * cos(h), -700 * cos(h)) + 700 * abs(sin(h)) END AS n, CASE WHEN h IS NULL THEN 2500 ELSE greatest(-2500 * cos(h), 700 * cos(h)) + 700 * abs(sin(h)) END AS s FROM t)
SELECT id, round(lon - w / (111320 * cos(radians(lat))), 6) AS min_lon, round(lat - s / 111320, 6) AS min_lat, round(lon + e / (111320 * cos(radians(lat))), 6) AS max_lon, round(lat + n / 111320, 6) AS max_lat FROM m""")
def forward_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, lon="CAST(470000 + o_orderkey * 7919 % 3001 AS DOUBLE) / 100000", lat="CAST(5250000 + o_orderkey * 104729 % 3011 AS DOUBLE) / 100000", h="CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey * 37 % 360 AS DOUBLE) END")
    box = geo.forward_box("lon", "lat", "h")
    return rows.select("id", *[v.alias(k) for k, v in zip(("min_lon", "min_lat", "max_lon", "max_lat"), box, strict=True)])


@query("""WITH t AS (SELECT o_orderkey AS id, (o_orderkey % 50 + 10)::DOUBLE AS leg, (o_orderkey % 1001)::DOUBLE / 1000 AS f, unnest([0.001, 0.0333])::DOUBLE AS s FROM orders),
d AS (SELECT id, s, greatest(f - s, 0) AS a, least(f + s, 1) AS b, leg FROM t)
SELECT id, s AS span, round(CASE WHEN b <= 0.5 THEN 90 WHEN a >= 0.5 THEN 0 ELSE degrees(atan2(leg - 2 * leg * a, 2 * leg * b - leg)) END, 5) AS bearing FROM d""")
def bearings_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of two equal legs, east and then north, for each order: the bearing turns around the bend."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rows = _orders(spark, sf_dir, leg="CAST(o_orderkey % 50 + 10 AS DOUBLE)", f="CAST(o_orderkey % 1001 AS DOUBLE) / 1000")
    rows = rows.withColumn("line", F.array(at(F.lit(5.0), F.lit(7.0)), at(C("leg") + 5, F.lit(7.0)), at(C("leg") + 5, C("leg") + 7)))
    of = lambda span: rows.select("id", F.lit(span).alias("span"), F.round(geo.bearing_at("line", "f", span), 5).alias("bearing"))
    return of(0.001).unionByName(of(0.0333))
