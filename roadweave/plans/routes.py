"""Registered queries for the list routes, with SQL written from the routes' rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routes
from ..session import table
from .details import BOX

C = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _lon(k: str) -> str:
    return f"CAST(470000 + ({k}) * 7919 % 3001 AS DOUBLE) / 100000"


def _lat(k: str) -> str:
    return f"CAST(5250000 + ({k}) * 104729 % 3011 AS DOUBLE) / 100000"


def _within(lon: str, lat: str, box=BOX) -> str:
    return f"{lon} BETWEEN CAST({box[0]!r} AS DOUBLE) AND CAST({box[2]!r} AS DOUBLE) AND {lat} BETWEEN CAST({box[1]!r} AS DOUBLE) AND CAST({box[3]!r} AS DOUBLE)"


def _columns(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).select(*[F.expr(e).alias(c) for c, e in columns.items()])


def _select(columns: dict[str, str], name: str) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {name}"


# speeds: three sensors stand at each point; orders are their readings. The expressions mean the same in both engines.

J, K = "(c_custkey - c_custkey % 3)", "c_custkey"
SITES = {
    "site_id": f"concat('NL_', CASE {K} % 3 WHEN 0 THEN 'MONIBAS' WHEN 1 THEN 'MONICA' ELSE 'PROV' END, '_', CAST({K} AS VARCHAR(20)))",
    "name": f"concat('A1 ', CASE {K} % 9 WHEN 0 THEN 'hrL' WHEN 1 THEN 'hrR' WHEN 2 THEN 'vwb' ELSE '' END)",
    "lon": _lon(J),
    "lat": _lat(J),
    "road": f"CASE WHEN {K} % 5 > 1 THEN concat('A', CAST({J} % 20 AS VARCHAR(20))) END",
    "carriageway": f"CASE WHEN {K} % 5 > 1 AND {K} % 7 <> 0 THEN CASE WHEN {K} % 10 < 6 THEN 'R' ELSE 'L' END END",
    "carriageway_source": f"CASE WHEN {K} % 5 > 1 AND {K} % 7 <> 0 THEN CASE WHEN {K} % 4 = 0 THEN 'name' ELSE 'extension' END END",
    "tmc_direction": f"CASE {J} % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' END",
    "side": f"CASE WHEN {J} % 8 = 0 THEN 'northBound' END",
    "km": f"CASE WHEN {K} % 3 <> 0 THEN CAST({K} % 1000 AS DOUBLE) / 10 END",
    "num_lanes": f"CAST({K} % 5 AS INT)",
    "openlr_bearing": f"CASE WHEN {K} % 4 = 1 THEN CAST({K} * 37 % 720 AS INT) END",
    "vild_bearing": f"CASE WHEN {K} % 8 = 0 THEN CAST({K} * 31 % 360 AS DOUBLE) END",
    "tmc_primary": f"CASE WHEN {K} % 2 = 0 THEN CAST({K} % 30 AS INT) END",
}
CHAINS = {"loc_nr": "n_nationkey", "road_number": "CASE WHEN n_nationkey % 3 <> 0 THEN concat('N', CAST(n_nationkey AS VARCHAR(20))) END", "hecto_dir": "n_regionkey"}
MEASUREMENTS = {
    "site_id": SITES["site_id"].replace(K, "o_custkey"),
    "index": "CAST(o_orderkey % 4 AS INT)",
    "value_type": "CASE WHEN o_orderkey % 12 < 4 THEN 'TrafficFlow' ELSE 'TrafficSpeed' END",
    "speed_kmh": "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 7 % 130 AS DOUBLE) END",
    "flow_veh_h": "CAST(o_orderkey * 13 % 2000 AS DOUBLE)",
    "n_inputs": "CAST(o_orderkey % 10 AS INT)",
    "std_dev": "CAST(o_orderkey % 97 AS DOUBLE) / 4",
    "measured_at": "CASE WHEN o_orderkey % 17 <> 0 THEN date_trunc('month', o_orderdate) END",
}
CHARACTERISTICS = {
    "site_id": SITES["site_id"],
    "index": "index",
    "lane": f"CASE WHEN ({K} + index) % 5 <> 0 THEN index % 3 + 1 END",
    "veh_length_min": f"CASE WHEN ({K} + index) % 7 = 0 THEN 560 END",
    "veh_length_max": f"CASE WHEN ({K} + index) % 11 = 0 THEN 560 END",
}

USABLE = f"""st AS ({_select(SITES, "customer")}), v AS ({_select(CHAINS, "nation")}), ms AS ({_select(MEASUREMENTS, "orders")}),
ch AS ({_select(CHARACTERISTICS, "customer, (SELECT unnest([0, 1, 2, 3])::INTEGER AS index)")}),
u AS (SELECT ms.*, ch.lane FROM ms JOIN ch ON ms.site_id = ch.site_id AND ms.index = ch.index WHERE ch.lane IS NOT NULL AND ch.veh_length_min IS NULL AND ch.veh_length_max IS NULL)"""


def _speed_sql(scope: str, order: str, limit: int, clip: str) -> str:
    return f"""WITH {USABLE},
c AS (SELECT *, row_number() OVER (ORDER BY {order}) AS seq FROM st WHERE ({scope}) AND site_id IN (SELECT site_id FROM u) ORDER BY seq LIMIT {6 * limit}),
r AS (SELECT site_id, lane, max(CASE WHEN value_type = 'TrafficSpeed' THEN speed_kmh END) AS speed, max(CASE WHEN value_type = 'TrafficFlow' THEN flow_veh_h END) AS flow,
  max(CASE WHEN value_type = 'TrafficSpeed' THEN n_inputs END) AS n_inputs, max(CASE WHEN value_type = 'TrafficSpeed' THEN std_dev END) AS std_dev, max(measured_at) AS ts FROM u GROUP BY 1, 2),
k AS (SELECT lon, lat, side, tmc_direction, any_value(road) AS road, max(carriageway) AS carriageway, max(carriageway_source) AS carriageway_source
  FROM (SELECT DISTINCT lon, lat, side, tmc_direction, road, carriageway, carriageway_source FROM c WHERE road IS NOT NULL) GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
e AS (SELECT c.*, v.hecto_dir, coalesce(c.road, v.road_number, k.road) AS eroad,
  CASE WHEN coalesce(c.road, v.road_number) IS NULL AND k.road IS NOT NULL THEN k.carriageway ELSE c.carriageway END AS eway,
  CASE WHEN coalesce(c.road, v.road_number) IS NULL AND k.road IS NOT NULL THEN k.carriageway_source ELSE c.carriageway_source END AS esource,
  CASE WHEN c.name LIKE '%hrL%' THEN 'Li' WHEN c.name LIKE '%hrR%' THEN 'Re' WHEN c.name LIKE '%vwb%' THEN 'b' END AS rw
  FROM c LEFT JOIN v ON c.tmc_primary = v.loc_nr LEFT JOIN k ON k.lon = c.lon AND k.lat = c.lat AND k.side IS NOT DISTINCT FROM c.side AND k.tmc_direction IS NOT DISTINCT FROM c.tmc_direction),
g AS (SELECT *, dense_rank() OVER (ORDER BY lon, lat, eroad, coalesce(eway, tmc_direction), side) AS loc FROM e),
l AS (SELECT loc, min(seq) AS s1, min(CASE WHEN road IS NOT NULL AND km IS NOT NULL THEN seq END) AS s2, max(CASE WHEN road IS NOT NULL THEN seq END) AS s3, min(CASE WHEN openlr_bearing IS NOT NULL THEN seq END) AS s4,
  nullif(max(num_lanes), 0) AS num_lanes, count(*) AS source_count, coalesce(min(CASE WHEN contains(site_id, '_MONIBAS_') THEN site_id END), min(site_id)) AS site_id,
  CASE WHEN min(rw) = max(rw) THEN min(rw) END AS roadway, array_to_string(list_sort(list_distinct(list(split_part(site_id, '_', 2)))), ',') AS systems FROM g GROUP BY loc),
p AS (SELECT l.*, count(*) OVER () > {limit} AS truncated FROM l ORDER BY s1 LIMIT {limit}),
m0 AS (SELECT g.loc, g.seq, r.* FROM g JOIN r ON g.site_id = r.site_id),
m AS (SELECT *, max(CASE WHEN speed <> 0 THEN ts END) OVER (PARTITION BY loc, lane) AS last, row_number() OVER (PARTITION BY loc, lane ORDER BY ts DESC NULLS LAST, seq) AS n FROM m0),
a AS (SELECT loc, lane, any_value(last) AS last, avg(speed) FILTER (speed <> 0 AND ts = last) AS speed, avg(flow) FILTER (speed <> 0 AND ts = last) AS flow, sum(n_inputs) FILTER (speed <> 0 AND ts = last) AS n_inputs, avg(std_dev) FILTER (speed <> 0 AND ts = last) AS std_dev FROM m GROUP BY 1, 2),
x AS (SELECT a.loc, a.lane, CASE WHEN a.last IS NOT NULL THEN round(a.speed, 1) ELSE m.speed END AS speed, CASE WHEN a.last IS NOT NULL THEN round(a.flow, 0) ELSE m.flow END AS flow, CASE WHEN a.last IS NOT NULL THEN a.n_inputs ELSE m.n_inputs END::BIGINT AS n_inputs,
  CASE WHEN a.last IS NOT NULL THEN round(a.std_dev, 2) ELSE m.std_dev END AS std_dev, coalesce(a.last, m.ts) AS ts FROM a JOIN m ON a.loc = m.loc AND a.lane = m.lane AND m.n = 1)
SELECT f.lon, f.lat, f.eroad AS road, f.side, CASE WHEN q.seq = p.s1 THEN f.eway ELSE q.carriageway END AS carriageway, CASE WHEN q.seq = p.s1 THEN f.esource ELSE q.carriageway_source END AS carriageway_source, q.km,
  f.tmc_direction, f.hecto_dir, f.vild_bearing, o.openlr_bearing, p.num_lanes, p.roadway, p.truncated, p.site_id, p.source_count::INTEGER AS source_count, p.systems, x.lane, x.speed, x.flow, x.n_inputs, x.std_dev,
  max(x.ts) OVER (PARTITION BY x.loc) AS measured_at
FROM p JOIN g f ON f.seq = p.s1 JOIN g q ON q.seq = CASE WHEN f.km IS NOT NULL THEN p.s1 ELSE coalesce(p.s2, p.s3, p.s1) END LEFT JOIN g o ON o.seq = p.s4 JOIN x ON x.loc = p.loc {clip}"""


def _speed_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    of_lanes = table(spark, sf_dir, "customer").withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return _columns(spark, sf_dir, "orders", MEASUREMENTS), _columns(spark, sf_dir, "customer", SITES), of_lanes.select(*[F.expr(e).alias(c) for c, e in CHARACTERISTICS.items()]), _columns(spark, sf_dir, "nation", CHAINS)


def _a_row_a_lane(found: DataFrame) -> DataFrame:
    rows = found.withColumns({"_lane": F.explode("lanes"), "systems": F.array_join("systems", ",")})
    return rows.select(*[c for c in found.columns if c not in ("lanes", "seq")], "_lane.*")


@query(f"WITH {USABLE} SELECT site_id, index, value_type, lane, count(*) AS n, max(speed_kmh) AS speed FROM u GROUP BY 1, 2, 3, 4")
def usable_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _, ch, _ = _speed_tables(spark, sf_dir)
    return routes.usable_readings(m, ch).groupBy("site_id", "index", "value_type", "lane").agg(F.count(F.lit(1)).alias("n"), F.max("speed_kmh").alias("speed"))


@query(_speed_sql("true", "km NULLS LAST, site_id", 400, ""))
def route_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s, ch, v = _speed_tables(spark, sf_dir)
    return _a_row_a_lane(routes.speed_locations(m, s, ch, v, 400, by_km=True))


@query(_speed_sql(_within("lon", "lat", routes.widened(BOX)), "site_id", 1000, "WHERE " + _within("f.lon", "f.lat")))
def route_speed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s, ch, v = _speed_tables(spark, sf_dir)
    found = routes.speed_locations(m, s.where(_within("lon", "lat", routes.widened(BOX))), ch, v, 1000, by_km=False)
    return _a_row_a_lane(found.where(_within("lon", "lat")))


SECTIONS = {
    "section": "p_partkey",
    "ax": "CAST(470000 + p_partkey * 7907 % 3000 AS DOUBLE) / 100000",
    "ay": "CAST(5250000 + p_partkey * 104723 % 3000 AS DOUBLE) / 100000",
    "bx": "CAST(470000 + p_partkey * 7907 % 3000 + p_partkey % 7 * 10 AS DOUBLE) / 100000",
    "by": "CAST(5250000 + p_partkey * 104723 % 3000 + p_partkey % 11 * 10 AS DOUBLE) / 100000",
}


@query(f"""WITH s AS ({_select(SITES, "customer")}), l AS ({_select(SECTIONS, "part")}),
t AS (SELECT s.*, l.*, CASE WHEN bx = ax AND "by" = ay THEN 0.0 ELSE greatest(0.0, least(1.0, ((lon - ax) * (bx - ax) + (lat - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) END AS f FROM s, l WHERE vild_bearing IS NULL AND openlr_bearing IS NULL),
n AS (SELECT site_id, section, ax, ay, bx, "by", row_number() OVER (PARTITION BY site_id ORDER BY sqrt((ax + f * (bx - ax) - lon) ** 2 + (ay + f * ("by" - ay) - lat) ** 2), section) AS k FROM t)
SELECT s.site_id, CASE WHEN vild_bearing IS NOT NULL THEN vild_bearing WHEN openlr_bearing IS NOT NULL THEN openlr_bearing % 360 WHEN ax <> bx OR ay <> "by" THEN round((degrees(atan2(bx - ax, "by" - ay)) + 360) % 360, 1) END::DOUBLE AS bearing,
CASE WHEN vild_bearing IS NOT NULL THEN 'vild' WHEN openlr_bearing IS NOT NULL THEN 'openlr' ELSE 'meetlocatie_vak' END AS bearing_source FROM s LEFT JOIN n ON s.site_id = n.site_id AND n.k = 1""")
def fallback_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _columns(spark, sf_dir, "customer", SITES).select("site_id", "lon", "lat", "vild_bearing", "openlr_bearing")
    return routes.fallback_bearings(sites, _columns(spark, sf_dir, "part", SECTIONS), "site_id").select("site_id", "bearing", "bearing_source")


SIGNS = {
    "uuid": f"concat('u', CAST({K} AS VARCHAR(20)))",
    "lon": _lon(K),
    "lat": _lat(K),
    "road": f"CASE WHEN {K} % 13 <> 0 THEN concat('A', CAST({K} % 3 AS VARCHAR(20))) END",
    "carriageway": f"CASE WHEN {K} % 7 <> 0 THEN CASE WHEN {K} % 2 = 0 THEN 'R' ELSE 'L' END END",
    "lane": f"CAST({K} % 3 + 1 AS INT)",
    "km": f"CASE WHEN {K} % 17 <> 0 THEN CAST({K} % 9 AS DOUBLE) / 10 END",
}
ASSIGNMENTS = {"uuid": "concat('u', CAST(p_partkey AS VARCHAR(20)))", "match_status": "CASE p_size % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'ambiguous' ELSE 'unmatched' END", "match_confidence": "p_brand"}
LINKS = {
    "uuid": ASSIGNMENTS["uuid"],
    "link_index": "link_index",
    "matched_road_id": "CAST(p_size + link_index AS INT)",
    "matched_lon": "CASE WHEN p_size % 4 <> 0 THEN CAST(470000 + p_partkey % 3000 AS DOUBLE) / 100000 END",
    "matched_lat": "CASE WHEN p_size % 4 <> 0 THEN CAST(5250000 + p_partkey % 3000 AS DOUBLE) / 100000 END",
}


@query(f"""WITH s AS ({_select(SIGNS, "customer")}), a AS ({_select(ASSIGNMENTS, "part")}), l AS ({_select(LINKS, "part, (SELECT unnest([0, 1])::INTEGER AS link_index)")}),
t AS (SELECT 'u' || o_custkey::VARCHAR AS uuid, max(o_orderdate) AS ts_state, count(*) AS value FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
r AS (SELECT s.*, ts_state, value, row_number() OVER (PARTITION BY road, carriageway, lane, round(km, 2) ORDER BY ts_state DESC NULLS LAST, s.uuid) AS g FROM s LEFT JOIN t ON s.uuid = t.uuid WHERE {_within("lon", "lat")}),
p AS (SELECT * FROM r WHERE g = 1 ORDER BY uuid LIMIT 300)
SELECT p.uuid, road, carriageway, lane, km, ts_state, value, 'matrix-gantry-' || substr(sha256('matrix:' || coalesce(road, '') || '|' || coalesce(carriageway, '') || '|' || coalesce(round(km, 2)::VARCHAR, '')), 1, 16) AS gantry_id, match_status, match_confidence, matched_road_id, n_name AS matched_road_name,
CASE WHEN match_status = 'matched' AND matched_lon IS NOT NULL THEN matched_lon ELSE lon END AS lon, CASE WHEN match_status = 'matched' AND matched_lon IS NOT NULL THEN matched_lat ELSE lat END AS lat
FROM p LEFT JOIN a ON a.uuid = p.uuid LEFT JOIN l ON l.uuid = p.uuid AND l.link_index = 0 LEFT JOIN nation ON n_nationkey = matched_road_id""")
def route_matrix_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").groupBy(F.concat(F.lit("u"), C("o_custkey").cast("string")).alias("uuid"))
    states = orders.agg(F.max("o_orderdate").alias("ts_state"), F.count(F.lit(1)).alias("value"))
    links = table(spark, sf_dir, "part").withColumn("link_index", F.explode(F.sequence(F.lit(0), F.lit(1)))).select(*[F.expr(e).alias(c) for c, e in LINKS.items()])
    roads = table(spark, sf_dir, "nation").select(C("n_nationkey").alias("osm_id"), C("n_name").alias("matched_road_name"))
    return routes.matrix_signs(_columns(spark, sf_dir, "customer", SIGNS), states, _columns(spark, sf_dir, "part", ASSIGNMENTS), links, roads, BOX, 300, "best")


def _meets(box=BOX) -> str:
    a, b, c, d = (f"CAST({v!r} AS DOUBLE)" for v in box)
    corners = [f'(bx - ax) * ({y} - ay) - ("by" - ay) * ({x} - ax)' for x in (a, c) for y in (b, d)]
    return f'least(ax, bx) <= {c} AND greatest(ax, bx) >= {a} AND least(ay, "by") <= {d} AND greatest(ay, "by") >= {b} AND least({", ".join(corners)}) <= 0 AND greatest({", ".join(corners)}) >= 0'


LANES = {"id": "p_partkey", "road_id": "p_partkey", "lane_nr": "CAST(p_partkey % (p_size % 4 + 1) + 1 AS INT)", "lane_count": "CAST(p_size % 4 + 1 AS INT)"} | {c: e for c, e in SECTIONS.items() if c != "section"}
CONNECTIONS = {
    "id": "l_orderkey * 10 + l_linenumber",
    "from_lane_id": "l_partkey",
    "to_lane_id": "(l_partkey * 7 + l_suppkey) % 2500",
    "ax": "CAST(470000 + l_partkey * 31 % 3000 AS DOUBLE) / 100000",
    "ay": "CAST(5250000 + l_orderkey * 57 % 3000 AS DOUBLE) / 100000",
    "bx": "CAST(470030 + l_partkey * 31 % 3000 AS DOUBLE) / 100000",
    "by": "CAST(5250020 + l_orderkey * 57 % 3000 AS DOUBLE) / 100000",
}


@query(f"""WITH l AS ({_select(LANES, "part")}), c AS ({_select(CONNECTIONS, "lineitem")}),
sl AS (SELECT l.*, c_name AS name FROM l JOIN customer ON c_custkey = road_id WHERE {_meets()}), sc AS (SELECT c.*, f.lane_nr AS fn, f.lane_count AS fc, t.lane_nr AS tn, t.lane_count AS tc FROM (SELECT * FROM c WHERE {_meets()}) c JOIN l f ON f.id = from_lane_id JOIN l t ON t.id = to_lane_id)
SELECT * FROM (SELECT 'lane' AS kind, id, name, lane_nr, lane_count, NULL::BIGINT AS from_lane_id, NULL::BIGINT AS to_lane_id, NULL::INTEGER AS from_lane_nr, NULL::INTEGER AS from_lane_count, NULL::INTEGER AS to_lane_nr, NULL::INTEGER AS to_lane_count, count(*) OVER () > 150 AS truncated FROM sl ORDER BY id LIMIT 150)
UNION ALL SELECT * FROM (SELECT 'connection', id, NULL, NULL, NULL, from_lane_id, to_lane_id, fn, fc, tn, tc, count(*) OVER () > 500 FROM sc ORDER BY id LIMIT 500)""")
def route_lane_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = table(spark, sf_dir, "customer").select(C("c_custkey").alias("road_id"), C("c_name").alias("name"))
    lanes, connections = routes.lane_lines(_columns(spark, sf_dir, "part", LANES), _columns(spark, sf_dir, "lineitem", CONNECTIONS), roads, BOX, 150, 500)
    drop = ["ax", "ay", "bx", "by", "road_id"]
    return lanes.drop(*drop).withColumn("kind", F.lit("lane")).unionByName(connections.drop(*drop).withColumn("kind", F.lit("connection")), allowMissingColumns=True)


ROADS = {"osm_id": "p_partkey"} | {c: e for c, e in SECTIONS.items() if c != "section"}
SMALL_BOX = (4.705, 52.505, 4.707, 52.507)


def _nodes(key: Column) -> Column:
    return F.array(key * 13 % 1999, key * 29 % 1999)


@query(f"""WITH r AS ({_select(ROADS, "part")}), n AS (SELECT p_partkey AS osm_id, unnest([p_partkey * 13 % 1999, p_partkey * 29 % 1999]) AS node FROM part),
s AS (SELECT * FROM r WHERE ({_meets(SMALL_BOX)}) OR osm_id IN (SELECT r_regionkey + 1 FROM region) OR osm_id IN (SELECT r_regionkey * 7 + 3 FROM region)),
e AS (SELECT min(least(ax, bx)) - 0.0005::DOUBLE AS a, min(least(ay, "by")) - 0.0005::DOUBLE AS b, max(greatest(ax, bx)) + 0.0005::DOUBLE AS c, max(greatest(ay, "by")) + 0.0005::DOUBLE AS d FROM s),
x AS (SELECT r.* FROM r, e WHERE least(ax, bx) <= c AND greatest(ax, bx) >= a AND least(ay, "by") <= d AND greatest(ay, "by") >= b
  AND least((bx - ax) * (b - ay) - ("by" - ay) * (a - ax), (bx - ax) * (d - ay) - ("by" - ay) * (a - ax), (bx - ax) * (b - ay) - ("by" - ay) * (c - ax), (bx - ax) * (d - ay) - ("by" - ay) * (c - ax)) <= 0
  AND greatest((bx - ax) * (b - ay) - ("by" - ay) * (a - ax), (bx - ax) * (d - ay) - ("by" - ay) * (a - ax), (bx - ax) * (b - ay) - ("by" - ay) * (c - ax), (bx - ax) * (d - ay) - ("by" - ay) * (c - ax)) >= 0)
SELECT osm_id, osm_id IN (SELECT osm_id FROM s) AS selected FROM r WHERE osm_id IN (SELECT osm_id FROM s) OR osm_id IN (SELECT osm_id FROM x)
OR osm_id IN (SELECT osm_id FROM n WHERE node IN (SELECT node FROM n WHERE osm_id IN (SELECT osm_id FROM s))) OR osm_id IN (SELECT n_nationkey + 150 FROM nation)""")
def context_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads = _columns(spark, sf_dir, "part", ROADS).withColumn("node_refs", _nodes(C("osm_id")))
    region = table(spark, sf_dir, "region")
    selected = routes.selected_roads(roads, SMALL_BOX, region.select(C("r_regionkey") + 1), region.select(F.concat((C("r_regionkey") * 7 + 3).cast("string"), F.lit(":fwd"))))
    found = routes.context_roads(roads, selected, 0.0005, table(spark, sf_dir, "nation").select((C("n_nationkey") + 150).cast("long").alias("osm_id")))
    return found.join(selected.select("osm_id", F.lit(True).alias("selected")), "osm_id", "left").select("osm_id", F.coalesce("selected", F.lit(False)).alias("selected"))


@query(f"""WITH a AS (SELECT event_id AS record_id, 'roadworks' AS category, {_lon("event_id")} AS lon, {_lat("event_id")} AS lat, user_id AS cause, NULL::DOUBLE AS severity FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 'incident', {_lon("event_id")}, {_lat("event_id")}, NULL, value FROM events WHERE event_type = 'view')
SELECT * FROM a WHERE {_within("lon", "lat")} ORDER BY record_id, category LIMIT 400""")
def route_situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {"record_id": "event_id", "lon": _lon("event_id"), "lat": _lat("event_id")}
    e = table(spark, sf_dir, "events")
    feed = lambda kind, own: e.where(C("event_type") == kind).select(*[F.expr(x).alias(c) for c, x in (at | own).items()])
    return routes.situations({"roadworks": feed("click", {"cause": "user_id"}), "incident": feed("view", {"severity": "value"})}, BOX, 400)


@query(f"""WITH p AS (SELECT o_orderkey AS id, {_lon("o_orderkey")} AS lon, {_lat("o_orderkey")} AS lat FROM orders), c AS (SELECT l_orderkey AS cp_id, l_linenumber AS idx, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS available FROM lineitem),
q AS (SELECT * FROM p WHERE {_within("lon", "lat")} AND id IN (SELECT cp_id FROM c WHERE available > 0) ORDER BY id LIMIT 500)
SELECT id, lon, lat, (SELECT string_agg(idx::VARCHAR || ':' || available::VARCHAR, ',' ORDER BY idx, available) FROM c WHERE cp_id = id) AS connectors FROM q""")
def route_charging(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _columns(spark, sf_dir, "orders", {"id": "o_orderkey", "lon": _lon("o_orderkey"), "lat": _lat("o_orderkey")})
    connectors = _columns(spark, sf_dir, "lineitem", {"cp_id": "l_orderkey", "idx": "l_linenumber", "available": "CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END"})
    text = F.array_join(F.transform("connectors", lambda c: F.concat(c["idx"].cast("string"), F.lit(":"), c["available"].cast("string"))), ",")
    return routes.charge_points(points, connectors, BOX, 500, available=True).withColumn("connectors", text)


@query(f"""SELECT id, name, lon, lat, vacant, occupancy_pct FROM (SELECT c_custkey AS id, c_name AS name, {_lon(K)} AS lon, {_lat(K)} AS lat FROM customer WHERE {_within(_lon(K), _lat(K))} ORDER BY id LIMIT 400) p
LEFT JOIN (SELECT s_suppkey AS parking, s_nationkey AS vacant, s_acctbal AS occupancy_pct FROM supplier) s ON id = parking""")
def route_truck_parkings(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _columns(spark, sf_dir, "customer", {"id": K, "name": "c_name", "lon": _lon(K), "lat": _lat(K)})
    status = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("parking_id"), C("s_nationkey").alias("vacant"), C("s_acctbal").alias("occupancy_pct"))
    return routes.parkings(places, status, BOX, 400)


CLASSES = "CASE p_partkey % 5 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' ELSE 'motorway_link' END"


@query(f"""WITH r AS ({_select(ROADS | {"highway": CLASSES}, "part")})
SELECT osm_id, highway, count(*) OVER () > 120 AS truncated FROM r WHERE highway IN ('motorway', 'motorway_link', 'trunk', 'trunk_link', 'primary', 'primary_link') AND {_meets()} ORDER BY osm_id LIMIT 120""")
def route_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.roads_in_view(_columns(spark, sf_dir, "part", ROADS | {"highway": CLASSES}), BOX, 10.5, 120).select("osm_id", "highway", "truncated")


@query(f"""WITH a AS ({_select(ASSIGNMENTS, "part")}), l AS ({_select(LINKS, "part, (SELECT 0::INTEGER AS link_index)")})
SELECT uuid, json_object('uuid', uuid, 'status', match_status, 'road_id', CASE WHEN match_status = 'matched' THEN matched_road_id END, 'matched_point', CASE WHEN matched_lon IS NOT NULL THEN [matched_lon, matched_lat] END)::VARCHAR AS result FROM a JOIN l USING (uuid)""")
def match_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "part").withColumn("link_index", F.lit(0)).select(*[F.expr(e).alias(c) for c, e in LINKS.items()])
    rows = _columns(spark, sf_dir, "part", ASSIGNMENTS).join(links, "uuid").withColumns({"status": C("match_status"), "road_id": F.when(C("match_status") == "matched", C("matched_road_id"))})
    return rows.select("uuid", routes.match_json(["uuid", "status", "road_id"]).alias("result"))


_CROSS = " AND ".join(["least(lon, lon2) <= {2!r}", "greatest(lon, lon2) >= {0!r}", "least(lat, lat2) <= {3!r}", "greatest(lat, lat2) >= {1!r}"]).format(*BOX)
_SIDES = ", ".join(f"(lon2 - lon) * ({y!r} - lat) - (lat2 - lat) * ({x!r} - lon)" for x in (BOX[0], BOX[2]) for y in (BOX[1], BOX[3]))


@query(f"""WITH s AS (SELECT c_custkey AS id, {_lon("c_custkey")} AS lon, {_lat("c_custkey")} AS lat, c_custkey % 3 > 0 AS lined FROM customer),
p AS (SELECT *, lon + (id % 41 - 20) * 0.0005::DOUBLE AS lon2, lat + (id % 37 - 18) * 0.0005::DOUBLE AS lat2 FROM s),
m AS (SELECT id FROM p WHERE CASE WHEN lined THEN {_CROSS} AND least({_SIDES}) <= 0 AND greatest({_SIDES}) >= 0 ELSE {_within("lon", "lat")} END)
SELECT o_custkey AS segment_id, o_orderkey AS index, round(o_totalprice / 1000, 2) AS duration_s, o_custkey::VARCHAR || ':' || o_orderkey::VARCHAR AS fid FROM orders JOIN m ON m.id = o_custkey ORDER BY segment_id, index LIMIT 5000""")
def route_travel_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of all customers, two thirds of them with a line, and the travel times of their orders."""
    sites = _columns(spark, sf_dir, "customer", {"id": "c_custkey", "lon": _lon("c_custkey"), "lat": _lat("c_custkey")})
    far = F.struct((C("lon") + (C("id") % 41 - 20) * 0.0005).alias("x"), (C("lat") + (C("id") % 37 - 18) * 0.0005).alias("y"))
    sites = sites.withColumn("line", F.when(C("id") % 3 > 0, F.array(F.struct(C("lon").alias("x"), C("lat").alias("y")), far)))
    times = _columns(spark, sf_dir, "orders", {"segment_id": "o_custkey", "index": "o_orderkey", "duration_s": "round(o_totalprice / 1000, 2)"})
    return routes.travel_times(times, sites, BOX, 5000).select("segment_id", "index", "duration_s", "fid")


PANELS = {
    "controller_id": f"concat('DRIP ', CAST({K} - {K} % 3 AS VARCHAR(20)))",
    "vms_index": f"CAST({K} % 3 AS INT)",
    "lon": _lon(K),
    "lat": _lat(K),
    "bearing": f"CASE WHEN {K} % 5 <> 0 THEN CAST({K} * 7 % 360 AS INT) END",
    "display_text": "c_mktsegment",
}
PANEL_KEY = "concat('[\"DRIP ', CAST(p_partkey - p_partkey % 3 AS VARCHAR(20)), '\",', CAST(p_partkey % 3 AS VARCHAR(20)), ']')"
PANEL_MATCH = {"source_key": PANEL_KEY} | {c: e for c, e in ASSIGNMENTS.items() if c != "uuid"}
PANEL_LINKS = {"source_key": PANEL_KEY} | {c: e for c, e in LINKS.items() if c != "uuid"} | {"matched_direction": "CASE WHEN p_size % 2 = 0 THEN 'fwd' ELSE 'bwd' END"}


@query(f"""WITH d AS ({_select(PANELS, "customer")}), a AS ({_select(PANEL_MATCH, "part")}), l AS ({_select(PANEL_LINKS, "part, (SELECT unnest([0, 1])::INTEGER AS link_index)")}),
p AS (SELECT *, '["' || controller_id || '",' || vms_index::VARCHAR || ']' AS source_key FROM d WHERE {_within("lon", "lat")} ORDER BY controller_id, vms_index LIMIT 2000)
SELECT controller_id, vms_index, bearing, display_text, match_status, match_confidence, matched_road_id, matched_direction, n_name AS matched_road_name,
CASE WHEN match_status = 'matched' AND matched_lon IS NOT NULL THEN matched_lon ELSE lon END AS lon, CASE WHEN match_status = 'matched' AND matched_lon IS NOT NULL THEN matched_lat ELSE lat END AS lat
FROM p LEFT JOIN a ON a.source_key = p.source_key LEFT JOIN l ON l.source_key = p.source_key AND l.link_index = 0 LEFT JOIN nation ON n_nationkey = matched_road_id""")
def route_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of all customers, with the matches and links of all parts."""
    links = table(spark, sf_dir, "part").withColumn("link_index", F.explode(F.sequence(F.lit(0), F.lit(1)))).select(*[F.expr(e).alias(c) for c, e in PANEL_LINKS.items()])
    roads = table(spark, sf_dir, "nation").select(C("n_nationkey").alias("osm_id"), C("n_name").alias("matched_road_name"))
    return routes.panels(_columns(spark, sf_dir, "customer", PANELS), _columns(spark, sf_dir, "part", PANEL_MATCH), links, roads, BOX, 2000, "best")


CODES = {"id": "o_orderkey", "lon": _lon("o_orderkey"), "lat": _lat("o_orderkey")}
AREAS = {"id": K, "lon": _lon(K), "lat": _lat(K), "lon2": f"{_lon(K)} + CAST({K} % 400 + 1 AS DOUBLE) / 100000", "lat2": f"{_lat(K)} + CAST({K} % 300 + 1 AS DOUBLE) / 100000"}


@query(f"""WITH p AS (SELECT *, CASE WHEN id % 3 <> 0 THEN id % 10 END AS level FROM ({_select(CODES, "orders")})), l AS ({_select(ROADS, "part")}), a AS ({_select(AREAS, "customer")})
SELECT * FROM (SELECT 'point' AS shape, id, 'id:' || id::VARCHAR || CASE WHEN level IS NOT NULL THEN ',level:' || level::VARCHAR ELSE '' END AS properties FROM p WHERE {_within("lon", "lat")} ORDER BY id LIMIT 2000)
UNION ALL SELECT * FROM (SELECT 'line', osm_id, 'id:other' FROM l WHERE {_meets()} ORDER BY osm_id LIMIT 2000)
UNION ALL SELECT * FROM (SELECT 'area', id, 'id:' || id::VARCHAR FROM a WHERE lon <= {BOX[2]!r}::DOUBLE AND lon2 >= {BOX[0]!r}::DOUBLE AND lat <= {BOX[3]!r}::DOUBLE AND lat2 >= {BOX[1]!r}::DOUBLE ORDER BY id LIMIT 2000)""")
def route_location_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of all orders, lines of all parts (whose raw values carry an id), rectangles of all customers (without raw values)."""
    at = lambda x, y: F.struct(C(x).alias("x"), C(y).alias("y"))
    level = F.when(C("id") % 3 != 0, (C("id") % 10).cast("string"))
    points = _columns(spark, sf_dir, "orders", CODES).withColumn("raw", F.create_map(F.lit("level"), level))
    lines = _columns(spark, sf_dir, "part", ROADS).withColumns({"line": F.array(at("ax", "ay"), at("bx", "by")), "raw": F.create_map(F.lit("id"), F.lit("other"))}).withColumnRenamed("osm_id", "id")
    ring = F.array(at("lon", "lat"), at("lon2", "lat"), at("lon2", "lat2"), at("lon", "lat2"))
    areas = _columns(spark, sf_dir, "customer", AREAS).withColumns({"ring": ring, "raw": F.lit(None).cast("map<string,string>")})
    out = None
    for shape, rows in (("point", points), ("line", lines), ("area", areas)):
        found = routes.location_codes(rows, BOX, 2000, shape)
        pairs = F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
        part = found.select(F.lit(shape).alias("shape"), "id", F.array_join(pairs, ",").alias("properties"))
        out = part if out is None else out.unionByName(part)
    return out


CAMERAS = {"id": "o_orderkey", "street": "concat('N', CAST(o_custkey % 40 AS VARCHAR(20)))", "camera_type": "substr(o_orderpriority, 1, 1)", "rotatable": "o_orderkey % 2 = 0", "lon": _lon("o_orderkey"), "lat": _lat("o_orderkey")}


@query(f"""WITH c AS ({_select(CAMERAS, "orders")}) SELECT * FROM c WHERE {_within("lon", "lat")} ORDER BY id LIMIT 5000""")
def route_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.cameras(_columns(spark, sf_dir, "orders", CAMERAS), BOX, 5000)


CAMERA_ROUTES = {"sc_id": "l_orderkey", "sce_id": "1000000000 + l_orderkey * 1000 + l_linenumber", "street": "l_returnflag"} | {c: e for c, e in CONNECTIONS.items() if c in ("ax", "ay", "bx", "by")}


@query(f"""WITH r AS ({_select(CAMERA_ROUTES, "lineitem")}) SELECT sc_id, sce_id, street FROM r WHERE {_meets()} ORDER BY sc_id, sce_id LIMIT 5000""")
def route_camera_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x, y: F.struct(C(x).alias("x"), C(y).alias("y"))
    rows = _columns(spark, sf_dir, "lineitem", CAMERA_ROUTES).withColumn("line", F.array(at("ax", "ay"), at("bx", "by")))
    return routes.camera_routes(rows, BOX, 5000).select("sc_id", "sce_id", "street")
