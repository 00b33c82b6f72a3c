"""Registered queries for geometry choice, coordinates, keys and selection details, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, refs
from ..operators import ahead, geojson, lanes
from ..session import table
from . import overlay

C = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}
BOX = (4.705, 52.505, 4.715, 52.515)


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _polynomial(terms: list[tuple[int, int, float]], p: str, q: str) -> str:
    return " + ".join(" * ".join([f"({c!r})::DOUBLE", *[p] * i, *[q] * j]) for i, j, c in terms)


@query(f"""WITH {overlay.SQL}, d AS (SELECT site_id, (lat - 52.15517440::DOUBLE) * 0.36::DOUBLE AS p, (lon - 5.38720621::DOUBLE) * 0.36::DOUBLE AS q FROM site)
SELECT site_id, round({_polynomial(geo.RD_X, "p", "q")} + 155000, 3) AS x, round({_polynomial(geo.RD_Y, "p", "q")} + 463000, 3) AS y FROM d""")
def rd_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.to_rd("lon", "lat")
    return overlay.sites(spark, sf_dir).select("site_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""WITH {overlay.SQL}, k AS (SELECT site_id, 'matrix:' || coalesce(road_ref, '') || '|' || coalesce(carriageway, '') || '|' || coalesce(round(km, 2)::VARCHAR, '') AS k FROM site)
SELECT site_id, 'matrix-gantry-' || substr(sha256(k), 1, 16) AS gantry FROM k""")
def gantry_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.sites(spark, sf_dir).select("site_id", refs.gantry_id("road_ref", "carriageway", "km").alias("gantry"))


@query("""SELECT n_nationkey AS id, '["' || n_name || '",' || n_regionkey::VARCHAR || ']' AS key FROM nation""")
def panel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(C("n_nationkey").alias("id"), refs.panel_key("n_name", "n_regionkey").alias("key"))


@query("""SELECT n_nationkey AS id, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey::VARCHAR || ',"n_regionkey":' || coalesce(nullif(n_regionkey, 2)::VARCHAR, 'null') || '}') AS print FROM nation""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("n_regionkey", F.nullif(C("n_regionkey"), F.lit(2)))
    return n.select(C("n_nationkey").alias("id"), refs.fingerprint("n_regionkey", "n_name", "n_nationkey").alias("print"))


@query(f"""WITH {overlay.SQL}, g AS (SELECT source_id, alon, alat, CASE WHEN source_id % 3 = 0 THEN alon ELSE blon END AS lon2, CASE WHEN source_id % 3 = 0 THEN alat ELSE blat END AS lat2 FROM lane),
p AS (SELECT *, lon2 - alon AS dx, lat2 - alat AS dy FROM g),
u AS (SELECT *, CASE WHEN dx <> 0 THEN (4.705 - alon) / dx END AS x0, CASE WHEN dx <> 0 THEN (4.715 - alon) / dx END AS x1, CASE WHEN dy <> 0 THEN (52.505 - alat) / dy END AS y0, CASE WHEN dy <> 0 THEN (52.515 - alat) / dy END AS y1 FROM p)
SELECT source_id FROM u WHERE (dx <> 0 OR alon BETWEEN 4.705 AND 4.715) AND (dy <> 0 OR alat BETWEEN 52.505 AND 52.515)
  AND greatest(0, coalesce(least(x0, x1), 0), coalesce(least(y0, y1), 0)) <= least(1, coalesce(greatest(x0, x1), 1), coalesce(greatest(y0, y1), 1))""")
def coalesced_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines where there is one, else points: a segment that only crosses the viewport stays."""
    line = F.when(C("source_id") % 3 != 0, F.array(F.struct(C("alon").alias("x"), C("alat").alias("y")), F.struct(C("blon").alias("x"), C("blat").alias("y"))))
    rows = overlay.lanes(spark, sf_dir).withColumn("line", line)
    at = lambda i, k, other: F.coalesce(F.get("line", F.lit(i))[k], C(other))
    # the ends are bound once for the test, which names them many times
    ends = F.array(F.struct(at(0, "x", "alon").alias("x0"), at(0, "y", "alat").alias("y0"), at(1, "x", "alon").alias("x1"), at(1, "y", "alat").alias("y1")))
    return rows.where(F.exists(ends, lambda s: geo.segment_in_box(s["x0"], s["y0"], s["x1"], s["y1"], BOX))).select("source_id")


@query(f"""WITH {overlay.SQL} SELECT source_id, CASE WHEN source_id % 4 = 0 THEN blon ELSE alon END AS best, CASE WHEN source_id % 4 = 0 THEN blon END AS matched, round(((degrees(atan2(bx - ax, by_ - ay)) % 360) + 360) % 360, 4) AS azimuth FROM lane""")
def best_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overlay.lanes(spark, sf_dir).withColumn("matched", F.when(C("source_id") % 4 == 0, C("blon")))
    return rows.select("source_id", geojson.best_geometry("best", "alon", "matched").alias("best"), "matched", F.round(geo.azimuth(C("bx") - C("ax"), C("by") - C("ay")), 4).alias("azimuth"))


@query(f"WITH {overlay.SQL} SELECT site_id, km FROM site ORDER BY km NULLS LAST, site_id LIMIT 200 OFFSET 0")
def ordered_by_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.sites(spark, sf_dir).orderBy(C("km").asc_nulls_last(), "site_id").limit(200).select("site_id", "km")


@query(f"""WITH {overlay.SQL}, d AS (SELECT site_id, (lon - 4.7105::DOUBLE) * 111320.0::DOUBLE * cos(radians(52.5182::DOUBLE)) AS dx, (lat - 52.5182::DOUBLE) * 110540.0::DOUBLE AS dy FROM site),
a AS (SELECT site_id, dx * sin(radians(45.0)) + dy * cos(radians(45.0)) AS along, dx * cos(radians(45.0)) - dy * sin(radians(45.0)) AS across FROM d)
SELECT site_id, round(along, 3) AS along, CASE WHEN abs(across) > 200 OR abs(along) > 3000 THEN 'outside' WHEN along >= 0 THEN 'ahead' ELSE 'passed' END AS state FROM a""")
def corridor_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ahead.corridor(overlay.sites(spark, sf_dir), {"lon": 4.7105, "lat": 52.5182, "heading": 45.0}, width=200.0)
    return rows.select("site_id", F.round("along", 3).alias("along"), "state")


@query("""WITH w AS (SELECT p_partkey AS way, CASE WHEN p_size % 3 = 0 THEN 'yes' END AS oneway, p_size % 6 + 1 AS n FROM part),
s AS (SELECT way, oneway IS NOT NULL AS ow, n, CASE WHEN oneway IS NULL AND n % 2 = 0 THEN n // 2 WHEN oneway IS NOT NULL THEN n ELSE 0 END AS f, CASE WHEN oneway IS NULL AND n % 2 = 0 THEN n // 2 ELSE 0 END AS b, CASE WHEN oneway IS NULL AND n % 2 = 1 THEN n ELSE 0 END AS u FROM w)
SELECT way, 'fwd' AS direction, i::INTEGER AS lane, CASE WHEN ow THEN (i - 0.5 - f / 2.0) * 3.5 ELSE (i - 0.5) * 3.5 END::DOUBLE AS side FROM s, generate_series(1, 7) g(i) WHERE i <= f
UNION ALL SELECT way, 'bwd', i::INTEGER, (-(i - 0.5) * 3.5)::DOUBLE FROM s, generate_series(1, 7) g(i) WHERE i <= b
UNION ALL SELECT way, 'both', i::INTEGER, ((i - 0.5 - (CASE WHEN n = 1 THEN 1 ELSE u END) / 2.0) * 3.5)::DOUBLE FROM s, generate_series(1, 7) g(i) WHERE i <= u""")
def lane_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C("p_size")
    tags = F.map_filter(F.create_map(F.lit("oneway"), F.when(n % 3 == 0, F.lit("yes")), F.lit("lanes"), (n % 6 + 1).cast("string")), lambda k, v: v.isNotNull())
    ways = table(spark, sf_dir, "part").select(C("p_partkey").alias("way"), tags.alias("tags"))
    return lanes.lane_rows(lanes.cross_section(ways)).select("way", "direction", "lane", "side")


@query("""WITH m AS (SELECT o_custkey AS target, o_orderkey AS source, (o_orderkey * 7 % 181 - 90)::DOUBLE AS turn, (o_orderkey % 3 + 1)::INTEGER AS s_lanes, 24 AS t_lanes FROM orders),
b AS (SELECT *, sum(s_lanes) OVER (PARTITION BY target) AS total, coalesce(sum(s_lanes) OVER (PARTITION BY target ORDER BY turn, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT target, source, (before + 1)::INTEGER AS first_lane, (before + s_lanes)::INTEGER AS last_lane FROM b WHERE total <= t_lanes""")
def target_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("o_orderkey")
    m = table(spark, sf_dir, "orders").select(C("o_custkey").alias("target"), k.alias("source"), (k * 7 % 181 - 90).cast("double").alias("turn"), (k % 3 + 1).cast("int").alias("s_lanes"), F.lit(24).alias("t_lanes"))
    return lanes.blocks(m, ["target"], "source").where("first_lane is not null").select("target", "source", "first_lane", "last_lane")


@query("""WITH RECURSIVE f AS (SELECT user_id AS device, event_id, floor(epoch(ts)) AS sec, value AS x, value * 3 AS y, CASE WHEN event_id % 11 <> 0 THEN (event_id * 37 % 80)::DOUBLE + CASE WHEN event_id % 13 = 0 THEN 180 ELSE 0 END END AS heading, CASE WHEN event_id % 5 = 0 THEN event_type ELSE 'A9' END AS road,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT device, event_id, n, sec, x, y, heading, road, 'fetch' AS action FROM f WHERE n = 1 UNION ALL
  SELECT f.device, f.event_id, f.n, CASE WHEN u.action = 'keep' THEN w.sec ELSE f.sec END, CASE WHEN u.action = 'keep' THEN w.x ELSE f.x END, CASE WHEN u.action = 'keep' THEN w.y ELSE f.y END, CASE WHEN u.action = 'keep' THEN w.heading ELSE f.heading END, CASE WHEN u.action = 'keep' THEN w.road ELSE f.road END, u.action
  FROM w JOIN f ON f.device = w.device AND f.n = w.n + 1, LATERAL (SELECT CASE WHEN f.road <> w.road OR coalesce(abs((f.heading - w.heading + 540) % 360 - 180) >= 120, false) OR f.sec - w.sec > 120 THEN 'discard'
    WHEN sqrt((f.x - w.x) * (f.x - w.x) + (f.y - w.y) * (f.y - w.y)) >= 150 OR f.sec - w.sec >= 30 OR (f.heading IS NOT NULL AND coalesce(abs((f.heading - w.heading + 540) % 360 - 180) >= 20, true)) THEN 'fetch' ELSE 'keep' END AS action) u)
SELECT device, event_id, action FROM w""")
def context_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fixes of all devices, each compared with the last fetch."""
    k = C("event_id")
    heading = F.when(k % 11 != 0, (k * 37 % 80).cast("double") + F.when(k % 13 == 0, 180.0).otherwise(0.0))
    fixes = table(spark, sf_dir, "events").select(C("user_id").alias("device"), k, "ts", C("value").alias("x"), (C("value") * 3).alias("y"), heading.alias("heading"), F.when(k % 5 == 0, C("event_type")).otherwise(F.lit("A9")).alias("road"))
    return ahead.context_states(fixes).select("device", "event_id", "action")


@query("""WITH c AS (SELECT user_id AS channel, event_id, ts, CASE WHEN event_id % 3 <> 0 THEN event_type END AS id FROM events),
w AS (SELECT *, last_value(id IGNORE NULLS) OVER o AS last_id, last_value(CASE WHEN id IS NOT NULL THEN floor(epoch(ts)) END IGNORE NULLS) OVER o AS seen FROM c WINDOW o AS (PARTITION BY channel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE WHEN floor(epoch(ts)) - seen <= 7200 THEN last_id END AS shown FROM w""")
def held_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select(C("user_id").alias("channel"), "event_id", "ts", F.when(C("event_id") % 3 != 0, C("event_type")).alias("id"))
    return ahead.held_selection(c, hold=7200).select("event_id", "shown")


@query("""WITH w AS (SELECT o_orderkey % 3000 AS segment, o_custkey % 2 AS end_, o_totalprice / 39999.0::DOUBLE AS wish, (o_orderkey % 3000 % 40 + 5)::DOUBLE AS length FROM orders),
e AS (SELECT segment, end_, max(wish) AS wish, max(length) AS length FROM w GROUP BY 1, 2),
b AS (SELECT *, sum(wish) OVER (PARTITION BY segment) AS total, greatest(0, least(length * 0.8, length - greatest(2.0, length * 0.2))) AS budget FROM e)
SELECT segment, end_, round(CASE WHEN total > budget THEN wish * budget / total ELSE wish END, 6) AS trim FROM b""")
def connector_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    wishes = o.select((C("o_orderkey") % 3000).alias("segment"), F.lit("fwd").alias("travel"), (C("o_custkey") % 2).alias("end"), (C("o_totalprice") / 39999.0).alias("wish"), (C("o_orderkey") % 3000 % 40 + 5).cast("double").alias("length"))
    return lanes.trims(wishes).select("segment", C("end").alias("end_"), F.round("trim", 6).alias("trim"))


@query("""WITH p AS (SELECT l_orderkey // 3 AS s, l_partkey % 3 AS t, l_orderkey % 3 + 1 AS s_lane, l_suppkey % 2 + 1 AS t_lane, min(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY s, t, s_lane ORDER BY t_lane) AS a, row_number() OVER (PARTITION BY s, t, t_lane ORDER BY s_lane) AS b FROM p)
SELECT s, t, s_lane, t_lane, CASE WHEN a > 1 THEN 'split' WHEN b > 1 THEN 'join' ELSE 'continuation' END AS kind FROM r WHERE a = 1 OR b = 1""")
def lane_pair_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs are gone through by source and target lane number, whatever their score is."""
    k = C("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.floor(k / 3).alias("s_segment"), (C("l_partkey") % 3).alias("t_segment"), (k % 3 + 1).alias("s_lane"), (C("l_suppkey") % 2 + 1).alias("t_lane")).agg(F.min("l_extendedprice").alias("score"))
    pairs = rows.withColumns({"s_travel": F.lit("fwd"), "t_travel": F.lit("fwd")})
    return lanes.classified(pairs).select(C("s_segment").alias("s"), C("t_segment").alias("t"), "s_lane", "t_lane", C("kind_of_lane").alias("kind"))
