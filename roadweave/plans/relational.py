"""Registered queries over the driver's tables for the relational and snapshot operators, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators import snapshot as snap
from ..session import table

C = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _stamp(text: str):
    return F.lit(text).cast("timestamp")


@query("""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)
SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS view_value,
max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase, max(ts) AS measured_at FROM l GROUP BY user_id""")
def speed_pivot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = rel.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [C("ts").desc(), C("event_id").desc()])
    return last.groupBy("user_id").agg(*[F.max(F.when(C("event_type") == k, C("value"))).alias(n) for k, n in (("click", "click"), ("view", "view_value"), ("purchase", "purchase"))], F.max("ts").alias("measured_at"))


@query("""WITH r AS (SELECT user_id % 50 AS site, event_type AS lane, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0 ELSE value END AS speed,
  value * 10 AS flow, event_id % 4 AS n_inputs, value / 7 AS std_dev, CASE WHEN event_id % 17 <> 0 THEN date_trunc('day', ts) END AS ts, event_id AS seq FROM events),
m AS (SELECT *, max(CASE WHEN speed IS NOT NULL AND speed <> 0 THEN ts END) OVER (PARTITION BY site, lane) AS last FROM r),
g AS (SELECT site, lane, max(last) AS last, round(avg(CASE WHEN ok THEN speed END), 1) AS speed, round(avg(CASE WHEN ok THEN flow END), 0) AS flow,
  sum(CASE WHEN ok THEN n_inputs END)::BIGINT AS n_inputs, round(avg(CASE WHEN ok THEN std_dev END), 2) AS std_dev
  FROM (SELECT *, coalesce(speed IS NOT NULL AND speed <> 0 AND ts = last, false) AS ok FROM m) GROUP BY site, lane),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, lane ORDER BY ts DESC NULLS LAST, seq) AS k FROM r) WHERE k = 1)
SELECT g.site, g.lane, CASE WHEN last IS NULL THEN p.speed ELSE g.speed END AS speed, CASE WHEN last IS NULL THEN p.flow ELSE g.flow END AS flow,
  CASE WHEN last IS NULL THEN p.n_inputs ELSE g.n_inputs END AS n_inputs, CASE WHEN last IS NULL THEN p.std_dev ELSE g.std_dev END AS std_dev,
  CASE WHEN last IS NULL THEN p.ts ELSE last END AS ts FROM g JOIN p ON g.site = p.site AND g.lane = p.lane""")
def lane_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    speed = F.when(C("event_id") % 11 == 0, F.lit(None)).when(C("event_id") % 13 == 0, 0.0).otherwise(C("value"))
    ts = F.when(C("event_id") % 17 != 0, F.date_trunc("day", "ts"))
    readings = e.select((C("user_id") % 50).alias("site"), C("event_type").alias("lane"), speed.alias("speed"), (C("value") * 10).alias("flow"), (C("event_id") % 4).alias("n_inputs"), (C("value") / 7).alias("std_dev"), ts.alias("ts"), C("event_id").alias("seq"))
    return rel.merge_lanes(readings, ["site", "lane"])


SITES = """SELECT (CASE WHEN c_custkey % 3 = 0 THEN 'RWS01_MONIBAS_' ELSE 'GEO01_LOOP_' END) || c_custkey::VARCHAR AS site_id, c_custkey AS k, (c_custkey % 40)::DOUBLE / 8 AS lon, (c_custkey % 7)::DOUBLE / 4 AS lat,
  CASE WHEN c_custkey % 4 <> 0 THEN 'A' || (c_custkey % 3)::VARCHAR END AS road, CASE WHEN c_custkey % 6 <> 0 THEN 'R' END AS carriageway, CASE WHEN c_custkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS direction,
  'both' AS side, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 6)::INTEGER END AS num_lanes, CASE WHEN c_custkey % 8 <> 0 THEN c_acctbal END AS km, CASE WHEN c_custkey % 9 = 0 THEN c_acctbal / 3 END AS bearing,
  CASE WHEN c_custkey % 2 = 0 THEN 'Re' WHEN c_custkey % 5 = 0 THEN 'a' END AS roadway FROM customer"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.when(k % 3 == 0, F.lit("RWS01_MONIBAS_")).otherwise(F.lit("GEO01_LOOP_")), k.cast("string")).alias("site_id"), k.alias("k"), ((k % 40).cast("double") / 8).alias("lon"), ((k % 7).cast("double") / 4).alias("lat"),
        F.when(k % 4 != 0, F.concat(F.lit("A"), (k % 3).cast("string"))).alias("road"), F.when(k % 6 != 0, F.lit("R")).alias("carriageway"), F.when(k % 2 == 0, F.lit("positive")).otherwise(F.lit("negative")).alias("direction"),
        F.lit("both").alias("side"), F.when(k % 5 != 0, (k % 6).cast("int")).alias("num_lanes"), F.when(k % 8 != 0, C("c_acctbal")).alias("km"), F.when(k % 9 == 0, C("c_acctbal") / 3).alias("bearing"),
        F.when(k % 2 == 0, F.lit("Re")).when(k % 5 == 0, F.lit("a")).alias("roadway"),
    )


@query(f"""WITH s AS ({SITES})
SELECT round(lon, 5) AS lon, round(lat, 5) AS lat, road, coalesce(carriageway, direction) AS way, side, arg_min(site_id, (CASE WHEN contains(site_id, '_MONIBAS_') THEN '0' ELSE '1' END) || site_id) AS site_id,
  array_to_string(list_sort(list_distinct(list(split_part(site_id, '_', 2)))), ',') AS systems, count(DISTINCT site_id) AS source_count, nullif(max(coalesce(num_lanes, 0)), 0) AS num_lanes,
  arg_min(km, site_id) FILTER (km IS NOT NULL) AS km, arg_min(bearing, site_id) FILTER (bearing IS NOT NULL) AS bearing, CASE WHEN min(roadway) = max(roadway) THEN min(roadway) END AS roadway
FROM s GROUP BY ALL""")
def location_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.location_buckets(_sites(spark, sf_dir)).withColumn("systems", F.array_join("systems", ","))


@query(f"""WITH s AS (SELECT * REPLACE (CASE WHEN k % 4 <> 0 AND k % 3 = 0 THEN road END AS road), CASE WHEN k % 10 = 1 THEN 'N' || (k % 2)::VARCHAR END AS chain_road, CASE WHEN k % 10 = 1 THEN 'L' END AS chain_carriageway FROM ({SITES})),
a AS (SELECT site_id, lon, lat, side, direction, coalesce(road, chain_road) AS road, coalesce(carriageway, chain_carriageway) AS carriageway, CASE WHEN road IS NOT NULL THEN 'explicit' WHEN chain_road IS NOT NULL THEN 'chain_number' END AS src FROM s),
g AS (SELECT lon, lat, side, direction, count(DISTINCT (road, carriageway)) FILTER (road IS NOT NULL) AS n, any_value(road) FILTER (road IS NOT NULL) AS gr, max(carriageway) FILTER (road IS NOT NULL) AS gc FROM a GROUP BY ALL)
SELECT site_id, CASE WHEN a.road IS NULL AND n = 1 THEN gr ELSE a.road END AS road, CASE WHEN a.road IS NULL AND n = 1 THEN gc ELSE carriageway END AS carriageway,
  CASE WHEN a.road IS NULL AND n = 1 THEN 'inherited' ELSE src END AS road_source FROM a JOIN g USING (lon, lat, side, direction)""")
def effective_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("k")
    s = _sites(spark, sf_dir).withColumns({"road": F.when((k % 4 != 0) & (k % 3 == 0), C("road")), "chain_road": F.when(k % 10 == 1, F.concat(F.lit("N"), (k % 2).cast("string"))), "chain_carriageway": F.when(k % 10 == 1, F.lit("L"))})
    return rel.effective_road(s, ["lon", "lat", "side", "direction"]).select("site_id", "road", "carriageway", "road_source")


@query("SELECT o_orderkey, o_totalprice AS km FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS o_totalprice FROM orders) WHERE o_totalprice BETWEEN 1000 AND 90000 OR o_totalprice IS NULL")
def km_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(C("o_orderkey") % 6 != 0, C("o_totalprice")).alias("km"))
    return rel.km_window(rows, 1000.0, 90000.0, keep_unknown=True)


@query("""WITH c AS (SELECT l_orderkey, sum(coalesce(CASE WHEN l_linenumber <> 3 THEN l_quantity END, 0)) AS available, sum(l_extendedprice) AS total FROM lineitem WHERE l_tax > 0.02 GROUP BY l_orderkey)
SELECT o_orderkey, round(available, 2) AS available, round(total, 2) AS total FROM orders LEFT JOIN c ON l_orderkey = o_orderkey
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l.l_discount > 0.05)""")
def charging_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    free = table(spark, sf_dir, "orders").select("o_orderkey").join(lines.where("l_discount > 0.05").select("o_orderkey"), "o_orderkey", "left_semi")
    sums = {"available": F.when(C("l_linenumber") != 3, C("l_quantity")), "total": C("l_extendedprice")}
    return rel.rollup_or_unknown(free, lines.where("l_tax > 0.02"), "o_orderkey", sums).select("o_orderkey", F.round("available", 2).alias("available"), F.round("total", 2).alias("total"))


@query("SELECT p_partkey AS road_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
def orphan_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(C("l_partkey").alias("road_id"))
    return table(spark, sf_dir, "part").select(C("p_partkey").alias("road_id")).join(used, "road_id", "left_anti")


@query("""SELECT c_custkey, o_orderkey, l_partkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1""")
def sign_state_left_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    first = li.where("l_linenumber = 1").select("l_orderkey", "l_partkey")
    return c.join(o, C("o_custkey") == C("c_custkey"), "left").join(first, C("l_orderkey") == C("o_orderkey"), "left").select("c_custkey", "o_orderkey", "l_partkey")


@query("""WITH s AS (SELECT c_custkey, nullif(c_nationkey, 3) AS road, nullif(c_mktsegment, 'BUILDING') AS cw FROM customer),
g AS (SELECT DISTINCT road, cw FROM s ORDER BY road NULLS LAST, cw NULLS LAST LIMIT 25)
SELECT c_custkey, s.road, s.cw FROM s WHERE EXISTS (SELECT 1 FROM g WHERE g.road IS NOT DISTINCT FROM s.road AND g.cw IS NOT DISTINCT FROM s.cw)""")
def null_safe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").select("c_custkey", F.nullif(C("c_nationkey"), F.lit(3)).alias("road"), F.nullif(C("c_mktsegment"), F.lit("BUILDING")).alias("cw"))
    return rel.first_groups(s, ["road", "cw"], 25)


@query("""WITH u AS (SELECT * FROM lineitem WHERE l_discount > 0.03), i AS (SELECT l_orderkey FROM u GROUP BY l_orderkey ORDER BY l_orderkey LIMIT 300)
SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total, (SELECT count(*) FROM i) > 50 AS truncated FROM u WHERE l_orderkey IN (SELECT l_orderkey FROM i) GROUP BY l_orderkey""")
def candidate_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ids = rel.bounded_candidates(table(spark, sf_dir, "lineitem"), C("l_discount") > 0.03, "l_orderkey", ["l_orderkey"], 50)
    found = rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return found.crossJoin(F.broadcast(ids.agg((F.count(F.lit(1)) > 50).alias("truncated"))))


@query("SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(user_id, event_id) AS user_id, count(*) AS runs FROM events GROUP BY event_type")
def feed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.latest_of_feed(table(spark, sf_dir, "events").select("event_type", "event_id", "value", "user_id"), "event_type", "event_id")


@query("""WITH s AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN date_trunc('hour', ts) END AS ts_state FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, round(value, 0) ORDER BY ts_state DESC NULLS LAST, event_id) AS k FROM s)
SELECT event_id, user_id, event_type, ts_state FROM r WHERE k = 1 ORDER BY event_id LIMIT 500""")
def ghost_dedup_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").withColumns({"ts_state": F.when(C("event_id") % 7 != 0, F.date_trunc("hour", "ts")), "slot": F.round("value", 0)})
    return rel.latest(s, ["user_id", "event_type", "slot"], [C("ts_state").desc_nulls_last(), C("event_id")]).orderBy("event_id").limit(500).select("event_id", "user_id", "event_type", "ts_state")


@query("SELECT user_id, count(*) AS deleted, max(event_id) AS last_deleted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k > 50 GROUP BY user_id")
def history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = rel.beyond(table(spark, sf_dir, "events"), ["user_id"], [C("event_id").desc()], 50)
    return gone.groupBy("user_id").agg(F.count(F.lit(1)).alias("deleted"), F.max("event_id").alias("last_deleted"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, coalesce(props->>'ref', props->>'k', '-') AS ref FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.ref"), k, F.lit("-")).alias("ref"))


@query("""SELECT l_returnflag AS status, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 3) AS p05, round(quantile_cont(l_extendedprice, 0.5), 3) AS p50, round(quantile_cont(l_extendedprice, 0.95), 3) AS p95 FROM lineitem GROUP BY 1""")
def report_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.match_report(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "status"), "status", "l_extendedprice")


@query("""SELECT 'l_returnflag' AS counter, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.counters(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS ways FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def shared_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(C("l_partkey").alias("node")).agg(F.countDistinct("l_orderkey").alias("ways")).where("ways > 1")


@query("""SELECT count(*) AS raw, (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)) AS slots FROM customer""")
def profile_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.struct(C("c_nationkey"), F.nullif(C("c_mktsegment"), F.lit("BUILDING")))
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("raw"), F.countDistinct(slot).alias("slots"))


@query("""WITH r AS (SELECT c_custkey AS site_id, 'A' || (c_nationkey)::VARCHAR AS road, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 12)::DOUBLE END AS km, c_acctbal AS speed FROM customer),
q AS (SELECT CASE WHEN km IS NULL THEN 'site:' || site_id::VARCHAR ELSE road || '@' || km::VARCHAR END AS place, site_id, speed, row_number() OVER (PARTITION BY CASE WHEN km IS NULL THEN 'site:' || site_id::VARCHAR ELSE road || '@' || km::VARCHAR END ORDER BY coalesce(speed, -1) DESC, site_id) AS k FROM r)
SELECT place, site_id, speed FROM q WHERE k = 1""")
def sidebar_fastest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("site_id"), F.concat(F.lit("A"), C("c_nationkey").cast("string")).alias("road"), F.when(k % 5 != 0, (k % 12).cast("double")).alias("km"), C("c_acctbal").alias("speed"))
    return rel.fastest_per_place(rows)


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey, (o_orderkey * 37 % 3600)::DOUBLE / 10 AS angle, o_totalprice FROM orders),
r AS (SELECT *, row_number() OVER w AS n, lead(angle) OVER w AS nx FROM a WINDOW w AS (PARTITION BY k, floor(angle / 45) ORDER BY o_totalprice DESC, o_orderkey))
SELECT k, o_orderkey, angle FROM r WHERE n = 1 AND (nx IS NULL OR abs(nx - angle) >= 7.5)""")
def branch_per_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(C("o_custkey").alias("k"), "o_orderkey", ((C("o_orderkey") * 37 % 3600).cast("double") / 10).alias("angle"), "o_totalprice")
    return rel.top_per_angle(rows, ["k"], "angle", [C("o_totalprice").desc(), C("o_orderkey")], 45.0, 7.5).select("k", "o_orderkey", "angle")


@query("""SELECT p_partkey, p_brand AS highway FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')""")
def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(C("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).select("p_partkey", C("p_brand").alias("highway"))


HIGHWAYS = "CASE p_partkey % 5 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' ELSE 'motorway_link' END"


@query(f"SELECT p_partkey, {HIGHWAYS} AS highway FROM part WHERE {HIGHWAYS} IN ('motorway', 'motorway_link', 'trunk', 'primary')")
def zoom_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.tiered(table(spark, sf_dir, "part").select("p_partkey", F.expr(HIGHWAYS).alias("highway")), 9)


@query("""SELECT event_id, user_id, total > 200 AS truncated FROM (SELECT event_id, user_id, count(*) OVER () AS total FROM events) ORDER BY event_id LIMIT 200""")
def truncated_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.page(table(spark, sf_dir, "events").select("event_id", "user_id"), [C("event_id")], 200)


@query("""WITH loc AS (SELECT user_id AS uuid, arg_min(event_type, event_id) AS lane FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0 GROUP BY 1),
st AS (SELECT uuid, display, ts FROM (SELECT user_id AS uuid, value AS display, strftime(date_trunc('day', ts), '%Y-%m-%d') AS ts, row_number() OVER (PARTITION BY user_id ORDER BY strftime(date_trunc('day', ts), '%Y-%m-%d') DESC, event_id) AS k FROM events WHERE event_id % 2 = 1 AND user_id % 5 <> 0) WHERE k = 1)
SELECT coalesce(loc.uuid, st.uuid) AS uuid, lane, display, ts FROM loc FULL JOIN st ON loc.uuid = st.uuid""")
def sign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    loc = e.where("event_id % 2 = 0 and user_id % 3 <> 0").select(C("user_id").alias("uuid"), C("event_type").alias("lane"), C("event_id").alias("pos"))
    st = e.where("event_id % 2 = 1 and user_id % 5 <> 0").select(C("user_id").alias("uuid"), C("value").alias("display"), F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("ts"), C("event_id").alias("pos"))
    return rel.first_and_latest(loc, st)


@query("""SELECT n_nationkey AS id, n_name AS lane, NULL::INTEGER AS connection, 'lane' AS kind FROM nation UNION ALL SELECT r_regionkey, NULL, r_regionkey, 'connection' FROM region""")
def lane_lines_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = table(spark, sf_dir, "nation").select(C("n_nationkey").alias("id"), C("n_name").alias("lane"), F.lit("lane").alias("kind"))
    return lanes.unionByName(table(spark, sf_dir, "region").select(C("r_regionkey").alias("id"), C("r_regionkey").alias("connection"), F.lit("connection").alias("kind")), allowMissingColumns=True)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_linenumber) IN (SELECT p_partkey, p_size % 7 + 1 FROM part WHERE p_size < 20)""")
def row_value_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").where("p_size < 20").select(C("p_partkey").alias("l_partkey"), (C("p_size") % 7 + 1).alias("l_linenumber"))
    return table(spark, sf_dir, "lineitem").join(wanted, ["l_partkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber")


# snapshots: the events before the 16th are stored, those from the 10th on come as a batch

STORED = "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS seq, TIMESTAMP '2024-01-15 00:00:00' AS ingested_at FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2"
BATCH = "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND user_id % 4 <> 0 GROUP BY 1, 2"
NOW = "2024-02-01 00:00:00"
KEYS = ["user_id", "event_type"]


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    last = lambda rows: rows.groupBy(*KEYS).agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("seq"))
    return last(e.where("ts < timestamp '2024-01-16'")).withColumn("ingested_at", _stamp("2024-01-15 00:00:00")), last(e.where("ts >= timestamp '2024-01-10' and user_id % 4 <> 0"))


@query(f"""WITH s AS ({STORED}), b AS ({BATCH}) SELECT user_id, event_type, value, seq, ingested_at FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = s.user_id AND b.event_type = s.event_type)
UNION ALL SELECT user_id, event_type, value, NULL, TIMESTAMP '{NOW}' FROM b""")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _stored(spark, sf_dir)
    batch = table(spark, sf_dir, "events").where("ts >= timestamp '2024-01-10' and user_id % 4 <> 0").select(*KEYS, "value", "event_id")
    return snap.upsert(s, snap.last_of_batch(batch, KEYS, "event_id").drop("event_id"), KEYS, _stamp(NOW))


@query(f"""WITH s AS ({STORED}), b AS ({BATCH}) SELECT coalesce(s.user_id, b.user_id) AS user_id, coalesce(s.event_type, b.event_type) AS event_type,
CASE WHEN b.seq IS NULL OR (s.seq IS NOT NULL AND s.value IS NOT DISTINCT FROM b.value AND s.seq IS NOT DISTINCT FROM b.seq) THEN s.value ELSE b.value END AS value,
CASE WHEN b.seq IS NULL OR (s.seq IS NOT NULL AND s.value IS NOT DISTINCT FROM b.value AND s.seq IS NOT DISTINCT FROM b.seq) THEN s.seq ELSE b.seq END AS seq,
CASE WHEN b.seq IS NULL OR (s.seq IS NOT NULL AND s.value IS NOT DISTINCT FROM b.value AND s.seq IS NOT DISTINCT FROM b.seq) THEN s.ingested_at ELSE TIMESTAMP '{NOW}' END AS ingested_at
FROM s FULL JOIN b ON s.user_id = b.user_id AND s.event_type = b.event_type""")
def changed_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = _stored(spark, sf_dir)
    return snap.merge_changed(s, b, KEYS, ["value", "seq"], _stamp(NOW))


@query(f"""WITH s AS ({STORED}), b AS ({BATCH}) SELECT * FROM s WHERE event_type <> 'click' OR EXISTS (SELECT 1 FROM b WHERE b.user_id = s.user_id AND b.event_type = s.event_type)""")
def prune_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = _stored(spark, sf_dir)
    return snap.prune(s, b, KEYS, "event_type", "click")


@query(f"""WITH s AS ({STORED}), b AS (SELECT * FROM ({BATCH}) WHERE event_type <> 'view') SELECT * FROM s
WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.event_type = s.event_type) OR EXISTS (SELECT 1 FROM b WHERE b.user_id = s.user_id AND b.event_type = s.event_type)""")
def guarded_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = _stored(spark, sf_dir)
    return snap.guarded_prune(s, b.where("event_type <> 'view'"), KEYS, "event_type")


@query(f"""WITH s AS (SELECT * REPLACE (CASE WHEN seq % 3 <> 0 THEN value END AS value) FROM ({STORED})), b AS ({BATCH}) SELECT coalesce(s.user_id, b.user_id) AS user_id, coalesce(s.event_type, b.event_type) AS event_type, coalesce(s.value, b.value) AS value,
coalesce(b.seq, s.seq) AS seq, CASE WHEN b.seq IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE s.ingested_at END AS ingested_at FROM s FULL JOIN b ON s.user_id = b.user_id AND s.event_type = b.event_type""")
def preserve_geom(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = _stored(spark, sf_dir)
    return snap.upsert_preserving(s.withColumn("value", F.when(C("seq") % 3 != 0, C("value"))), b, KEYS, ["value"], _stamp(NOW))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber + 10 AS l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber < 3), s AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem)
SELECT * FROM s WHERE l_orderkey NOT IN (SELECT l_orderkey FROM b) UNION ALL SELECT * FROM b""")
def child_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return snap.replace_children(s, s.where("l_orderkey % 3 = 0 and l_linenumber < 3").withColumn("l_linenumber", C("l_linenumber") + 10), "l_orderkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, c_name FROM customer""")
def update_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name")
    b = s.where("c_custkey % 2 = 0").select((C("c_custkey")).alias("c_custkey"), F.when(C("c_custkey") % 3 != 0, C("c_acctbal") * 2).alias("c_acctbal"))
    return snap.update_only(s, b.unionByName(b.withColumn("c_custkey", -C("c_custkey") - 1)), ["c_custkey"], ["c_acctbal"])


@query("""WITH m AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'north' ELSE 'south' END AS extract, l_partkey AS road_id FROM lineitem), k AS (SELECT extract, road_id FROM m WHERE extract <> 'north' UNION ALL SELECT DISTINCT 'north', p_partkey FROM part WHERE p_size < 10)
SELECT p_partkey AS road_id, p_name FROM part WHERE p_partkey IN (SELECT road_id FROM k)""")
def extract_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.when(C("l_suppkey") % 2 == 0, F.lit("north")).otherwise(F.lit("south")).alias("extract"), C("l_partkey").alias("road_id"))
    p = table(spark, sf_dir, "part").select(C("p_partkey").alias("road_id"), "p_name", "p_size")
    return snap.replace_extract(m, p.select("road_id", "p_name"), p.where("p_size < 10"), "north")[1]


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey AS from_road, o_orderkey % 1500 AS to_road FROM orders), s AS (SELECT c_custkey AS road_id FROM customer WHERE c_custkey % 10 = 0)
SELECT id, from_road, to_road FROM c WHERE from_road NOT IN (SELECT road_id FROM s) AND to_road NOT IN (SELECT road_id FROM s) UNION ALL SELECT -road_id, road_id, road_id FROM s""")
def scoped_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), C("o_custkey").alias("from_road"), (C("o_orderkey") % 1500).alias("to_road"))
    s = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(C("c_custkey").alias("road_id"))
    return snap.replace_scoped(c, s.select((-C("road_id")).alias("id"), C("road_id").alias("from_road"), C("road_id").alias("to_road")), s, ["from_road", "to_road"])


@query("""SELECT DISTINCT road_id FROM (SELECT l_orderkey AS road_id, l_partkey AS id FROM lineitem WHERE l_linenumber < 4 EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber > 1)
UNION SELECT road_id FROM (SELECT l_orderkey AS road_id, l_partkey AS id FROM lineitem WHERE l_linenumber > 1 EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber < 4)""")
def changed_road_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("road_id"), C("l_partkey").alias("id"), "l_linenumber")
    return snap.changed_roads(li.where("l_linenumber < 4").drop("l_linenumber"), li.where("l_linenumber > 1").drop("l_linenumber"))
