"""Registered queries for the spatial, matching, chain, lane, routing and selection operators, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, refs
from ..operators import ahead, chains, geojson, lanes, matching, routing, schedule, spatial
from ..session import table
from . import overlay

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


def _one_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (order, line number): these may repeat."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return rows.agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("l_quantity"))


BOX = (4.705, 52.505, 4.715, 52.515)


@query(f"WITH {overlay.SQL} SELECT site_id, lon, lat FROM site WHERE lon BETWEEN 4.705 AND 4.715 AND lat BETWEEN 52.505 AND 52.515")
def bbox_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = overlay.sites(spark, sf_dir)
    return s.where(geo.point_in_box("lon", "lat", BOX)).select("site_id", "lon", "lat")


@query(f"""WITH {overlay.SQL}, p AS (SELECT source_id, alon, blon - alon AS dx, alat, blat - alat AS dy FROM lane),
u AS (SELECT *, CASE WHEN dx <> 0 THEN (4.705 - alon) / dx END AS x0, CASE WHEN dx <> 0 THEN (4.715 - alon) / dx END AS x1, CASE WHEN dy <> 0 THEN (52.505 - alat) / dy END AS y0, CASE WHEN dy <> 0 THEN (52.515 - alat) / dy END AS y1 FROM p)
SELECT source_id FROM u WHERE (dx <> 0 OR alon BETWEEN 4.705 AND 4.715) AND (dy <> 0 OR alat BETWEEN 52.505 AND 52.515)
  AND greatest(0, coalesce(least(x0, x1), 0), coalesce(least(y0, y1), 0)) <= least(1, coalesce(greatest(x0, x1), 1), coalesce(greatest(y0, y1), 1))""")
def bbox_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.lanes(spark, sf_dir).where(geo.segment_in_box("alon", "alat", "blon", "blat", BOX)).select("source_id")


@query(f"WITH {overlay.near_sql(25)} SELECT site_id, source_id, round(dist, 4) AS dist, round(line_bearing, 4) AS line_bearing FROM near")
def distance_join_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, lanes = overlay.sites(spark, sf_dir).select("site_id", "x", "y"), overlay.lanes(spark, sf_dir).select("source_id", "ax", "ay", "bx", "by")
    # a lane's bearing is rounded once, not in each of its pairs
    shown = F.round(geo.azimuth(C("bx") - C("ax"), C("by") - C("ay")), 4)
    return spatial.distance_join(sites, lanes.withColumn("shown", shown), 25.0).select("site_id", "source_id", geo.rounded("dist", 4).alias("dist"), C("shown").alias("line_bearing"))


@query(f"""WITH {overlay.near_sql(60)}, r AS (SELECT site_id, source_id, dist, row_number() OVER (PARTITION BY site_id ORDER BY dist, source_id) AS rank FROM near)
SELECT s.site_id, r.source_id, round(r.dist, 4) AS dist, r.rank FROM site s LEFT JOIN (SELECT * FROM r WHERE rank <= 4) r ON r.site_id = s.site_id""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.knn_within(overlay.sites(spark, sf_dir).select("site_id", "x", "y"), overlay.lanes(spark, sf_dir).select("source_id", "ax", "ay", "bx", "by"), "site_id", "source_id", 60.0, 4)
    return near.select("site_id", "source_id", F.round("dist", 4).alias("dist"), "rank")


@query(f"""WITH {overlay.near_sql(5000)}, r AS (SELECT site_id, source_id, dist, row_number() OVER (PARTITION BY site_id ORDER BY dist, source_id) AS rank FROM near)
SELECT site_id, source_id, round(dist, 4) AS dist FROM r WHERE rank = 1""")
def knn_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(overlay.sites(spark, sf_dir), overlay.lanes(spark, sf_dir), "site_id", "source_id", 40.0).select("site_id", "source_id", F.round("dist", 4).alias("dist"))


@query(f"""WITH {overlay.SQL} SELECT site_id FROM site WHERE road_ref = 'A4' ORDER BY (lon - 4.7105::DOUBLE) * (lon - 4.7105::DOUBLE) + (lat - 52.5182::DOUBLE) * (lat - 52.5182::DOUBLE), site_id LIMIT 25""")
def knn_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = overlay.sites(spark, sf_dir).where("road_ref = 'A4'")
    return spatial.nearest_to(s, 4.7105, 52.5182, 25, "site_id").select("site_id")


@query(f"""WITH {overlay.SQL}, e AS (SELECT source_id, ax AS x, ay AS y FROM lane UNION ALL SELECT source_id, bx, by_ FROM lane),
p AS (SELECT DISTINCT a.source_id, b.source_id AS other FROM e a JOIN e b ON a.source_id <> b.source_id AND b.x BETWEEN a.x - 20 AND a.x + 20 AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) <= 20)
SELECT l.source_id, coalesce(string_agg(p.other::VARCHAR, ',' ORDER BY p.other), '') AS connected FROM lane l LEFT JOIN p USING (source_id) GROUP BY 1""")
def connected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.connected(overlay.lanes(spark, sf_dir), "source_id", 20.0)
    return found.select("source_id", F.array_join("connected", ",").alias("connected"))


@query(f"""WITH {overlay.near_sql(60)}, q AS (SELECT *, CASE WHEN road_ref IS NULL OR ref IS NULL THEN 0 WHEN road_ref = ref THEN 2 WHEN substr(road_ref, 2) = substr(ref, 2) THEN 1 ELSE -1 END AS quality,
  round(abs((((line_bearing - bearing + 180) % 360) + 360) % 360 - 180), 6) AS angle FROM near),
e AS (SELECT *, coalesce(quality >= 1 AND dist < 5 AND angle <= 15, false) AS close_, lane_count = num_lanes AS agree, coalesce(quality >= 0 AND angle <= 45, false) AS ok FROM q),
r AS (SELECT *, row_number() OVER w AS k, lead({{'s': source_id, 'o': ok, 'c': close_, 'q': quality, 'l': agree, 'a': angle, 'd': dist}}) OVER w AS nx,
  bool_or(quality >= 0) OVER (PARTITION BY site_id) AS road_ok, bool_or(ok) OVER (PARTITION BY site_id) AS any_ok
  FROM e WINDOW w AS (PARTITION BY site_id ORDER BY ok DESC, close_ DESC, quality DESC, agree DESC, angle NULLS FIRST, dist, source_id)),
f AS (SELECT *, CASE WHEN NOT road_ok THEN 'road_ref_conflict' WHEN NOT any_ok THEN 'bearing_mismatch' WHEN coalesce(nx.o AND nx.s <> source_id AND nx.c = close_ AND nx.q = quality AND nx.l = agree AND abs(nx.a - angle) <= 2 AND abs(nx.d - dist) <= 1, false) THEN 'ambiguous_candidates' END AS failure FROM r WHERE k = 1)
SELECT s.site_id, CASE WHEN f.failure IS NULL THEN f.source_id END AS source_id, CASE WHEN f.failure IS NULL THEN f.quality END AS quality, round(CASE WHEN f.failure IS NULL THEN f.angle END, 4) AS angle,
  CASE WHEN f.site_id IS NULL THEN 'no_nearby_major_lane' ELSE f.failure END AS failure FROM site s LEFT JOIN f ON f.site_id = s.site_id""")
def map_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = overlay.sites(spark, sf_dir)
    return matching.attach(s, matching.match_sites_near(s, overlay.lanes(spark, sf_dir), 60.0)).select("site_id", "source_id", "quality", F.round("angle", 4).alias("angle"), "failure")


#: Signs in threes on a gantry's place, three metres apart; lanes as traversals of ways with two lanes a direction.
SIGNS = """sign AS (SELECT s.site_id AS sign, s.site_id // 3 AS gantry, a.road_ref AS road, a.carriageway, CASE WHEN s.site_id % 13 <> 0 THEN (s.site_id % 3 + 1)::INTEGER END AS number,
  CASE WHEN s.site_id % 10 <> 0 THEN a.bearing END AS bearing, a.x + (s.site_id % 3) * 3.0::DOUBLE AS x, a.y AS y FROM site s JOIN site a ON a.site_id = s.site_id // 3 * 3)"""
WAYS = """source_id AS lane_id, CASE WHEN source_id % 4 < 2 THEN 'fwd' ELSE 'bwd' END AS way, (source_id % 2 + 1)::INTEGER AS lane_nr, source_id // 8 AS road_id,
  CASE WHEN source_id // 4 % 10 = 0 THEN (source_id // 4)::VARCHAR || ':0:0' ELSE (source_id // 4)::VARCHAR || ':' || (source_id // 4 * 7 % 50)::VARCHAR || ':' || (source_id // 4 * 11 % 50)::VARCHAR END AS segment,
  CASE WHEN source_id // 4 % 3 = 0 THEN 3 ELSE lane_count END AS lanes, CASE WHEN source_id // 4 % 7 = 0 THEN ref || ';N99' ELSE ref END AS refs,
  CASE source_id // 4 % 5 WHEN 0 THEN 'Re' WHEN 1 THEN 'Li' WHEN 2 THEN 'Le' WHEN 3 THEN 'b' END AS label, CASE WHEN source_id // 4 % 6 = 0 THEN 'motorway_link' ELSE 'motorway' END AS highway"""


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = overlay.sites(spark, sf_dir)
    k = C("site_id")
    anchors = s.where(k % 3 == 0).select(F.floor(k / 3).alias("gantry"), C("road_ref").alias("road"), "carriageway", C("bearing").alias("_bearing"), C("x").alias("_x"), "y")
    rows = s.select(k.alias("sign"), F.floor(k / 3).alias("gantry"), F.when(k % 13 != 0, (k % 3 + 1).cast("int")).alias("lane")).join(anchors, "gantry")
    return rows.withColumns({"bearing": F.when(C("sign") % 10 != 0, C("_bearing")), "x": C("_x") + (C("sign") % 3) * 3.0}).drop("_bearing", "_x")


def traversal_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = overlay.lanes(spark, sf_dir).drop("direction"), C("source_id")
    way = F.floor(k / 4)
    text = lambda *n: F.concat_ws(":", way.cast("string"), *[x.cast("string") for x in n])
    rows = rows.withColumns({
        "lane_id": k, "direction": F.when(k % 4 < 2, F.lit("fwd")).otherwise(F.lit("bwd")), "lane_nr": (k % 2 + 1).cast("int"), "road_id": F.floor(k / 8),
        "segment": F.when(way % 10 == 0, text(F.lit(0), F.lit(0))).otherwise(text(way * 7 % 50, way * 11 % 50)), "lane_count": F.when(way % 3 == 0, 3).otherwise(C("lane_count")),
        "ref": F.when(way % 7 == 0, F.concat("ref", F.lit(";N99"))).otherwise(C("ref")), "lane_carriageway": F.when(way % 5 == 0, F.lit("Re")).when(way % 5 == 1, F.lit("Li")).when(way % 5 == 2, F.lit("Le")).when(way % 5 == 3, F.lit("b")),
        "highway": F.when(way % 6 == 0, F.lit("motorway_link")).otherwise(F.lit("motorway")),
    })
    return rows.withColumn("lane_refs", refs.matcher_refs("ref"))


def _gantry_sql(radius: int) -> str:
    """The SQL of :func:`_gantries`."""
    return f"""WITH {overlay.SQL}, {SIGNS}, {overlay.PAIRS.format(radius=radius).replace("site s", "sign s")},
k AS (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY dist, source_id) AS kk FROM near),
c AS (SELECT sign, gantry, road, carriageway, number, round(dist, 6) AS dist, round(abs((((line_bearing - bearing + 180) % 360) + 360) % 360 - 180), 6) AS angle, {WAYS} FROM k WHERE kk <= 64),
e AS (SELECT *, CASE WHEN road IS NULL OR refs IS NULL THEN 'absent' WHEN list_contains(string_split(refs, ';'), road) THEN 'exact' WHEN highway = 'motorway_link' AND dist <= 5 AND coalesce(angle <= 45, true) THEN 'connector' ELSE 'conflict' END AS evidence,
  CASE WHEN label IS NULL THEN 2 WHEN coalesce((carriageway = 'R' AND label = 'Re') OR (carriageway = 'L' AND label IN ('Li', 'Le')), false) THEN 0 WHEN label IN ('Re', 'Li', 'Le') THEN 1 ELSE 3 END AS label_rank FROM c),
g AS (SELECT *, evidence <> 'conflict' AND coalesce(angle <= 45, true) AS fits FROM e),
b AS (SELECT * FROM g WHERE fits QUALIFY row_number() OVER (PARTITION BY sign, segment, way ORDER BY dist, evidence <> 'exact', coalesce(angle, 180), lane_id) = 1),
o AS (SELECT * FROM g WHERE fits AND lane_nr = number QUALIFY row_number() OVER (PARTITION BY sign, segment, way ORDER BY dist, lane_id) = 1),
w AS (SELECT gantry, segment, way, count(*) AS coverage, count(*) FILTER (evidence = 'exact') AS exact, round(avg(dist), 6) AS d, round(avg(angle), 6) AS a, count(*) FILTER (label_rank = 0) AS l0, count(*) FILTER (label_rank <= 1) AS l1, sum(label_rank) AS ls,
  list(DISTINCT road_id) AS roads, CASE WHEN count(DISTINCT lanes) = 1 THEN min(lanes) END AS osm FROM b GROUP BY ALL),
q AS (SELECT *, rank() OVER (PARTITION BY gantry ORDER BY coverage DESC, exact DESC) = 1 AS first_ FROM w),
n AS (SELECT *, first_ AND d <= min(CASE WHEN first_ THEN d END) OVER (PARTITION BY gantry) + 2 AS near_ FROM q),
r AS (SELECT *, row_number() OVER v AS rk, lead({{'segment': segment, 'way': way, 'coverage': coverage, 'exact': exact, 'l0': l0, 'l1': l1, 'ls': ls, 'd': d, 'a': a, 'roads': roads}}) OVER v AS nx FROM n
  WINDOW v AS (PARTITION BY gantry ORDER BY coverage DESC, exact DESC, near_ DESC, CASE WHEN near_ THEN -l0 END, CASE WHEN near_ THEN -l1 END, CASE WHEN near_ THEN ls END, d, coalesce(a, 180), segment, way)),
u AS (SELECT gantry, count(*) AS size, bool_or(bearing IS NULL) AS blind, list_sort(list(DISTINCT number) FILTER (number IS NOT NULL)) AS numbers FROM sign GROUP BY 1),
t AS (SELECT u.*, r.* EXCLUDE (gantry), string_split(segment, ':') AS p1, string_split(nx.segment, ':') AS p2 FROM u LEFT JOIN r ON r.gantry = u.gantry AND r.rk = 1),
z AS (SELECT *, CASE WHEN p1[2] = '0' AND p1[3] = '0' THEN NULL WHEN way = 'fwd' THEN p1[2] ELSE p1[3] END AS in1, CASE WHEN p1[2] = '0' AND p1[3] = '0' THEN NULL WHEN way = 'fwd' THEN p1[3] ELSE p1[2] END AS out1,
  CASE WHEN p2[2] = '0' AND p2[3] = '0' THEN NULL WHEN nx.way = 'fwd' THEN p2[2] ELSE p2[3] END AS in2, CASE WHEN p2[2] = '0' AND p2[3] = '0' THEN NULL WHEN nx.way = 'fwd' THEN p2[3] ELSE p2[2] END AS out2 FROM t),
y AS (SELECT *, coalesce(nx.segment IS NOT NULL AND ((NOT (segment <> nx.segment AND (coalesce(out1 = in2, false) OR coalesce(out2 = in1, false))) AND coverage = nx.coverage AND exact = nx.exact AND NOT (-l0, -l1, ls) < (-nx.l0, -nx.l1, nx.ls)
    AND NOT (l0 = coverage AND nx.l0 = nx.coverage AND d < nx.d) AND abs(d - nx.d) <= 2 AND coalesce(abs(a - nx.a) <= 5, true)) OR (blind AND list_has_any(roads, nx.roads) AND way <> nx.way)), false) AS tied,
  coalesce(len(numbers), 0) > 0 AND (osm IS NULL OR osm <> len(numbers) OR numbers <> generate_series(1, len(numbers))) AS mismatch FROM z),
f AS (SELECT sign, count(DISTINCT (segment, way)) AS n FROM c GROUP BY 1),
h AS (SELECT sign, bool_or(NOT road_ok) AS no_road, bool_or(road_ok AND NOT ok) AS no_bearing FROM (SELECT sign, segment, way, bool_or(evidence <> 'conflict') AS road_ok, bool_or(fits) AS ok FROM g GROUP BY ALL) GROUP BY 1),
m AS (SELECT s.gantry, max(n) AS candidates FROM sign s JOIN f USING (sign) GROUP BY 1),
x AS (SELECT s.sign, s.gantry, s.number, y.tied, y.mismatch, y.segment AS winner, y.way AS winner_way, CASE WHEN y.coverage = y.size AND NOT y.blind AND y.exact = y.coverage THEN 'high' WHEN y.coverage = y.size THEN 'medium' ELSE 'low' END AS sure, coalesce(m.candidates, 0) AS candidates, h.no_road, h.no_bearing,
    b.lane_id AS lane0, b.dist AS dist0, b.angle AS angle0, b.evidence AS evidence0, CASE WHEN NOT y.mismatch AND s.number IS NOT NULL THEN o.lane_id END AS lane1, o.dist AS dist1, o.angle AS angle1, o.evidence AS evidence1, b.sign IS NOT NULL AND NOT y.tied AS ok
  FROM sign s JOIN y ON y.gantry = s.gantry LEFT JOIN m ON m.gantry = s.gantry LEFT JOIN h ON h.sign = s.sign LEFT JOIN b ON b.sign = s.sign AND b.segment = y.segment AND b.way = y.way LEFT JOIN o ON o.sign = s.sign AND o.segment = y.segment AND o.way = y.way)
SELECT sign, gantry, CASE WHEN ok THEN 'matched' WHEN tied THEN 'ambiguous' ELSE 'unmatched' END AS status, CASE WHEN ok THEN sure END AS confidence, candidates,
  CASE WHEN winner IS NULL THEN (CASE WHEN no_road AND NOT no_bearing THEN 'road_ref_conflict' WHEN no_bearing AND NOT no_road THEN 'bearing_mismatch' ELSE 'no_major_road' END) WHEN tied THEN 'bearing_ambiguous' WHEN NOT ok THEN 'no_major_road' WHEN mismatch THEN 'lane_count_mismatch' WHEN number IS NOT NULL AND lane1 IS NULL THEN 'lane_mapping_missing' END AS reason,
  CASE WHEN ok THEN winner END AS segment, CASE WHEN ok THEN winner_way END AS direction, CASE WHEN ok THEN coalesce(lane1, lane0) END AS lane_id, CASE WHEN ok THEN lane1 END AS applies_to, CASE WHEN ok THEN (CASE WHEN lane1 IS NULL THEN dist0 ELSE dist1 END) END AS dist,
  CASE WHEN ok THEN (CASE WHEN lane1 IS NULL THEN angle0 ELSE angle1 END) END AS angle, CASE WHEN ok THEN (CASE WHEN lane1 IS NULL THEN evidence0 ELSE evidence1 END) END AS ref_quality FROM x"""


def _gantries(spark: SparkSession, sf_dir: str, radius: float) -> DataFrame:
    s = signs(spark, sf_dir)
    near = matching.lanes_near(s.select("sign", "x", "y"), traversal_lanes(spark, sf_dir), "sign", radius)
    return matching.match_gantries(s, near.withColumn("dist", F.round("dist", 6)))


@query(_gantry_sql(80))
def gantry_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signs, the 64 nearest lanes within 80 m each, one traversal for each gantry."""
    return _gantries(spark, sf_dir, 80.0)


@query(_gantry_sql(20))
def gantry_consensus_20m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within the matcher's usual radius."""
    return _gantries(spark, sf_dir, matching.GANTRY_RADIUS_M)


PANELS = """panel AS (SELECT site_id AS panel, x, y, bearing, CASE site_id % 4 WHEN 0 THEN 'DRIP ' || road_ref || ' noord' WHEN 1 THEN 'paneel ' || lower(substr(road_ref, 1, 1)) || '-' || lpad(substr(road_ref, 2), 3, '0') WHEN 2 THEN 'centrum' END AS description, CASE WHEN site_id % 4 IN (0, 1) THEN road_ref END AS hint FROM site)"""


@query(f"""WITH {overlay.SQL}, {PANELS}, {overlay.PAIRS.format(radius=500).replace("site s", "panel s")},
k AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY dist, source_id) AS kk FROM near),
c AS (SELECT panel, hint, bearing, ref, round(dist, 6) AS dist, round(abs((((line_bearing - bearing + 180) % 360) + 360) % 360 - 180), 6) AS angle, {WAYS} FROM k WHERE kk <= 64),
e AS (SELECT *, CASE WHEN hint IS NULL OR refs IS NULL THEN 'absent' WHEN list_contains(string_split(refs, ';'), hint) THEN 'exact' ELSE 'conflict' END AS hinted FROM c),
b AS (SELECT * FROM e WHERE coalesce(angle <= 45, true) QUALIFY row_number() OVER (PARTITION BY panel, segment, way ORDER BY dist, hinted <> 'exact', coalesce(angle, 180), lane_id) = 1),
n AS (SELECT *, dist <= min(dist) OVER (PARTITION BY panel) + 2 AS near_ FROM b),
r AS (SELECT *, row_number() OVER v AS rk, lead({{'d': dist, 'a': angle, 'h': hinted, 'r': road_id}}) OVER v AS nx FROM n WINDOW v AS (PARTITION BY panel ORDER BY near_ DESC, CASE WHEN near_ THEN coalesce(angle, 180) END, CASE WHEN near_ THEN hinted <> 'exact' END, dist, hinted <> 'exact', coalesce(angle, 180), segment, way, lane_id)),
m AS (SELECT panel, count(DISTINCT (segment, way)) AS candidates FROM c GROUP BY 1),
t AS (SELECT p.panel, p.bearing, m.candidates, r.* EXCLUDE (panel, bearing), CASE WHEN nx.d IS NULL OR (hinted = 'exact' AND nx.h <> 'exact') THEN false WHEN p.bearing IS NULL THEN road_id = nx.r OR abs(dist - nx.d) <= 2 ELSE abs(dist - nx.d) <= 2 AND coalesce(abs(angle - nx.a) <= 5, true) END AS tied
  FROM panel p LEFT JOIN m USING (panel) LEFT JOIN r ON r.panel = p.panel AND r.rk = 1),
o AS (SELECT *, CASE WHEN candidates IS NULL THEN 'no_major_road' WHEN segment IS NULL THEN 'bearing_mismatch' WHEN tied THEN (CASE WHEN bearing IS NULL THEN 'direction_ambiguous' ELSE 'bearing_ambiguous' END) WHEN dist > 500 THEN 'no_major_road'
  WHEN dist > 60 AND bearing IS NULL THEN 'extended_requires_bearing' WHEN dist > 60 AND coalesce(angle > 20, true) THEN 'extended_bearing_too_weak' END AS reason FROM t),
s AS (SELECT *, CASE WHEN reason IS NULL THEN 'matched' WHEN candidates IS NOT NULL AND segment IS NULL THEN 'unmatched' WHEN tied THEN 'ambiguous' ELSE 'unsupported' END AS status FROM o)
SELECT panel, status, reason, CASE WHEN status = 'matched' THEN (CASE WHEN bearing IS NULL THEN 'low' WHEN dist > 60 THEN 'medium' ELSE 'high' END) END AS confidence, coalesce(candidates, 0) AS candidates, CASE WHEN status = 'matched' THEN segment END AS segment,
  CASE WHEN status = 'matched' THEN way END AS direction, CASE WHEN status = 'matched' THEN lane_id END AS lane_id, CASE WHEN status = 'matched' THEN dist END AS dist, CASE WHEN status = 'matched' THEN (CASE WHEN hinted <> 'absent' THEN hinted WHEN refs IS NOT NULL THEN 'corridor' ELSE 'absent' END) END AS ref_quality FROM s""")
def drip_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All panels, the 64 nearest lanes within 500 m each."""
    k, road = C("site_id"), C("road_ref")
    text = F.when(k % 4 == 0, F.concat(F.lit("DRIP "), road, F.lit(" noord"))).when(k % 4 == 1, F.concat(F.lit("paneel "), F.lower(F.substring(road, 1, 1)), F.lit("-"), F.lpad(F.substring(road, 2, 9), 3, "0"))).when(k % 4 == 2, F.lit("centrum"))
    panels = overlay.sites(spark, sf_dir).select(k.alias("panel"), "x", "y", "bearing", text.alias("description"))
    near = matching.lanes_near(panels.select("panel", "x", "y"), traversal_lanes(spark, sf_dir), "panel", 500.0)
    return matching.match_panels(near.withColumn("dist", F.round("dist", 6)), panels)


@query(f"""WITH {overlay.SQL}, e AS (SELECT floor((min(lon) - 0) / 0.005)::BIGINT AS x0, floor(max(lon) / 0.005)::BIGINT AS x1, floor(min(lat) / 0.005)::BIGINT AS y0, floor(max(lat) / 0.005)::BIGINT AS y1 FROM site),
t AS (SELECT tx, ty FROM e, generate_series(x0 - 1, x1 + 1) a(tx), generate_series(y0 - 1, y1 + 1) b(ty))
SELECT tx AS tile_x, ty AS tile_y, count(*) AS members, count(*) FILTER (floor(lon / 0.005) = tx AND floor(lat / 0.005) = ty) AS core FROM t, site
WHERE tx BETWEEN floor((lon - 0.0005) / 0.005) AND floor((lon + 0.0005) / 0.005) AND ty BETWEEN floor((lat - 0.0005) / 0.005) AND floor((lat + 0.0005) / 0.005) GROUP BY 1, 2""")
def tile_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spatial.tiles(overlay.sites(spark, sf_dir).select("site_id", "lon", "lat"), 0.005, 0.0005)
    return t.groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("members"), F.count_if("core").alias("core"))


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS loc, CASE WHEN c_custkey % 17 <> 0 THEN c_custkey + 7 END AS nxt FROM customer),
w AS (SELECT loc AS start, loc, 0 AS hops, [loc] AS path FROM c UNION ALL SELECT w.start, c.nxt, hops + 1, list_append(path, c.nxt) FROM w JOIN c ON c.loc = w.loc WHERE c.nxt IS NOT NULL AND NOT list_contains(path, c.nxt) AND hops < 400 AND w.loc <> w.start + 70)
SELECT start, array_to_string(max_by(path, hops), '>') AS path FROM w WHERE loc = start + 70 GROUP BY start""")
def tmc_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every location to the one ten steps on."""
    k = C("c_custkey")
    chain = table(spark, sf_dir, "customer").select(k.alias("loc"), F.when(k % 17 != 0, k + 7).alias("next"))
    pairs = table(spark, sf_dir, "customer").select(k.alias("start"), (k + 70).alias("goal"))
    return chains.walk(chain, pairs, most=400).select("start", F.array_join("path", ">").alias("path"))


@query(f"""WITH {overlay.SQL}, r AS (SELECT site_id, 'A' || (site_id % 4)::VARCHAR AS road, carriageway, lon, lat, km, bearing FROM site WHERE km IS NOT NULL AND carriageway IS NOT NULL),
d AS (SELECT *, (lon - 4.7105::DOUBLE) * 111320.0 * cos(radians(52.5182::DOUBLE)) AS dx, (lat - 52.5182::DOUBLE) * 110540.0 AS dy FROM r WHERE road = 'A1' AND carriageway = 'L')
SELECT site_id, round(dx * sin(radians(30.0)) + dy * cos(radians(30.0)), 3) AS along FROM d WHERE dx * sin(radians(30.0)) + dy * cos(radians(30.0)) > 0 AND abs((((bearing - 30 + 180) % 360) + 360) % 360 - 180) <= 55""")
def sensors_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = overlay.sites(spark, sf_dir).where("km is not null and carriageway is not null").withColumn("road", F.concat(F.lit("A"), (C("site_id") % 4).cast("string")))
    device = {"lon": 4.7105, "lat": 52.5182, "heading": 30.0, "road": "A1", "carriageway": "L"}
    return ahead.ahead_geometric(s, device, 55.0).select("site_id", F.round("along", 3).alias("along"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey % 40 AS device, (o_totalprice / 30) AS along, o_orderkey % 9 = 0 AS held FROM orders),
b AS (SELECT *, CASE WHEN along < 500 THEN 0 WHEN along < 1500 THEN 1 WHEN along < 3000 THEN 2 ELSE 3 END AS band FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY device, band ORDER BY held DESC, along, id) AS k FROM b) SELECT device, band, id, held FROM r WHERE k = 1""")
def distance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), (C("o_custkey") % 40).alias("device"), (C("o_totalprice") / 30).alias("along"), (C("o_orderkey") % 9 == 0).alias("held"))
    return ahead.one_per_band(s, ["device"], [500.0, 1500.0, 3000.0]).select("device", "band", "id", "held")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS line, l_linenumber AS seq, ((l_linenumber + 1) // 2 * 120 + min(l_partkey) % 7 * 0.3::DOUBLE)::DOUBLE AS along, max(l_quantity)::DOUBLE AS speed FROM lineitem GROUP BY 1, 2),
w AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY line ORDER BY along, seq) AS i FROM s),
r AS (SELECT line, i, along, speed, 1 AS node FROM w WHERE i = 1
  UNION ALL SELECT w.line, w.i, CASE WHEN w.along - r.along < 1 THEN r.along ELSE w.along END, CASE WHEN w.along - r.along < 1 THEN (r.speed + w.speed) / 2 ELSE w.speed END, r.node + (w.along - r.along >= 1)::INT FROM r JOIN w ON w.line = r.line AND w.i = r.i + 1),
n AS (SELECT line, node, any_value(along) AS along, arg_max(speed, i) AS speed, max(max(node)) OVER (PARTITION BY line) AS m FROM r GROUP BY line, node),
v AS (SELECT *, lead(along) OVER (PARTITION BY line ORDER BY node) AS along2, lead(speed) OVER (PARTITION BY line ORDER BY node) AS speed2 FROM n WHERE m > 1),
p AS (SELECT line, 0 AS piece, 0.0::DOUBLE AS start, along AS stop, speed FROM v WHERE node = 1
  UNION ALL SELECT line, 1 + (node - 1) * 8 + k, along + (along2 - along) * k / 8, along + (along2 - along) * (k + 1) / 8, speed + (speed2 - speed) * (k + 0.5) / 8 FROM v, generate_series(0, 7) g(k) WHERE along2 IS NOT NULL
  UNION ALL SELECT line, 1 + (m - 1) * 8, along, 600.0::DOUBLE, speed FROM v WHERE node = m)
SELECT line, piece::INTEGER AS piece, round(start, 4) AS start, round(stop, 4) AS stop, round(speed, 1) AS speed FROM p WHERE stop - start >= 0.5""")
def gradient_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose readings come in pairs up to two metres apart."""
    one = _one_per_line(spark, sf_dir)
    along = F.floor((C("l_linenumber") + 1) / 2) * 120 + C("l_partkey") % 7 * 0.3
    s = one.select(C("l_orderkey").alias("line"), C("l_linenumber").alias("seq"), along.cast("double").alias("along"), C("l_quantity").alias("speed"), F.lit(600.0).alias("total"))
    return ahead.gradient(s).select("line", "piece", F.round("start", 4).alias("start"), F.round("stop", 4).alias("stop"), "speed")


@query(f"""WITH {overlay.SQL} SELECT site_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || round(lon, 6)::VARCHAR || ',' || round(lat, 6)::VARCHAR || ']}},"properties":{{"site_id":' || site_id::VARCHAR || CASE WHEN road_ref IS NULL THEN '' ELSE ',"road":"' || road_ref || '"' END || '}}}}' AS feature FROM site""")
def geojson_fc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = overlay.sites(spark, sf_dir)
    return s.select("site_id", geojson.feature(geojson.point("lon", "lat"), {"site_id": C("site_id"), "road": C("road_ref")}).alias("feature"))


@query("""WITH f AS (SELECT n_nationkey AS feed, CASE n_nationkey % 3 WHEN 0 THEN 'realtime' WHEN 1 THEN 'background' ELSE 'maintenance' END AS class, CASE WHEN n_nationkey % 3 = 0 THEN 60 WHEN n_nationkey % 3 = 1 THEN 3600 ELSE 86400 END AS cadence, n_nationkey % 7 = 0 AS in_flight, n_nationkey * 500 AS age, n_nationkey % 11 = 0 AS never FROM nation),
d AS (SELECT * FROM f WHERE NOT in_flight AND (never OR age >= cadence) AND (class = 'realtime' OR (class = 'background' AND 600 >= 300) OR (class = 'maintenance' AND 600 >= 900))),
r AS (SELECT feed, class, row_number() OVER (PARTITION BY class = 'realtime' ORDER BY feed) AS k FROM d) SELECT feed, class FROM r WHERE class = 'realtime' OR k <= 4 - (SELECT count(*) FROM f WHERE in_flight AND class <> 'realtime')""")
def due_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C("n_nationkey")
    kind = F.when(n % 3 == 0, F.lit("realtime")).when(n % 3 == 1, F.lit("background")).otherwise(F.lit("maintenance"))
    cadence = F.when(n % 3 == 0, 60).when(n % 3 == 1, 3600).otherwise(86400)
    feeds = table(spark, sf_dir, "nation").select(n.alias("feed"), kind.alias("class"), cadence.alias("cadence"), (n % 7 == 0).alias("in_flight"), F.when(n % 11 != 0, n * 500).alias("age"))
    return schedule.due(feeds, idle=600).select("feed", "class")


@query("""WITH w AS (SELECT p_partkey AS way, CASE WHEN p_size % 3 = 0 THEN 'yes' WHEN p_size % 3 = 1 THEN 'no' END AS oneway, CASE WHEN p_size % 4 <> 0 THEN (p_size % 14)::VARCHAR END AS lanes, CASE WHEN p_partkey % 6 = 0 THEN (p_size % 3 + 1)::VARCHAR END AS fwd, CASE WHEN p_partkey % 8 = 0 THEN '1' END AS bwd FROM part),
n AS (SELECT way, coalesce(oneway = 'yes', false) AS ow, CASE WHEN lanes::INTEGER BETWEEN 1 AND 12 THEN lanes::INTEGER END AS total, CASE WHEN fwd::INTEGER BETWEEN 1 AND 12 THEN fwd::INTEGER END AS f, CASE WHEN bwd::INTEGER BETWEEN 1 AND 12 THEN bwd::INTEGER END AS b FROM w),
p AS (SELECT *, CASE WHEN ow THEN 'oneway' WHEN f IS NOT NULL AND b IS NOT NULL AND total IS NOT NULL AND f + b <> total THEN 'conflict' WHEN coalesce(f, b) IS NOT NULL AND f IS NOT NULL AND b IS NOT NULL THEN 'tagged'
  WHEN coalesce(f, b) IS NOT NULL AND total IS NOT NULL AND total > coalesce(f, b) THEN 'tagged' WHEN coalesce(f, b) IS NOT NULL THEN 'conflict' WHEN total IS NULL THEN 'assumed' WHEN total = 1 THEN 'shared' WHEN total % 2 = 0 THEN 'even' ELSE 'odd' END AS rule FROM n)
SELECT way, rule, CASE rule WHEN 'oneway' THEN coalesce(total, 1) WHEN 'tagged' THEN coalesce(f, total - b) WHEN 'assumed' THEN 1 WHEN 'even' THEN total // 2 END::INTEGER AS forward, CASE rule WHEN 'oneway' THEN 0 WHEN 'tagged' THEN coalesce(b, total - f) WHEN 'assumed' THEN 1 WHEN 'even' THEN total // 2 END::INTEGER AS backward,
  CASE rule WHEN 'shared' THEN 1 WHEN 'odd' THEN total END::INTEGER AS undirected FROM p""")
def lane_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = C("p_size"), C("p_partkey")
    pairs = [("oneway", F.when(size % 3 == 0, F.lit("yes")).when(size % 3 == 1, F.lit("no"))), ("lanes", F.when(size % 4 != 0, (size % 14).cast("string"))), ("lanes:forward", F.when(key % 6 == 0, (size % 3 + 1).cast("string"))), ("lanes:backward", F.when(key % 8 == 0, F.lit("1")))]
    tags = F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    ways = table(spark, sf_dir, "part").select(key.alias("way"), tags.alias("tags"))
    return lanes.cross_section(ways).select("way", "rule", "forward", "backward", "undirected")


@query("""WITH n AS (SELECT l_orderkey AS way, l_linenumber AS pos, min(l_partkey) % 400 AS node FROM lineitem GROUP BY 1, 2), m AS (SELECT node FROM n GROUP BY 1 HAVING count(DISTINCT way) > 1),
e AS (SELECT way, max(pos) AS last, min(pos) AS first FROM n GROUP BY 1 HAVING count(*) > 1), r AS (SELECT way, node FROM n GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT n.way, n.pos, n.node FROM n JOIN e USING (way) WHERE pos IN (first, last) OR node IN (SELECT node FROM m) OR (n.way, node) IN (SELECT way, node FROM r)),
s AS (SELECT way, pos AS start_pos, lead(pos) OVER (PARTITION BY way ORDER BY pos) AS end_pos, node AS start_node, lead(node) OVER (PARTITION BY way ORDER BY pos) AS end_node FROM c)
SELECT way, start_pos, end_pos, way::VARCHAR || ':' || start_node::VARCHAR || ':' || end_node::VARCHAR AS segment FROM s WHERE end_pos IS NOT NULL""")
def logical_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _one_per_line(spark, sf_dir).select(C("l_orderkey").alias("way"), C("l_linenumber").alias("pos"), (C("l_partkey") % 400).alias("node"))
    return lanes.logical_segments(nodes).select("way", "start_pos", "end_pos", "segment")


@query("""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'A00' || (p_size)::VARCHAR WHEN 1 THEN 'n ' || (p_size)::VARCHAR WHEN 2 THEN 'A' || (p_size)::VARCHAR || ';N' || (p_partkey % 300 + 100)::VARCHAR || ' x9y' WHEN 3 THEN (p_size)::VARCHAR WHEN 4 THEN 'Kruisweg' ELSE 'A0' || (p_size)::VARCHAR || 'a' END AS s FROM part),
w AS (SELECT id, s, unnest(regexp_split_to_array(regexp_replace(upper(s), '\\b([AN])\\s+(\\d)', '\\1\\2', 'g'), '[^A-Z0-9]+')) AS x, generate_subscripts(regexp_split_to_array(regexp_replace(upper(s), '\\b([AN])\\s+(\\d)', '\\1\\2', 'g'), '[^A-Z0-9]+'), 1) AS i FROM t),
r AS (SELECT id, regexp_replace(x, '^([AN]?)0+([0-9])', '\\1\\2') AS x, min(i) AS i FROM w WHERE regexp_full_match(x, '[AN]?\\d+[A-Z]?') GROUP BY 1, 2)
SELECT id, s, (SELECT string_agg(x, ',' ORDER BY i) FROM r WHERE r.id = t.id) AS roads FROM t""")
def road_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = C("p_partkey"), C("p_size").cast("string")
    two = F.concat(F.lit("A"), n, F.lit(";N"), (k % 300 + 100).cast("string"), F.lit(" x9y"))
    s = F.when(k % 6 == 0, F.concat(F.lit("A00"), n)).when(k % 6 == 1, F.concat(F.lit("n "), n)).when(k % 6 == 2, two).when(k % 6 == 3, n).when(k % 6 == 4, F.lit("Kruisweg")).otherwise(F.concat(F.lit("A0"), n, F.lit("a")))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), s.alias("s"))
    return rows.select("id", "s", F.when(F.size(refs.road_refs("s")) > 0, F.array_join(refs.road_refs("s"), ",")).alias("roads"))


@query("""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN p_size::VARCHAR || ' mph' WHEN p_size % 4 = 1 THEN p_size::VARCHAR || ',5' WHEN p_size % 4 = 2 THEN 'signals' ELSE p_size::VARCHAR END AS general, CASE WHEN p_partkey % 3 = 0 THEN '80' WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN 'none' END AS fwd,
  CASE WHEN p_partkey % 5 = 0 THEN '60' END AS bwd, CASE WHEN p_partkey % 7 = 0 THEN '-1' END AS oneway FROM part),
v AS (SELECT id, CASE WHEN oneway = '-1' THEN coalesce(bwd, general) ELSE coalesce(fwd, general) END AS v FROM t)
SELECT id, round(CASE WHEN v LIKE '% mph' THEN replace(v, ' mph', '')::DOUBLE * 1.609344::DOUBLE ELSE try_cast(replace(v, ',', '.') AS DOUBLE) END, 1) AS kmh FROM v""")
def maxspeed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = C("p_partkey"), C("p_size")
    general = F.when(n % 4 == 0, F.concat(n.cast("string"), F.lit(" mph"))).when(n % 4 == 1, F.concat(n.cast("string"), F.lit(",5"))).when(n % 4 == 2, F.lit("signals")).otherwise(n.cast("string"))
    pairs = [("maxspeed", general), ("maxspeed:forward", F.when(k % 3 == 0, F.lit("80")).when((k % 3 == 1) & (k % 2 == 0), F.lit("none"))), ("maxspeed:backward", F.when(k % 5 == 0, F.lit("60"))), ("oneway", F.when(k % 7 == 0, F.lit("-1")))]
    tags = F.map_filter(F.create_map(*[x for key, v in pairs for x in (F.lit(key), v)]), lambda key, v: v.isNotNull())
    return table(spark, sf_dir, "part").select(k.alias("id"), refs.maxspeed_kmh(tags, F.lit("fwd")).alias("kmh"))


@query("""WITH t AS (SELECT p_partkey AS id, p_partkey % 3 AS kind, p_size AS n, p_partkey AS k FROM part)
SELECT id, CASE kind WHEN 0 THEN (CASE WHEN n <= 99 THEN 'A' ELSE 'N' END) || n::VARCHAR WHEN 1 THEN 'N' || n::VARCHAR ELSE 'A' || n::VARCHAR END AS road, CASE WHEN k % 2 = 0 THEN 'R' ELSE 'L' END AS carriageway,
  CASE kind WHEN 0 THEN round(k / 1000.0::DOUBLE, 3) WHEN 1 THEN n + 0.5::DOUBLE ELSE k / 10.0::DOUBLE END AS km FROM t""")
def site_location_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = C("p_partkey"), C("p_size")
    side = lambda r, left: F.when(k % 2 == 0, F.lit(r)).otherwise(F.lit(left))
    name = F.when(k % 3 == 0, F.concat(F.lpad(n.cast("string"), 3, "0"), side("hrr", "hrl"), F.lpad(k.cast("string"), 6, "0"))).when(k % 3 == 1, F.concat(F.lit("N"), n.cast("string"), F.lit(" hmp "), n.cast("string"), F.lit(",5 "), side("Re", "Li"))).otherwise(F.lit("x"))
    # free text is read under every family but one, that of the loop codes and aggregates too
    free = F.when(n % 3 == 0, F.lit("PZH01_1")).when(n % 3 == 1, F.lit("GEO01_1")).otherwise(F.lit("RWS01_1"))
    # a loop code has six digits of metres; what needs more is an id that carries its kilometre
    coded = lambda road, km: F.concat(F.lit("RWS08_"), road, F.lit("_"), side("HRR", "HRL"), F.lit("_"), km, F.lit("_1"))
    loop = F.when(k < 1_000_000, F.lit("GEO01_1")).otherwise(coded(n.cast("string"), F.format_string("%.3f", k / 1000.0)))
    site = F.when(k % 3 == 0, loop).when(k % 3 == 1, free).otherwise(coded(F.concat(F.lit("A"), n.cast("string")), F.format_string("%.1f", k / 10.0)))
    at = refs.site_location(site, name)
    return table(spark, sf_dir, "part").select(k.alias("id"), at["road"].alias("road"), at["carriageway"].alias("carriageway"), at["km"].alias("km"))


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS a, 7 * o_orderkey % (SELECT max(c_custkey) FROM customer) AS b, min(o_totalprice) AS w FROM orders GROUP BY 1, 2),
g AS (SELECT a, b, min(w) AS w FROM (SELECT a, b, w FROM e WHERE a <> b UNION ALL SELECT b, a, w FROM e WHERE a <> b) GROUP BY 1, 2),
d(node, dist) USING KEY (node) AS (SELECT 1::BIGINT, 0.0::DOUBLE UNION
  SELECT g.b, min(d.dist + g.w) FROM d JOIN g ON g.a = d.node LEFT JOIN recurring.d AS k ON k.node = g.b WHERE k.dist IS NULL OR d.dist + g.w < k.dist GROUP BY g.b)
SELECT node, round(dist, 4) AS dist FROM d""")
def route_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one node of a graph of all orders, whose nodes grow with the customers."""
    most = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("most"))
    o = table(spark, sf_dir, "orders").join(F.broadcast(most))
    edges = o.select(C("o_custkey").alias("a"), (7 * C("o_orderkey") % C("most")).alias("b"), C("o_totalprice").alias("w")).where("a <> b")
    return routing.distances(edges, spark.createDataFrame([(1,)], "node long")).select("node", F.round("dist", 4).alias("dist"))


@query("""SELECT c_custkey AS sce, (1000000000 + c_custkey * 1000 + c_custkey % 1000 - 1000000000) // 1000 AS pair FROM customer""")
def camera_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("sce"), routing.pair_of(F.lit(1_000_000_000) + k * 1000 + k % 1000).alias("pair"))


@query("""WITH v AS (SELECT l_orderkey AS line, l_linenumber AS seq, (min(l_partkey) % 1000)::DOUBLE AS x, (min(l_suppkey) % 700)::DOUBLE AS y FROM lineitem GROUP BY 1, 2),
d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS len FROM v WINDOW w AS (PARTITION BY line ORDER BY seq))
SELECT line, seq, round(sum(len) OVER (PARTITION BY line ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS along FROM d""")
def cumulative_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _one_per_line(spark, sf_dir).select(C("l_orderkey").alias("line"), C("l_linenumber").alias("seq"), (C("l_partkey") % 1000).cast("double").alias("x"), (C("l_suppkey") % 700).cast("double").alias("y"))
    return lanes.cumulative(v).select("line", "seq", F.round("along", 4).alias("along"))


@query(f"""WITH {overlay.SQL} SELECT site_id, round(2 * 6371000 * asin(sqrt(least(pow(sin(radians(lat - 52.5182::DOUBLE) / 2), 2) + cos(radians(52.5182::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - 4.7105::DOUBLE) / 2), 2), 1))), 3) AS metres,
  round(((degrees(atan2(sin(radians(lon - 4.7105::DOUBLE)) * cos(radians(lat)), cos(radians(52.5182::DOUBLE)) * sin(radians(lat)) - sin(radians(52.5182::DOUBLE)) * cos(radians(lat)) * cos(radians(lon - 4.7105::DOUBLE)))) % 360) + 360) % 360, 3) AS bearing FROM site""")
def sphere_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = overlay.sites(spark, sf_dir)
    here = (F.lit(4.7105), F.lit(52.5182), C("lon"), C("lat"))
    return s.select("site_id", F.round(geo.haversine(*here), 3).alias("metres"), F.round(geo.initial_bearing(*here), 3).alias("bearing"))
