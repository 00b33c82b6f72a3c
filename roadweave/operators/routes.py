"""The questions of the list routes: other operators joined over whole tables; limits are those of a request.

Boxes are (min lon, min lat, max lon, max lat), borders included. Every result has a fixed order, so that a
limit always takes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, refs
from . import relational as rel
from . import spatial

#: The six kinds of situations.
CATEGORIES = ("incident", "srti", "roadworks", "bridge_opening", "closure", "speed_limit")

#: Degrees by which the map of speeds looks beyond its viewport for sensors.
MAP_MARGIN = 0.004


def usable_readings(measurements: DataFrame, characteristics: DataFrame) -> DataFrame:
    """Measurements (site_id, index, ...) with their ``lane``: only of characteristics that name a lane and no vehicle length."""
    lanes = characteristics.where("lane is not null and veh_length_min is null and veh_length_max is null")
    return measurements.join(lanes.select("site_id", "index", "lane"), ["site_id", "index"])


def lane_readings(measurements: DataFrame, characteristics: DataFrame) -> DataFrame:
    """One row a (site, lane): speed, flow, n_inputs, std_dev, ts, each the greatest of its kind of value."""
    of = lambda kind, c: F.max(F.when(F.col("value_type") == kind, F.col(c)))
    return usable_readings(measurements, characteristics).groupBy("site_id", "lane").agg(
        of("TrafficSpeed", "speed_kmh").alias("speed"), of("TrafficFlow", "flow_veh_h").alias("flow"), of("TrafficSpeed", "n_inputs").alias("n_inputs"), of("TrafficSpeed", "std_dev").alias("std_dev"), F.max("measured_at").alias("ts")
    )


def speed_locations(measurements: DataFrame, sites: DataFrame, characteristics: DataFrame, chains: DataFrame, limit: int, by_km: bool) -> DataFrame:
    """One row a place, road, way and side, with ``lanes`` (an array of merged readings) and ``truncated``.

    ``sites`` are those in the request's scope. The first 6 * ``limit`` of them with usable readings take
    part, by kilometre (if ``by_km``) and id. A site without a road takes that of its chain, else the only
    one known at its point, side and direction. Where the first site of a place has no kilometre, the
    first with a road and one gives carriageway and kilometre (without one: the last with a road).
    """
    usable = usable_readings(measurements, characteristics).select("site_id").distinct()
    order = ([F.col("km").asc_nulls_last()] if by_km else []) + [F.col("site_id")]
    chosen = sites.where("lon is not null and lat is not null").join(usable, "site_id", "left_semi").orderBy(*order).limit(limit * 6)
    # 6 * limit rows at most: one window over all of them is bounded by the request
    chosen = chosen.withColumn("seq", F.row_number().over(Window.orderBy(*order)))
    chosen = chosen.join(chains.select(F.col("loc_nr").alias("tmc_primary"), "road_number", "hecto_dir"), "tmc_primary", "left").withColumns({"lon": F.round("lon", 5), "lat": F.round("lat", 5)})

    at = Window.partitionBy("lon", "lat", "side", "tmc_direction")
    known = F.when(F.col("road").isNotNull(), F.struct("road", "carriageway", "carriageway_source"))
    rows = chosen.withColumns({"_least": F.min(known).over(at), "_most": F.max(known).over(at)})
    fill = F.col("road").isNull() & F.col("road_number").isNull() & F.col("_least").isNotNull() & F.col("_least").eqNullSafe(F.col("_most"))
    own = lambda c: F.when(fill, F.col(f"_least.{c}")).otherwise(F.col(c))
    rows = rows.withColumns({"_road": F.coalesce("road", "road_number", F.when(fill, F.col("_least.road"))), "_way": own("carriageway"), "_source": own("carriageway_source")})
    place = F.struct("lon", "lat", F.col("_road").alias("road"), F.coalesce("_way", "tmc_direction").alias("way"), "side")
    rows = rows.withColumns({"place": place, "roadway": refs.roadway_code("name")})

    first = F.min_by(F.struct(F.col("_way").alias("carriageway"), F.col("_source").alias("carriageway_source"), "km", "tmc_direction", "hecto_dir", "vild_bearing"), "seq")
    given = F.struct("carriageway", "carriageway_source", "km")
    places = rows.groupBy("place").agg(
        F.min("seq").alias("seq"),
        first.alias("first"),
        F.coalesce(F.min_by(given, F.when(F.col("road").isNotNull() & F.col("km").isNotNull(), F.col("seq"))), F.max_by(given, F.when(F.col("road").isNotNull(), F.col("seq")))).alias("later"),
        F.min_by("openlr_bearing", F.when(F.col("openlr_bearing").isNotNull(), F.col("seq"))).alias("openlr_bearing"),
        F.nullif(F.max(F.coalesce("num_lanes", F.lit(0))), F.lit(0)).alias("num_lanes"),
        F.array_sort(F.collect_set("site_id")).alias("sources"),
        F.when(F.min("roadway") == F.max("roadway"), F.min("roadway")).alias("roadway"),
    )
    pick = lambda c: F.when(F.col("first.km").isNotNull() | F.col("later").isNull(), F.col(f"first.{c}")).otherwise(F.col(f"later.{c}")).alias(c)
    places = rel.page(places, [F.col("seq")], limit).select(
        "place", "seq", *[pick(c) for c in ("carriageway", "carriageway_source", "km")], *[f"first.{c}" for c in ("tmc_direction", "hecto_dir", "vild_bearing")], "openlr_bearing", "num_lanes", "roadway", "truncated",
        F.coalesce(F.get(F.filter("sources", lambda s: s.contains("_MONIBAS_")), F.lit(0)), F.get("sources", F.lit(0))).alias("site_id"),
        F.size("sources").alias("source_count"),
        F.array_sort(F.array_distinct(F.transform(F.filter("sources", lambda s: s.contains("_")), lambda s: F.get(F.split(s, "_"), F.lit(1))))).alias("systems"),
    )

    kept = rows.select("site_id", "seq", "place")
    readings = lane_readings(measurements.join(kept, "site_id", "left_semi"), characteristics).join(kept, "site_id")
    merged = rel.merge_lanes(readings, ["place", "lane"])
    lanes = merged.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("lane", "speed", "flow", "n_inputs", "std_dev"))).alias("lanes"), F.max("ts").alias("measured_at"))
    return places.join(lanes, "place").select("place.lon", "place.lat", "place.road", "place.side", *[c for c in places.columns if c != "place"], "lanes", "measured_at")


def fallback_bearings(locations: DataFrame, sections: DataFrame, key: str, radius: float = 0.002) -> DataFrame:
    """``bearing`` and ``bearing_source``: the chain's, else the location code's, else that of the nearest section.

    ``sections``: section, ax, ay, bx, by in degrees, in which the nearest is sought and its azimuth taken.
    A section without length gives no bearing but its name as source. Without sections both stay null.
    """
    without = F.col("vild_bearing").isNull() & F.col("openlr_bearing").isNull()
    points = locations.where(without).select(key, F.col("lon").alias("x"), F.col("lat").alias("y"))
    azimuth = F.when((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")), F.round(F.pmod(F.degrees(F.atan2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), F.lit(360.0)), 1))
    found = spatial.nearest(points, sections, key, "section", radius).join(sections.select("section", azimuth.alias("_azimuth")), "section").select(key, "_azimuth", F.lit("meetlocatie_vak").alias("_nearest"))
    bearing = F.coalesce(F.col("vild_bearing").cast("double"), F.pmod(F.col("openlr_bearing").cast("int"), F.lit(360)).cast("double"), "_azimuth")
    source = F.when(F.col("vild_bearing").isNotNull(), F.lit("vild")).when(F.col("openlr_bearing").isNotNull(), F.lit("openlr")).otherwise(F.col("_nearest"))
    return locations.join(found, key, "left").withColumns({"bearing": bearing, "bearing_source": source}).drop("_azimuth", "_nearest", "vild_bearing", "openlr_bearing")


def widened(box: tuple[float, float, float, float], margin: float = MAP_MARGIN) -> tuple[float, float, float, float]:
    """The box in which the map of speeds looks for sensors; its points are clipped to the viewport afterwards."""
    return box[0] - margin, box[1] - margin, box[2] + margin, box[3] + margin


def viewport(rows: DataFrame, box: tuple[float, float, float, float], order: Sequence[Column], limit: int, only: Column | None = None) -> DataFrame:
    """The first ``limit`` points in the box that also fulfil ``only``, in this order."""
    inside = rows.where(geo.point_in_box("lon", "lat", box))
    return (inside if only is None else inside.where(only)).orderBy(*order).limit(limit)


def travel_times(times: DataFrame, sites: DataFrame, box: tuple[float, float, float, float], limit: int) -> DataFrame:
    """Travel times (segment_id, index, ...) whose segment's line, or point where it has none, meets the box.

    ``sites``: id, lon, lat and line (array of points in degrees, null where unknown); each row gets these and
    ``fid``, segment and index.
    """
    placed = sites.select(F.col("id").alias("segment_id"), "lon", "lat", "line")
    inside = F.when(F.size("line") > 1, geo.line_in_box("line", box)).otherwise(geo.point_in_box("lon", "lat", box))
    met = placed.where(inside)
    rows = times.join(met, "segment_id").withColumn("fid", F.concat_ws(":", "segment_id", "index"))
    return rows.orderBy("segment_id", "index").limit(limit)


def situations(feeds: dict[str, DataFrame], box: tuple[float, float, float, float], limit: int, category: str | None = None) -> DataFrame:
    """Records of all feeds (or of one ``category``) in the box, with their category; unknown categories raise."""
    for c in [*feeds, *([category] if category else [])]:
        if c not in CATEGORIES:
            raise ValueError(f"category must be one of {', '.join(CATEGORIES)}")
    rows = None
    for c, feed in feeds.items():
        part = feed.withColumn("category", F.lit(c))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return viewport(rows, box, [F.col("record_id"), F.col("category")], limit, None if category is None else F.col("category") == category)


def charge_points(points: DataFrame, connectors: DataFrame, box: tuple[float, float, float, float], limit: int, available: bool) -> DataFrame:
    """Charge points in the box with their connectors in order; with ``available`` only those with a free one."""
    inside = points.where(geo.point_in_box("lon", "lat", box))
    if available:
        inside = inside.join(connectors.where("available > 0").select("cp_id"), F.col("id") == F.col("cp_id"), "left_semi")
    page = inside.orderBy("id").limit(limit)
    own = connectors.join(page.select(F.col("id").alias("cp_id")), "cp_id", "left_semi")
    lists = own.groupBy("cp_id").agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in connectors.columns if c not in ("cp_id", "idx")]))).alias("connectors"))
    return page.join(lists, F.col("id") == F.col("cp_id"), "left").drop("cp_id")


def parkings(places: DataFrame, status: DataFrame, box: tuple[float, float, float, float], limit: int) -> DataFrame:
    """Truck parkings in the box with their status, if there is one."""
    return viewport(places, box, [F.col("id")], limit).join(status, F.col("id") == F.col("parking_id"), "left").drop("parking_id")


def matrix_signs(signs: DataFrame, states: DataFrame, assignments: DataFrame, links: DataFrame, roads: DataFrame, box: tuple[float, float, float, float], limit: int, geometry: str = "source") -> DataFrame:
    """Signs in the box, one a road, carriageway, lane and hundredth of a kilometre, with state, match and road.

    Of signs of one slot that with the latest state stays (without states the least uuid); only then the
    limit counts. ``geometry``: ``source``, ``matched`` or ``best`` (the matched point of matched signs that
    have one). ``links`` holds a row for each link of a sign; the one of index 0 counts.
    """
    inside = signs.where(geo.point_in_box("lon", "lat", box)).join(states, "uuid", "left").withColumn("_km", F.round("km", 2))
    kept = rel.latest(inside, ["road", "carriageway", "lane", "_km"], [F.col("ts_state").desc_nulls_last(), F.col("uuid")]).drop("_km")
    page = kept.orderBy("uuid").limit(limit).withColumn("gantry_id", refs.gantry_id("road", "carriageway", "km"))
    return _matched(page, "uuid", assignments, links, roads, geometry)


def _matched(page: DataFrame, key: str, assignments: DataFrame, links: DataFrame, roads: DataFrame, geometry: str) -> DataFrame:
    """Rows of a page with their assignment, first link and road, at the place that ``geometry`` names."""
    first = links.where("link_index = 0").drop("link_index")
    rows = page.join(assignments, key, "left").join(first, key, "left").join(roads, F.col("matched_road_id") == F.col("osm_id"), "left").drop("osm_id")
    matched = {"source": F.lit(False), "matched": F.lit(True), "best": F.coalesce((F.col("match_status") == "matched") & F.col("matched_lon").isNotNull(), F.lit(False))}[geometry]
    point = lambda c: F.when(matched, F.col(f"matched_{c}")).otherwise(F.col(c))
    return rows.withColumns({"lon": point("lon"), "lat": point("lat")}).drop("matched_lon", "matched_lat")


def panels(shown: DataFrame, assignments: DataFrame, links: DataFrame, roads: DataFrame, box: tuple[float, float, float, float], limit: int, geometry: str = "source") -> DataFrame:
    """Panels (controller_id, vms_index, lon, lat, what they show) in the box by controller and index, with match and road.

    ``assignments`` and ``links`` are those of panels, under ``source_key``, the text of :func:`refs.panel_key`; a
    panel without them stays, with nulls. Of the links of a panel that of index 0 counts; ``geometry`` as for
    :func:`matrix_signs`.
    """
    page = viewport(shown, box, [F.col("controller_id"), F.col("vms_index")], limit).withColumn("source_key", refs.panel_key("controller_id", "vms_index"))
    return _matched(page, "source_key", assignments, links, roads, geometry).drop("source_key")


def location_codes(rows: DataFrame, box: tuple[float, float, float, float], limit: int, shape: str) -> DataFrame:
    """Points (lon, lat), lines (``line``) or areas (``ring``, no holes) of the location table that meet the box, by id.

    ``shape`` is point, line or area. ``properties`` are the id and those of the row's ``raw`` values that are not
    null; a raw ``id`` wins. Rows without a place are left out.
    """
    inside = {"point": lambda: geo.point_in_box("lon", "lat", box), "line": lambda: geo.line_in_box("line", box), "area": lambda: geo.polygon_in_box("ring", box)}[shape]()
    page = rows.where(inside).orderBy("id").limit(limit)
    raw = F.coalesce(F.map_filter("raw", lambda k, v: v.isNotNull()), F.create_map().cast("map<string,string>"))
    both = F.map_concat(F.create_map(F.lit("id"), F.col("id").cast("string")), raw)
    return page.withColumn("properties", F.when(F.map_contains_key(raw, "id"), raw).otherwise(both)).drop("raw")


def cameras(rows: DataFrame, box: tuple[float, float, float, float], limit: int) -> DataFrame:
    """Speed cameras (id, lon, lat and what is known of them) in the box, by id."""
    return viewport(rows, box, [F.col("id")], limit)


def camera_routes(rows: DataFrame, box: tuple[float, float, float, float], limit: int) -> DataFrame:
    """Routes between two cameras (sc_id, sce_id, street, line) that meet the box, by their cameras; those without a line go."""
    return rows.where(geo.line_in_box("line", box)).orderBy("sc_id", "sce_id").limit(limit)


def lane_lines(lanes: DataFrame, connections: DataFrame, roads: DataFrame, box: tuple[float, float, float, float], lane_cap: int, connection_cap: int) -> tuple[DataFrame, DataFrame]:
    """(lanes with the tags of their road, connections with both lanes' cross-sections), each with ``truncated``.

    Lanes and connections are segments (ax, ay, bx, by) that meet the box, in the order of their ids. A
    connection without one of its lanes is left out, a lane without its road too.
    """
    meets = geo.segment_in_box("ax", "ay", "bx", "by", box)
    shown = rel.page(lanes.where(meets).join(roads, "road_id"), [F.col("id")], lane_cap)
    end = lambda side: lanes.select(F.col("id").alias(f"{side}_lane_id"), F.col("lane_nr").alias(f"{side}_lane_nr"), F.col("lane_count").alias(f"{side}_lane_count"))
    joined = connections.where(meets).join(end("from"), "from_lane_id").join(end("to"), "to_lane_id")
    return shown, rel.page(joined, [F.col("id")], connection_cap)


def selected_roads(roads: DataFrame, box: tuple[float, float, float, float] | None = None, road_ids: DataFrame | None = None, segment_ids: DataFrame | None = None) -> DataFrame:
    """Roads (osm_id, ax, ay, bx, by, node_refs) that meet the box or whose id is listed, alone or before the colon of a segment.

    The lists are tables with one column; without any of the three it raises.
    """
    named = [d.select(F.split(F.col(d.columns[0]).cast("string"), ":")[0].cast("long").alias("osm_id")) for d in (road_ids, segment_ids) if d is not None]
    ids = [roads.where(geo.segment_in_box("ax", "ay", "bx", "by", box)).select("osm_id")] if box is not None else []
    return _with_ids(roads, ids + named)


def _with_ids(roads: DataFrame, ids: list[DataFrame]) -> DataFrame:
    if not ids:
        raise ValueError("a box, roads or segments are required")
    wanted = ids[0]
    for d in ids[1:]:
        wanted = wanted.unionByName(d)
    return roads.join(wanted, "osm_id", "left_semi")


def context_roads(roads: DataFrame, selected: DataFrame, degrees: float, overrides: DataFrame | None = None) -> DataFrame:
    """The selected roads, those that meet their extent widened by ``degrees`` or share a node, and those of overrides.

    Without selected roads only those of ``overrides`` (osm_id) are left. Nodes meet in a join, so their
    number is not bounded; only the four numbers of the extent come to the driver.
    """
    low = selected.agg(F.min(F.least("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by"))).first()
    ids = [selected.select("osm_id")]
    if low[0] is not None:
        ids.append(roads.where(geo.segment_in_box("ax", "ay", "bx", "by", widened(tuple(low), degrees))).select("osm_id"))
        nodes = selected.select(F.explode("node_refs").alias("node")).distinct()
        ids.append(roads.select("osm_id", F.explode("node_refs").alias("node")).join(nodes, "node", "left_semi").select("osm_id"))
    if overrides is not None:
        ids.append(overrides.select("osm_id"))
    return _with_ids(roads, ids)


def roads_in_view(roads: DataFrame, box: tuple[float, float, float, float], zoom: float, cap: int) -> DataFrame:
    """Roads of the zoom's classes that meet the box, the first ``cap`` by id, with ``truncated``; none below zoom 7."""
    return rel.page(rel.tiered(roads, zoom).where(geo.segment_in_box("ax", "ay", "bx", "by", box)), [F.col("osm_id")], cap)


def match_json(fields: Sequence[str], lon: str = "matched_lon", lat: str = "matched_lat") -> Column:
    """A match as compact JSON: ``fields`` in the given order, then ``matched_point``; nulls are written out."""
    at = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.array(lon, lat))
    return F.to_json(F.struct(*fields, at.alias("matched_point")), {"ignoreNullFields": "false"})
