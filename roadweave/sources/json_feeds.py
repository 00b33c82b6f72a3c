"""JSON and CSV feeds with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refs

#: The country's bounds in degrees.
LAT, LON = (45.0, 56.0), (2.0, 9.0)

ITEM = "id:string,incidentType:string,road:string,from:string,to:string,reason:string,distance:double,delay:double,HM:double,codeDirection:string,segmentId:string,label:string,start:string,polyline:string,fromLoc:struct<lat:double,lon:double>,toLoc:struct<lat:double,lon:double>,loc:struct<lat:double,lon:double>"
INCIDENTS = f"success boolean, dateTime string, roads array<struct<segments:array<struct<jams:array<struct<{ITEM}>>,roadworks:array<struct<{ITEM}>>,radars:array<struct<{ITEM}>>>>>>"


def _inside(lon: Column, lat: Column) -> Column:
    return F.coalesce(lat.between(*LAT) & lon.between(*LON), F.lit(False))


def _point(loc: Column) -> Column:
    return F.when(_inside(loc["lon"], loc["lat"]), F.struct(loc["lon"].alias("x"), loc["lat"].alias("y")))


def incidents(spark: SparkSession, path: str) -> DataFrame:
    """Jams, roadworks and radars; raises where the feed says it failed or has no roads.

    A line is the decoded polyline, else the straight way between its ends, else null; all points
    have to lie within the bounds. Rows need a whole number as id.
    """
    raw = spark.read.option("multiLine", "true").schema(INCIDENTS).json(path)
    good = F.coalesce(F.col("success"), F.lit(False)) & F.col("roads").isNotNull()
    raw = raw.withColumn("roads", F.when(good, F.col("roads")).otherwise(F.raise_error(F.lit("the feed reports no success or holds no roads"))))
    seg = raw.select(F.col("dateTime").try_cast("timestamp").alias("poll_time"), F.explode("roads").alias("r")).select("poll_time", F.explode("r.segments").alias("s"))
    kinds = [seg.select("poll_time", F.lit(k).alias("category"), F.inline(f"s.{k}")) for k in ("jams", "roadworks", "radars")]
    items = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).withColumn("id", F.when(F.col("id").rlike(r"\A\s*[+-]?\d+\s*\z"), F.trim("id").try_cast("long"))).where("id is not null")
    decoded = refs.polyline("polyline")
    decoded = F.when(F.forall(decoded, lambda p: _inside(p["x"], p["y"])) & (F.size(decoded) >= 2), decoded)
    a, b = _point(F.col("fromLoc")), _point(F.col("toLoc"))
    straight = F.when(a.isNotNull() & b.isNotNull(), F.array(a, b))
    radar = F.col("category") == "radars"
    return items.select(
        F.concat_ws(":", "category", F.col("id").cast("string")).alias("record_id"), "id", "category", F.col("incidentType").alias("incident_type"), "road", F.col("from").alias("from_label"), F.col("to").alias("to_label"), "reason", F.col("distance").alias("distance_m"), F.col("delay").alias("delay_s"),
        F.col("HM").alias("hm"), F.col("codeDirection").alias("code_direction"), F.col("segmentId").alias("segment_id"), "label", F.col("start").try_cast("timestamp").alias("valid_from"), "poll_time", F.when(radar, _point(F.col("loc"))).alias("point"), F.when(~radar, F.coalesce(decoded, straight)).alias("line"),
    )


CAMERAS = "result array<struct<id:string,land:string,status:string,lat:string,lng:string,ort:string,strasse:string,beschreibung:string,vmax:string,type:string,drehbar:string,richtung:string,create_time:string,edit_time:string>>"


def speed_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Active cameras of the country; malformed rows are left out, a missing list raises."""
    raw = spark.read.option("multiLine", "true").schema(CAMERAS).json(path)
    raw = raw.withColumn("result", F.coalesce("result", F.raise_error(F.lit("the feed holds no result list")).cast(raw.schema["result"].dataType)))
    c = raw.select(F.inline("result")).where("land = 'NL' and status = 'A'")
    lat, lon, bearing = F.col("lat").try_cast("double"), F.col("lng").try_cast("double"), F.trim("richtung").try_cast("int")
    c = c.where(F.col("id").try_cast("long").isNotNull() & _inside(lon, lat))
    when = lambda n: F.timestamp_seconds(F.col(n).try_cast("long"))
    return c.select(
        F.col("id").try_cast("long").alias("id"), "status", F.col("ort").alias("city"), F.col("strasse").alias("street"), F.col("beschreibung").alias("description"), F.when(F.col("vmax").rlike(r"\A\s*\d+\s*\z"), F.trim("vmax").try_cast("int")).alias("speed_limit_kmh"), F.col("type").alias("camera_type"),
        F.when(F.col("drehbar").isNotNull(), ~F.col("drehbar").isin("0", "false", "")).alias("rotatable"), F.when(bearing.between(0, 359), bearing).alias("bearing_deg"), when("create_time").alias("created_at"), when("edit_time").alias("edited_at"), lon.alias("lon"), lat.alias("lat"),
    )


AVAILABLE = "total:int,available:int,power_max:double,power_type:string,connector_type:string,connector_format:string,tariff_ids:array<string>"
CHARGING = f"features array<struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<cpo_id:string,address:string,city:string,operator_name:string,owner_name:string,open:boolean,last_updated:string,availabilities:array<struct<{AVAILABLE}>>>>>"


def charging(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(charge points, availability rows by position)."""
    f = spark.read.option("multiLine", "true").schema(CHARGING).json(path).select(F.inline("features"))
    at = F.col("geometry.coordinates")
    points = f.select("id", "properties.*", F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat")).drop("availabilities").withColumn("last_updated", F.col("last_updated").try_cast("timestamp"))
    return points, f.select(F.col("id").alias("cp_id"), F.posexplode("properties.availabilities").alias("idx", "a")).select("cp_id", "idx", "a.*")


def tariffs(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, currency string, party_id string, country_code string, elements variant, last_updated string"
    return spark.read.option("multiLine", "true").schema(schema).json(path).withColumn("last_updated", F.col("last_updated").try_cast("timestamp"))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Manual connection rules."""
    schema = "action string, s_segment string, s_travel string, s_lane int, t_segment string, t_travel string, t_lane int"
    return spark.read.option("multiLine", "true").schema(schema).json(path)


#: The sign table's columns in the file.
SIGNS = "id rvvCode status placement side bearing drivingDirection fraction roadName roadSectionId nwbVersion countyCode countyName townName imageUrl textSigns firstSeenOn lastSeenOn placedOn removedOn latitude longitude".split()


def traffic_signs(spark: SparkSession, path: str) -> DataFrame:
    """Traffic signs from CSV with a header; rows without numeric place are left out."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    raw = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in SIGNS])
    day = lambda c: F.substring(c, 1, 10).try_cast("date")
    out = raw.select(
        "id", F.col("rvvCode").alias("rvv_code"), "status", "placement", "side", F.col("bearing").try_cast("int").alias("bearing"), F.col("drivingDirection").alias("driving_direction"), F.col("fraction").try_cast("double").alias("fraction"), F.col("roadName").alias("road_name"), F.col("roadSectionId").try_cast("long").alias("road_section_id"),
        F.col("nwbVersion").alias("nwb_version"), F.col("countyCode").alias("county_code"), F.col("countyName").alias("county_name"), F.col("townName").alias("town_name"), F.col("imageUrl").alias("image_url"), F.try_parse_json("textSigns").alias("text_signs"), day("firstSeenOn").alias("first_seen"), day("lastSeenOn").alias("last_seen"),
        day("placedOn").alias("placed_on"), day("removedOn").alias("removed_on"), F.col("longitude").try_cast("double").alias("lon"), F.col("latitude").try_cast("double").alias("lat"),
    )
    return out.where("lon is not null and lat is not null")
