"""XML feeds through Spark's xml source.

Each feed has a fixed schema. Parts whose inner structure varies are read as XML text, and
values are taken from them wherever they stand (:func:`any_text`). Compressed files work as they
are. Functions give typed DataFrames; missing elements are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, refs

POINT = "struct<x:double,y:double>"


def rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").option("mode", "PERMISSIVE").schema(schema).load(path)


def any_text(xml: Column | str, *names: str) -> Column:
    """Text of the first element of this name anywhere in the fragment; the first name that has one."""
    x = F.col(xml) if isinstance(xml, str) else xml
    whole = F.concat(F.lit("<r>"), x, F.lit("</r>"))
    one = lambda n: F.nullif(F.trim(F.xpath_string(whole, F.lit(f"(//*[local-name()='{n}'])[1]"))), F.lit(""))
    return F.coalesce(*[one(n) for n in names])


def all_texts(xml: Column | str, name: str) -> Column:
    x = F.col(xml) if isinstance(xml, str) else xml
    found = F.xpath(F.concat(F.lit("<r>"), x, F.lit("</r>")), F.lit(f"//*[local-name()='{name}']/text()"))
    return F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != "")


def point(xml: Column | str) -> Column:
    lon, lat = any_text(xml, "longitude").try_cast("double"), any_text(xml, "latitude").try_cast("double")
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("x"), lat.alias("y")))


def end_line(xml: Column | str) -> Column:
    """Line between the start and end coordinates, where both exist and differ."""
    x = F.col(xml) if isinstance(xml, str) else xml
    whole = F.concat(F.lit("<r>"), x, F.lit("</r>"))
    at = lambda part, n: F.xpath_string(whole, F.lit(f"(//*[local-name()='{part}']//*[local-name()='{n}'])[1]")).try_cast("double")
    a, b = (F.struct(at(p, "longitude").alias("x"), at(p, "latitude").alias("y")) for p in ("linearCoordinatesStartPoint", "linearCoordinatesEndPoint"))
    known = F.coalesce(a["x"] + a["y"] + b["x"] + b["y"], F.lit(None)).isNotNull()
    return F.when(known & (a != b), F.array(a, b))


def flag(text: Column) -> Column:
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)


TEXTS = "struct<values:struct<value:array<struct<_VALUE:string,_lang:string>>>>"


def _text(c: str) -> Column:
    return F.nullif(F.trim(F.get(F.col(f"{c}.values.value"), F.lit(0))["_VALUE"]), F.lit(""))


SITE = f"""_id string, _version string, measurementSiteName {TEXTS}, measurementEquipmentTypeUsed {TEXTS}, measurementSiteNumberOfLanes string, measurementSide string,
measurementSiteRecordVersionTime string, measurementSiteLocation string, measurementSpecificCharacteristics array<struct<_index:string,measurementSpecificCharacteristics:struct<
specificLane:string,period:string,specificMeasurementValueType:string,specificVehicleCharacteristics:struct<lengthCharacteristic:array<struct<comparisonOperator:string,vehicleLength:string>>>>>>"""


def measurement_sites(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sites, characteristics) of a measurement site table."""
    raw = rows(spark, path, "measurementSiteRecord", SITE)
    at = "measurementSiteLocation"
    code = lambda m: F.xpath_string(F.concat(F.lit("<r>"), F.col(at), F.lit("</r>")), F.lit(f"(//*[local-name()='alertCMethod4{m}PointLocation']/*[local-name()='alertCLocation']/*[local-name()='specificLocation'])[1]")).try_cast("int")
    name = _text("measurementSiteName")
    sites = raw.select(
        F.col("_id").alias("id"), name.alias("name"), _text("measurementEquipmentTypeUsed").alias("equipment_type"), F.col("measurementSiteNumberOfLanes").try_cast("int").alias("num_lanes"), F.col("measurementSide").alias("side"),
        F.col("_version").try_cast("int").alias("version"), F.col("measurementSiteRecordVersionTime").try_cast("timestamp").alias("record_version_time"), any_text(at, "openlrBearing").try_cast("int").alias("openlr_bearing"),
        point(at).alias("geom"), end_line(at).alias("line_geom"), code("Primary").alias("tmc_primary"), code("Secondary").alias("tmc_secondary"), any_text(at, "alertCDirectionCoded").alias("tmc_direction"), refs.site_location(F.col("_id"), name).alias("at"),
    ).select("*", "at.road", "at.carriageway", F.col("at.source").alias("carriageway_source"), "at.km").drop("at")
    c = raw.select(F.col("_id").alias("site_id"), F.explode("measurementSpecificCharacteristics").alias("o")).select("site_id", F.col("o._index").try_cast("int").alias("index"), F.col("o.measurementSpecificCharacteristics").alias("c"))
    kind = F.col("c.specificMeasurementValueType")
    bounds = F.col("c.specificVehicleCharacteristics.lengthCharacteristic")
    bound = lambda *ops: F.try_element_at(F.filter(F.transform(bounds, lambda b: F.when(b["comparisonOperator"].isin(*ops), b["vehicleLength"].try_cast("double"))), lambda v: v.isNotNull()), F.lit(-1))
    characteristics = c.select(
        "site_id", "index", F.regexp_extract("c.specificLane", r"\Alane(\d+)\z", 1).try_cast("int").alias("lane"), F.col("c.period").try_cast("int").alias("period_s"), F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, F.lit(2), F.length(kind))).alias("value_type"),
        bound("greaterThan", "greaterThanOrEqualTo").alias("veh_length_min"), bound("lessThan", "lessThanOrEqualTo").alias("veh_length_max"),
    )
    return sites, characteristics


MEASURED = """measurementSiteReference struct<_id:string>, measurementTimeDefault string, measuredValue array<struct<_index:string,measuredValue:struct<basicData:struct<_type:string,
vehicleFlow:struct<vehicleFlowRate:string>,averageVehicleSpeed:struct<_numberOfInputValuesUsed:string,_standardDeviation:string,speed:string>,travelTimeType:string,
travelTime:struct<_accuracy:string,_numberOfInputValuesUsed:string,_supplierCalculatedDataQuality:string,duration:string>>,measuredValueExtension:string>>>"""


def _measured(spark: SparkSession, path: str) -> DataFrame:
    raw = rows(spark, path, "siteMeasurements", MEASURED)
    v = raw.select(F.col("measurementSiteReference._id").alias("site_id"), F.col("measurementTimeDefault").try_cast("timestamp").alias("measured_at"), F.explode("measuredValue").alias("m"))
    v = v.select("site_id", "measured_at", F.col("m._index").try_cast("int").alias("index"), F.col("m.measuredValue.basicData").alias("b"), F.col("m.measuredValue.measuredValueExtension").alias("extension"))
    return v.where("index is not null and b is not null").withColumn("value_type", F.element_at(F.split(F.coalesce("b._type", F.lit("")), ":"), -1))


def traffic_speed(spark: SparkSession, path: str) -> DataFrame:
    """Flow and speed rows; -1 and speeds from no input are null; a missing input count means one."""
    v = _measured(spark, path)
    is_speed = F.col("value_type").contains("TrafficSpeed")
    s = F.col("b.averageVehicleSpeed")
    n = F.when(is_speed, F.when(s["_numberOfInputValuesUsed"].isNull(), F.lit(1)).otherwise(s["_numberOfInputValuesUsed"].try_cast("int")))
    speed = s["speed"].try_cast("double")
    return v.select(
        "site_id", "index", "measured_at", "value_type", F.when(F.col("value_type").contains("TrafficFlow"), F.col("b.vehicleFlow.vehicleFlowRate").try_cast("double")).alias("flow_veh_h"),
        F.when(is_speed & (speed != -1) & (F.coalesce(n, F.lit(1)) > 0), speed).alias("speed_kmh"), n.alias("n_inputs"), F.when(is_speed, s["_standardDeviation"].try_cast("double")).alias("std_dev"),
    )


def travel_time(spark: SparkSession, path: str) -> DataFrame:
    """Live and reference durations a segment."""
    t = F.col("b.travelTime")
    return _measured(spark, path).where(F.col("value_type").contains("TravelTime")).select(
        F.col("site_id").alias("segment_id"), "index", "measured_at", F.col("b.travelTimeType").alias("travel_time_type"), t["duration"].try_cast("double").alias("duration_s"),
        any_text("extension", "duration").try_cast("double").alias("ref_duration_s"), t["_accuracy"].try_cast("double").alias("accuracy"), t["_numberOfInputValuesUsed"].try_cast("int").alias("n_inputs"), t["_supplierCalculatedDataQuality"].alias("quality"),
    )


def truck_parking(spark: SparkSession, path: str) -> DataFrame:
    raw = rows(spark, path, "parkingRecord", f"_id string, parkingName {TEXTS}, operator string, parkingLocation string, parkingNumberOfSpaces string, parkingSpaces string")
    spaces = F.concat_ws("", *[F.concat(F.lit(f"<{n}>"), F.col(c), F.lit(f"</{n}>")) for c, n in (("parkingNumberOfSpaces", "numberOfParkingSpaces"), ("parkingSpaces", "parkingSpaces"))])
    capacity = any_text(spaces, "numberOfParkingSpaces", "totalParkingCapacity", "parkingCapacity", "totalNumberOfParkingSpaces")
    return raw.select(F.col("_id").alias("id"), _text("parkingName").alias("name"), any_text("operator", "contactDetailsName", "name", "organisationName").alias("operator"), capacity.try_cast("int").alias("capacity"), point("parkingLocation").alias("geom"))


def situations(spark: SparkSession, path: str, category: str) -> DataFrame:
    """One row a situation record; points by their coordinates, other places by their position list."""
    record = "struct<_id:string,_type:string,situationRecordVersionTime:string,probabilityOfOccurrence:string,safetyRelatedMessage:string,source:string,validity:string,locationReference:struct<_type:string,_VALUE:string>,temporarySpeedLimit:string>"
    record = record.replace("locationReference:struct<_type:string,_VALUE:string>", "locationReference:string")
    raw = rows(spark, path, "situation", f"_id string, overallSeverity string, situationRecord array<{record}>")
    r = raw.select(F.col("_id").alias("id"), F.col("overallSeverity").alias("severity"), F.explode("situationRecord").alias("r")).select("id", "severity", "r.*")
    kind = F.element_at(F.split(F.coalesce("_type", F.lit("")), ":"), -1)
    line = geo.positions(any_text("locationReference", "posList"))
    limit = F.when(kind.contains("SpeedManagement"), F.col("temporarySpeedLimit").try_cast("double").cast("int"))
    return r.select(
        "id", F.col("_id").alias("record_id"), F.lit(category).alias("category"), kind.alias("record_type"), "severity", F.col("probabilityOfOccurrence").alias("probability"), flag(F.col("safetyRelatedMessage")).alias("safety_related"),
        any_text("source", "value").alias("source"), any_text("validity", "overallStartTime").try_cast("timestamp").alias("valid_from"), any_text("validity", "overallEndTime").try_cast("timestamp").alias("valid_to"), F.col("situationRecordVersionTime").try_cast("timestamp").alias("version_time"),
        limit.alias("speed_limit_kmh"), point("locationReference").alias("point"), line.alias("line"),
    )


def panels(spark: SparkSession, path: str) -> DataFrame:
    """Information panels with their last status, from the controller and the status part of one file."""
    inner = "_vmsIndex:string,vms:struct<description:string,vmsType:string,physicalSupport:string,vmsLocation:string,vmsConfiguration:struct<numberOfDisplayAreas:string>>"
    c = rows(spark, path, "vmsController", f"_id string, vms array<struct<{inner}>>").select(F.col("_id").alias("controller_id"), F.explode("vms").alias("v"))
    status = "_vmsIndex:string,vmsStatus:struct<workingStatus:string,statusUpdateTime:string,vmsMessage:string>"
    s = rows(spark, path, "vmsControllerStatus", f"vmsControllerReference struct<_id:string>, statusUpdateTime string, vmsStatus array<struct<{status}>>")
    s = s.select(F.col("vmsControllerReference._id").alias("controller_id"), "statusUpdateTime", F.explode("vmsStatus").alias("s"))
    last = s.select(
        "controller_id", F.coalesce(F.col("s._vmsIndex").try_cast("int"), F.lit(0)).alias("vms_index"), F.col("s.vmsStatus.workingStatus").alias("working_status"), F.coalesce("s.vmsStatus.statusUpdateTime", "statusUpdateTime").alias("status_update_time"),
        F.nullif(F.array_join(all_texts("s.vmsStatus.vmsMessage", "textLine"), "\n"), F.lit("")).alias("display_text"), any_text("s.vmsStatus.vmsMessage", "imageData").alias("image_data"), any_text("s.vmsStatus.vmsMessage", "imageFormat").alias("image_format"),
    )
    at = "v.vms.vmsLocation"
    signs = c.select(
        "controller_id", F.coalesce(F.col("v._vmsIndex").try_cast("int"), F.lit(0)).alias("vms_index"), any_text("v.vms.description", "value").alias("description"), F.col("v.vms.vmsType").alias("vms_type"), F.col("v.vms.physicalSupport").alias("physical_support"),
        any_text(at, "bearing").try_cast("int").alias("bearing"), F.col("v.vms.vmsConfiguration.numberOfDisplayAreas").try_cast("int").alias("num_display_areas"), point(at).alias("geom"),
    )
    return signs.join(last, ["controller_id", "vms_index"], "left")


def parking_status(spark: SparkSession, path: str) -> DataFrame:
    raw = rows(spark, path, "parkingRecordStatus", "parkingRecordReference struct<_id:string>, parkingStatusOriginTime string, parkingOccupancy struct<parkingNumberOfVacantSpaces:string,parkingNumberOfOccupiedSpaces:string,parkingOccupancy:string>")
    o = F.col("parkingOccupancy")
    return raw.select(F.col("parkingRecordReference._id").alias("parking_id"), F.col("parkingStatusOriginTime").try_cast("timestamp").alias("origin_time"), o["parkingNumberOfVacantSpaces"].try_cast("int").alias("vacant"), o["parkingNumberOfOccupiedSpaces"].try_cast("int").alias("occupied"), o["parkingOccupancy"].try_cast("double").alias("occupancy_pct"))


def emission_zones(spark: SparkSession, path: str) -> DataFrame:
    raw = rows(spark, path, "urbanVehicleAccessRegulation", "_id string, name string, controlledZoneType string, status string, urlForFurtherInformation string, trafficRegulationOrder string")
    line = geo.positions(any_text("trafficRegulationOrder", "posList"), polygon=True)
    return raw.select(F.col("_id").alias("id"), any_text("name", "value").alias("name"), F.col("controlledZoneType").alias("zone_type"), "status", any_text("trafficRegulationOrder", "value").alias("authority"), F.col("urlForFurtherInformation").alias("info_url"), line.alias("polygon"))


def matrix_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(locations, states) of a sign event feed, each with its place ``pos`` in the feed.

    :func:`roadweave.operators.relational.first_and_latest` makes one row a sign of them. The
    aspect shown is the first that isn't blank, else the first.
    """
    raw = rows(spark, path, "event", "sign_id struct<uuid:string>, ts_state string, lanelocation struct<road:string,carriageway:string,lane:string,km:string>, display string")
    raw = raw.withColumn("pos", F.monotonically_increasing_id()).select("*", F.trim("sign_id.uuid").alias("uuid")).where("uuid <> ''")
    at = F.col("lanelocation")
    locations = raw.where(at.isNotNull()).select("uuid", "pos", F.trim(at["road"]).alias("road"), F.trim(at["carriageway"]).alias("carriageway"), at["lane"].try_cast("int").alias("lane"), at["km"].try_cast("double").alias("km"))
    tag = r"<(?:\w+:)?(\w+)((?:\s[^<>]*)?)(?:/>|>([^<]*)<)"
    names, attributes, values = (F.regexp_extract_all("display", F.lit(tag), F.lit(i)) for i in (1, 2, 3))
    yes = lambda a, k: a.rlike(f'(?i){k}\\s*=\\s*"true"')
    aspects = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.struct(F.element_at(names, i).alias("aspect_type"), F.nullif(F.trim(F.element_at(values, i)), F.lit("")).alias("value"), yes(F.element_at(attributes, i), "flashing").alias("flashing"), yes(F.element_at(attributes, i), "red_ring").alias("red_ring")))
    aspects = F.when(F.size(names) > 0, aspects)
    primary = F.coalesce(F.try_element_at(F.filter(aspects, lambda a: a["aspect_type"] != "blank"), F.lit(1)), F.try_element_at(aspects, F.lit(1)))
    states = raw.where("display is not null").select("uuid", "pos", F.trim("ts_state").alias("ts"), primary.alias("p"), aspects.alias("aspects")).select("uuid", "pos", "ts", "p.aspect_type", "p.value", "p.flashing", "p.red_ring", "aspects")
    return locations, states
