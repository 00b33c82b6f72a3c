"""Feed registry and the one ingest path: read, merge into the snapshot as the feed wants it, record the run.

Keys are unique in every snapshot: of rows that share a key the last in the file holds. A feed says
how its rows are merged, what an absent row means, and which table of children comes with it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational, snapshot
from ..operators.buckets import Change, Store
from ..scratch import materialize
from . import binary_feeds, json_feeds, osm_extract, xml_feeds

@dataclass(frozen=True)
class Feed:
    """How often a feed comes, how it is read, by which keys and how its rows are stored.

    ``merge``: upsert, or changed (equal rows keep their stamp). ``absent``: what rows that a file doesn't
    hold come to: keep, prune, or guarded (prune, but an empty file is refused; with ``category`` rows
    of a category that a file has nothing of stay). ``children``: name and parent column of the second
    table that the reader gives; children of the parents in a file are replaced as a whole.
    """

    name: str
    kind: str
    cadence: int
    keys: tuple[str, ...] = ("id",)
    read: Callable[[SparkSession, str], DataFrame | tuple[DataFrame, ...]] | None = None
    merge: str = "upsert"
    absent: str = "keep"
    category: str | None = None
    children: tuple[str, str, str] | None = None
    note: str = field(default="", compare=False)


def _signs(spark: SparkSession, path: str) -> DataFrame:
    return relational.first_and_latest(*xml_feeds.matrix_events(spark, path))


def _situations(category: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: xml_feeds.situations(spark, path, category)


#: Cadences in seconds and classes of the feeds.
FEEDS = [
    Feed("trafficspeed", "realtime", 60, ("site_id", "index"), xml_feeds.traffic_speed, merge="changed"),
    Feed("traveltime", "realtime", 60, ("segment_id", "index"), xml_feeds.travel_time),
    *[Feed(c, "realtime", 60, ("record_id",), _situations(c), absent="prune") for c in ("incident", "srti", "bridge_opening", "closure", "speed_limit")],
    Feed("roadworks", "background", 900, ("record_id",), _situations("roadworks"), absent="prune"),
    Feed("panels", "realtime", 60, ("controller_id", "vms_index"), xml_feeds.panels),
    Feed("matrix_signs", "realtime", 60, ("uuid",), _signs, absent="prune"),
    Feed("parking_status", "realtime", 60, ("parking_id",), xml_feeds.parking_status),
    Feed("charging", "realtime", 60, ("id",), json_feeds.charging, children=("charging_availability", "id", "cp_id")),
    Feed("incidents", "realtime", 300, ("record_id",), json_feeds.incidents, absent="guarded", category="category"),
    Feed("tariffs", "background", 3600, ("id",), json_feeds.tariffs),
    Feed("charging_ocpi", "background", 60, note="registered, read by nothing"),
    Feed("speed_cameras", "background", 604800, ("id",), json_feeds.speed_cameras, absent="guarded"),
    Feed("truck_parking", "background", 86400, ("id",), xml_feeds.truck_parking),
    Feed("emission_zones", "background", 86400, ("id",), xml_feeds.emission_zones),
    Feed("traffic_signs", "background", 86400, ("id",), json_feeds.traffic_signs),
    Feed("measurement_sites", "background", 3600, ("id",), xml_feeds.measurement_sites, children=("measurement_characteristics", "id", "site_id")),
    Feed("measurement_places", "maintenance", 86400, ("id",), binary_feeds.measurement_places),
    Feed("chain", "maintenance", 604800, ("loc_nr",), binary_feeds.chain_table),
    Feed("sign_shapes", "maintenance", 86400, ("uuid",), binary_feeds.sign_shapes),
    Feed("osm_roads", "maintenance", 604800, ("osm_id",), osm_extract.osm_roads),
]
BY_NAME = {f.name: f for f in FEEDS}


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f.name, f.kind, f.cadence) for f in FEEDS], "feed string, class string, cadence int")


def merged(stored: DataFrame | None, batch: DataFrame, feed: Feed, now: Column) -> DataFrame:
    """The feed's new snapshot from the stored one (None: none yet) and a batch with unique keys."""
    keys = list(feed.keys)
    if feed.absent == "guarded" and batch.isEmpty():
        raise ValueError(f"{feed.name}: the file has no rows, which would empty the snapshot: refused")
    if stored is None:
        return batch.withColumn(snapshot.STAMP, now)
    if feed.absent == "guarded" and not feed.category:
        snapshot.shrinks(stored, batch)  # a cut file must not delete what it lacks
    if feed.merge == "changed":
        new = snapshot.merge_changed(stored, batch, keys, [c for c in batch.columns if c not in keys], now).select(*stored.columns)
    else:
        new = snapshot.upsert(stored, batch, keys, now)
    if feed.absent == "keep":
        return new
    if feed.category:
        return snapshot.guarded_prune(new, batch, keys, feed.category)
    return new.join(batch.select(*keys).distinct(), keys, "left_semi").select(*stored.columns)


def replaced(stored: DataFrame | None, children: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """The new table of children: those of all ``parents`` in the batch are replaced, by nothing where it has none."""
    if stored is None:
        return children
    gone = parents.select(F.col(key).alias(parent)).distinct()
    return stored.join(gone, parent, "left_anti").select(*stored.columns).unionByName(children.select(*stored.columns))


def ingest(spark: SparkSession, feed: Feed, path: str, folder: str, now: str, changed: bool = True, etag: str | None = None, last_modified: str | None = None) -> DataFrame:
    """Read a landed file, merge it into the feed's snapshot and publish; the run's row, also on error.

    A feed and its children are published as one version, of which only changed buckets are new. An
    error leaves the snapshots as they were. A file that has not ``changed`` isn't read. The run is
    added to the ledger, ``folder``/runs, with what the next conditional request needs.
    """
    stamp = F.lit(now).cast("timestamp")
    try:
        status, rows, message = ("ok", _store(spark, feed, path, folder, stamp), None) if changed else ("not_modified", 0, None)
    except Exception as e:  # the ledger records what failed; the snapshot is untouched
        status, rows, message = "error", 0, str(e)[:2000]
    ran = spark.createDataFrame([(feed.name, status, rows, message, etag, last_modified)], "feed string, status string, rows long, message string, etag string, last_modified string")
    ran = ran.select("feed", "status", "rows", stamp.alias("finished"), "message", "etag", "last_modified")
    ran.coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    return ran


def _store(spark: SparkSession, feed: Feed, path: str, folder: str, stamp: Column) -> int:
    got = feed.read(spark, path)
    batch, *rest = got if isinstance(got, tuple) else (got,)
    # the place in the file decides between rows of one key; written once, so that all steps see one order
    batch = materialize(snapshot.last_of_batch(batch.withColumn("_place", F.monotonically_increasing_id()), feed.keys, "_place").drop("_place"))
    # what a file lacks may be in any bucket
    changes = [Change(feed.name, batch, feed.keys, lambda old, new: merged(old, new, feed, stamp), whole=feed.absent != "keep")]
    if feed.children and rest:
        name, key, parent = feed.children
        of = batch.select(F.col(key).alias(parent))
        changes.append(Change(name, rest[0], [parent], lambda old, new: replaced(old, new, batch, key, parent), touched=of.unionByName(rest[0].select(parent))))
    Store(spark, f"{folder}/{feed.name}").commit(changes)
    return batch.count()


def stored(spark: SparkSession, folder: str, feed: Feed, table: str | None = None) -> DataFrame | None:
    """The published rows of a feed, or of its children's ``table``; None before its first file."""
    return Store(spark, f"{folder}/{feed.name}").read(table or feed.name)


def conditions(spark: SparkSession, folder: str, feed: str) -> tuple[str | None, str | None]:
    """ETag and modification time of the feed's last run that read or needed no file."""
    runs = spark.read.parquet(f"{folder}/runs").where((F.col("feed") == feed) & F.col("status").isin("ok", "not_modified"))
    last = runs.orderBy(F.col("finished").desc()).select("etag", "last_modified").first()
    return (last.etag, last.last_modified) if last else (None, None)
