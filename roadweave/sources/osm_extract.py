"""Roads of OSM extracts (PBF), read by byte ranges and decoded inside tasks.

An extract is a chain of blocks, each behind a header that starts with its kind. The header of a data block is a
fixed text, so Spark's text source, told to split records there, cuts an extract of any size into byte ranges as
it does with lines: no file is read whole, nothing is planned from its contents, and any store that Spark reads
will do. A block tells its own size; a record of another size (a header's text within a block's data, which
compression makes all but impossible) raises instead of being lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, small

#: Road classes that are kept.
DRIVING = ["motorway", "trunk", "primary", "secondary", "motorway_link", "trunk_link", "primary_link", "secondary_link"]
#: Fixed value: how the header of a data block starts (field 1, seven bytes).
DATA_HEADER = "\n\x07OSMData"
ARROW = pa.schema({"osm_id": pa.int64(), "tags": pa.map_(pa.string(), pa.string()), "node_refs": pa.list_(pa.int64()), "node": pa.int64(), "lon": pa.float64(), "lat": pa.float64()})
ELEMENTS = "osm_id long, tags map<string,string>, node_refs array<long>, node long, lon double, lat double"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, the rest as bytes."""
    at, end = 0, len(data)
    while at < end:
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                n, at = _varint(data, at)
            else:
                n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def varints(data: bytes) -> np.ndarray:
    """All varints of a packed field as unsigned 64-bit numbers, without a loop over bytes."""
    octets = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(octets < 128)
    if not len(last):
        return np.zeros(0, np.uint64)
    octets = octets[: last[-1] + 1]
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(octets)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((octets & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def signed(data: bytes) -> np.ndarray:
    """Zigzag numbers of a packed field."""
    v = varints(data)
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def _block(record: bytes) -> bytes:
    """The block of a record: what follows its size; the four bytes after it belong to the next header."""
    at = 0
    while True:
        key, at = _varint(record, at)
        value, at = _varint(record, at)
        if key == 3 << 3:
            break
        at += value  # bytes for indexing, which a header may carry
    if len(record) - at not in (value, value + 4):
        raise ValueError(f"a data block of {value} bytes comes in a record with {len(record) - at} after its header")
    return record[at : at + value]


def _primitives(blob: bytes) -> tuple[list[bytes], int, int, int, list[bytes]]:
    raw = dict(_fields(blob))
    if 1 not in raw and 3 not in raw:
        raise ValueError("blocks are read plain or packed with zlib")
    strings, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for k, v in _fields(raw[1] if 1 in raw else zlib.decompress(raw[3])):
        if k == 1:
            strings = [s for f, s in _fields(v) if f == 1]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k in (19, 20):  # offsets are plain int64, so negative ones come as their complement
            v = v - (1 << 64) if v >> 63 else v
            lat0, lon0 = (v, lon0) if k == 19 else (lat0, v)
    return strings, grain, lat0, lon0, groups


def _way(way: bytes, strings: list[bytes], classes: frozenset[bytes] | None) -> tuple | None:
    f = dict(_fields(way))
    tags = dict(zip((strings[i] for i in varints(f.get(2, b""))), (strings[i] for i in varints(f.get(3, b""))), strict=True))
    if classes is not None and tags.get(b"highway") not in classes:
        return None
    return f[1], [(k.decode("utf-8", "replace"), v.decode("utf-8", "replace")) for k, v in tags.items()], np.cumsum(signed(f.get(8, b"")))


def osm_elements(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """Ways (osm_id, tags, node_refs) and nodes (node, lon, lat) of extracts in one pass: a row has one of the two.

    With ``classes`` only ways with one of these values of ``highway``. Nodes may be dense or plain; places off the
    globe are none. Tasks take byte ranges (``spark.sql.files.maxPartitionBytes``) and hold one unpacked block.
    """
    wanted = None if classes is None else frozenset(c.encode() for c in classes)

    def rows(**columns: object) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ARROW], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for record in (cell.as_py() for cell in b.column(0)):
                if len(record) <= 4 or record[4:15] == b"\n\tOSMHeader":
                    continue  # what stands before the first data block
                strings, grain, lat0, lon0, groups = _primitives(_block(record))
                ways, ids, lats, lons = [], [], [], []
                for g in groups:
                    plain = []
                    for k, item in _fields(g):
                        if k == 1:
                            f = dict(_fields(item))
                            plain.append([(f[n] >> 1) ^ -(f[n] & 1) for n in (1, 8, 9)])
                        elif k == 2:
                            f = dict(_fields(item))
                            for into, n in ((ids, 1), (lats, 8), (lons, 9)):
                                into.append(np.cumsum(signed(f.get(n, b""))))
                        elif k == 3 and (way := _way(item, strings, wanted)):
                            ways.append(way)
                    if plain:
                        for into, values in zip((ids, lats, lons), np.array(plain, np.int64).T, strict=True):
                            into.append(values)
                if ways:
                    yield rows(**dict(zip(("osm_id", "tags", "node_refs"), map(list, zip(*ways)), strict=True)))
                if ids:
                    lon, lat = (1e-9 * (first + grain * np.concatenate(v)) for v, first in ((lons, lon0), (lats, lat0)))
                    valid = (np.abs(lon) <= 180) & (np.abs(lat) <= 90)
                    yield rows(node=np.concatenate(ids)[valid], lon=lon[valid], lat=lat[valid])

    lines = spark.read.text(path, lineSep=DATA_HEADER).select(F.col("value").cast("binary").alias("record"))
    return lines.mapInArrow(run, ELEMENTS)


def osm_roads(spark: SparkSession, path: str) -> DataFrame:
    """Driving roads (osm_id, highway, name, ref, node_refs, line, tags, shared): ways with a missing node are left out.

    ``shared``: the nodes that several ways use. Each block is parsed once. Nodes that no kept way uses go before the
    shuffle where the kept ways' nodes are few enough to be sent to all tasks, else in the join. Of ways or nodes that
    several extracts hold one counts.
    """
    parsed = materialize(osm_elements(spark, path, DRIVING).where("node is not null or size(node_refs) >= 2"))
    ways = parsed.where("osm_id is not null").select("osm_id", "tags", "node_refs").dropDuplicates(["osm_id"])
    use = materialize(ways.select("osm_id", F.posexplode("node_refs").alias("pos", "node")))
    several = materialize(use.groupBy("node").agg((F.min("osm_id") != F.max("osm_id")).alias("several")))
    nodes = parsed.where("node is not null").select("node", "lon", "lat").join(small(several), "node").dropDuplicates(["node"])
    placed = use.join(nodes, "node")
    lines = placed.groupBy("osm_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("p"),
        F.array_sort(F.collect_set(F.when(F.col("several"), F.col("node")))).alias("shared"),
    )
    whole = ways.join(lines, "osm_id").where(F.size("p") == F.size("node_refs"))
    tag = lambda k: F.try_element_at("tags", F.lit(k)).alias(k)
    line = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("line")
    return whole.select("osm_id", tag("highway"), tag("name"), tag("ref"), "node_refs", line, "tags", "shared")
