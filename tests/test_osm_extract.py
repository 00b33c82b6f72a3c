"""Extracts made by a small writer of the format, read by byte ranges."""

import random
import struct
import zlib

import numpy as np
import pytest

from roadweave.sources import osm_extract


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zigzag(v):
    return varint(v << 1 if v >= 0 else (-v << 1) - 1)


def fld(k, v):
    return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v


def deltas(values):
    return b"".join(zigzag(v - u) for u, v in zip([0, *values], values))


def dense(nodes):
    """nodes: (id, lat, lon) in units of the grain."""
    ids, lats, lons = zip(*nodes)
    return fld(2, fld(1, deltas(ids)) + fld(8, deltas(lats)) + fld(9, deltas(lons)))


def plain(i, lat, lon):
    return fld(1, varint(1 << 3) + zigzag(i) + varint(8 << 3) + zigzag(lat) + varint(9 << 3) + zigzag(lon))


def way(strings, i, tags, nodes):
    at = lambda w: strings.index(w) if w in strings else (strings.append(w), len(strings) - 1)[1]
    keys, vals = b"".join(varint(at(k)) for k in tags), b"".join(varint(at(v)) for v in tags.values())
    return fld(3, fld(1, i) + fld(2, keys) + fld(3, vals) + fld(8, deltas(nodes)))


def block(groups, strings=("",), packed=True, extra=b""):
    data = fld(1, b"".join(fld(1, s.encode()) for s in strings)) + b"".join(fld(2, g) for g in groups) + extra
    return fld(2, len(data)) + fld(3, zlib.compress(data)) if packed else fld(1, data)


def extract(*blocks, index=b""):
    out = b""
    for kind, body in ((b"OSMHeader", fld(4, b"DenseNodes")), *((b"OSMData", b) for b in blocks)):
        head = fld(1, kind) + (fld(2, index) if index else b"") + fld(3, len(body))
        out += struct.pack(">I", len(head)) + head + body
    return out


def put(folder, name, data):
    (folder / name).write_bytes(data)
    return str(folder / name)


def roads(spark, path):
    return {r.osm_id: r for r in osm_extract.osm_roads(spark, path).collect()}


def test_varints():
    rng = random.Random(5)
    values = [rng.getrandbits(rng.randint(1, 64)) for _ in range(2000)] + [0, 127, 128, (1 << 64) - 1]
    assert osm_extract.varints(b"".join(map(varint, values))).tolist() == values
    around = [rng.randint(-(1 << 62), 1 << 62) for _ in range(500)] + [0, -1, 1]
    assert osm_extract.signed(b"".join(map(zigzag, around))).tolist() == around
    assert osm_extract.varints(b"").tolist() == []


def test_osm_extract(spark, tmp_path):
    strings = [""]
    motorway = {"highway": "motorway", "ref": "A9"}
    ways = way(strings, 1, motorway, [10, 11]) + way(strings, 2, {"highway": "motorway"}, [11, 12]) + way(strings, 3, {"highway": "footway"}, [10, 12])
    ways += way(strings, 4, {"highway": "motorway"}, [10, 99]) + way(strings, 5, {"highway": "primary"}, [10]) + way(strings, 6, {}, [10, 11])
    nodes = dense([(10, 520000000, 47000000), (11, 520001000, 47001000), (12, 520002000, 47002000)])
    for index in (b"", b"any index \x00\x18"):
        got = roads(spark, put(tmp_path, f"x{len(index)}.pbf", extract(block([nodes, ways], strings), index=index)))
        assert set(got) == {1, 2} and (got[1].highway, got[1].ref, got[2].ref, got[1].node_refs) == ("motorway", "A9", None, [10, 11])
        assert [(round(p.x, 4), round(p.y, 4)) for p in got[1].line] == [(4.7, 52.0), (4.7001, 52.0001)]
        assert (got[1].shared, got[2].shared) == ([10, 11], [11]) and got[1].tags == motorway  # way 4 uses 10, too


def test_plain_nodes_offsets_and_plain_blocks(spark, tmp_path):
    """Nodes outside dense groups, negative ids and places, a block's own grain and offsets, blocks that aren't packed."""
    strings = [""]
    ways = way(strings, 7, {"highway": "trunk", "name": "Zürich – 北"}, [-3, 5, 6, 5])
    shifted = varint(17 << 3) + varint(1000) + varint(19 << 3) + varint((1 << 64) - 2_000_000_000) + varint(20 << 3) + varint(3_000_000_000)
    first = block([plain(-3, -338000000, 1510000000) + plain(5, 10, -20)], packed=False)
    second = block([dense([(6, 500, 700), (8, 500 * 10**6, 0)])], extra=shifted)
    got = roads(spark, put(tmp_path, "x.pbf", extract(first, second, block([ways], strings))))
    assert [(round(p.x, 6), round(p.y, 6)) for p in got[7].line] == [(151.0, -33.8), (-2e-06, 1e-06), (3.0007, -1.9995), (-2e-06, 1e-06)]
    assert got[7].name == "Zürich – 北" and got[7].shared == []
    seen = osm_extract.osm_elements(spark, str(tmp_path / "x.pbf")).where("node is not null").collect()
    assert {r.node for r in seen} == {-3, 5, 6}, "a latitude of 498 degrees is none"


@pytest.mark.parametrize("size", [61, 997, 20_000, 1 << 27])
def test_ranges(spark, tmp_path, size):
    """However an extract is cut into ranges, each block is read once."""
    rng = random.Random(size)
    blocks = []
    for b in range(60):
        nodes = [(b * 50 + i, rng.randint(-(10**8), 10**8), rng.randint(-(10**8), 10**8)) for i in range(rng.randint(1, 50))]
        strings = [""]
        blocks.append(block([dense(nodes), way(strings, b, {"highway": "primary"}, [n[0] for n in nodes])], strings, packed=b % 3 > 0))
    path = put(tmp_path, "x.pbf", extract(*blocks))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, str(size))
        found = osm_extract.osm_elements(spark, path)
        if size == 997:
            assert found.rdd.getNumPartitions() > 10
        rows = found.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r.osm_id for r in rows if r.osm_id is not None) == list(range(60))
    assert all(len(r.node_refs) == sum(1 for q in rows if q.node is not None and q.node // 50 == r.osm_id) for r in rows if r.osm_id is not None)


def test_several_extracts_and_none(spark, tmp_path):
    """Rows that two extracts share count once; an extract without ways gives no roads."""
    nodes = dense([(1, 520000000, 47000000), (2, 520001000, 47001000)])
    for name in ("a.pbf", "b.pbf"):
        strings = [""]
        put(tmp_path, name, extract(block([nodes, way(strings, 1, {"highway": "primary"}, [1, 2])], strings)))
    got = roads(spark, str(tmp_path / "*.pbf"))
    assert len(got) == 1 and len(got[1].line) == 2 and got[1].shared == []
    assert roads(spark, put(tmp_path, "empty.pbf", extract(block([nodes])))) == {}
    assert roads(spark, put(tmp_path, "bare.pbf", extract())) == {}


def test_header_text_within_a_block_raises(spark, tmp_path):
    strings = ["", "\n\x07OSMData"]
    path = put(tmp_path, "x.pbf", extract(block([dense([(1, 1, 1)])], strings, packed=False)))
    with pytest.raises(Exception, match="comes in a record with|index out of range"):
        osm_extract.osm_elements(spark, path).collect()


def test_numbers_of_a_block_keep_their_precision():
    ids = np.cumsum(osm_extract.signed(deltas([12_000_000_000, 12_000_000_001, -5])))
    assert ids.tolist() == [12_000_000_000, 12_000_000_001, -5]
