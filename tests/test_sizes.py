"""Registered queries against their SQL on tables with larger keys or more rows than the given ones."""

import os

import duckdb
import pytest

from roadweave import plans

from .test_queries import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture
def equal(spark, tmp_path):
    """``equal(query, table="SELECT ...")`` compares a query with its SQL over these tables, and the given ones for the rest."""

    def compare(name: str, **tables: str) -> list:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
            if f.removesuffix(".parquet") not in tables:
                os.symlink(f"{SF}/{f}", tmp_path / f)
        for t, sql in tables.items():
            con.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
            con.execute(f"create or replace view {t} as select * from '{tmp_path}/{t}.parquet'")
        df = plans.queries()[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
        cur = con.execute(plans.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert got == sorted(str(tuple(plain(r[names.index(c)]) for c in columns)) for r in cur.fetchall())
        return got

    return compare


def test_kilometres_of_long_keys(equal):
    """six digits hold no metres from a thousand kilometres on."""
    assert equal("site_location_parse", part=f"SELECT * REPLACE (p_partkey + 999_900 AS p_partkey) FROM '{SF}/part.parquet'")


def test_halves_of_kilometres(equal):
    """kilometres whose third decimal is a five, below and above zero, and those that round to it."""
    assert equal("gantry_ids", customer=f"SELECT * REPLACE (c_custkey + range AS c_custkey, (range - 500) / 10.0::DOUBLE AS c_acctbal) FROM (FROM '{SF}/customer.parquet' LIMIT 1), range(4000)")


def test_equal_streets_and_ways_meet_once(equal, monkeypatch):
    """250 kinds of camera and 300 of way, however many there are."""
    from roadweave.operators import routing

    met, whole = [], routing.ways_of_street
    monkeypatch.setattr(routing, "ways_of_street", lambda ways, cameras: met.append((ways.count(), cameras.count())) or whole(ways, cameras))
    assert len(equal("street_ways", customer=f"SELECT * REPLACE (range AS c_custkey) FROM (FROM '{SF}/customer.parquet' LIMIT 1), range(2000)", part=f"SELECT * REPLACE (range AS p_partkey) FROM (FROM '{SF}/part.parquet' LIMIT 1), range(2000)")) == 2000
    assert met == [(300, 250)]


@pytest.mark.parametrize("name", ["map_match", "connected_ids", "distance_join_25", "knn_topk"])
def test_cells_are_not_broadcast(spark, name, monkeypatch):
    """the rows of all cells are many more than Spark's estimate, which would send them to the driver."""
    from roadweave.operators import matching, spatial

    plans_seen = []
    for at in (spatial, matching):
        monkeypatch.setattr(at, "materialize", lambda df, whole=at.materialize: plans_seen.append(df) or whole(df))
    plans_seen.append(plans.queries()[name](spark, SF))
    text = "".join(df._jdf.queryExecution().executedPlan().toString() for df in plans_seen)
    joins = [x for x in text.split("\n") if "Join" in x and "_cx" in x]
    assert joins and not [x for x in joins if "Broadcast" in x]


def test_pruned_sites_match_as_all_pairs(spark):
    """few lanes near a site bound what is ranked; the result is that of all pairs, whatever the sample."""
    from roadweave.functions import refs
    from roadweave.operators import matching, spatial
    from roadweave.plans import overlay

    sites, lanes = overlay.sites(spark, "/root/testdata/sf0.01").where("site_id % 3 = 0").localCheckpoint(), overlay.lanes(spark, "/root/testdata/sf0.01").localCheckpoint()
    pairs = spatial.distance_join(sites.withColumn("site_refs", refs.road_refs("road_ref")), lanes.withColumn("lane_refs", refs.road_refs("ref")), 200.0)
    rows = lambda df: sorted(map(str, df.select("site_id", "source_id", "dist", "angle", "quality", "failure").collect()))
    want = rows(matching.match_sites(pairs))
    assert len(want) == 500 and all(rows(matching.match_sites_near(sites, lanes, 200.0, n)) == want for n in (2, 30))


@pytest.mark.parametrize("name", ["knn_one", "knn_topk", "fallback_bearings"])
def test_searches_start_near(equal, name, monkeypatch):
    """F3, F7, F8: where lanes lie close the search starts with a small part of the radius that was fixed before."""
    from roadweave.operators import spatial

    pads, cells = [], spatial.cells_of_segment
    monkeypatch.setattr(spatial, "cells_of_segment", lambda rows, size, pad: pads.append(pad) or cells(rows, size, pad))
    equal(name, part=f"SELECT * REPLACE (range AS p_partkey, range % 50 AS p_size) FROM (FROM '{SF}/part.parquet' LIMIT 1), range(30000)")
    assert pads[0] < {"knn_one": 20.0, "knn_topk": 30.0, "fallback_bearings": 0.0002}[name]


def test_lane_searches_write_ids_and_distances(spark, monkeypatch):
    """F1, and the search of F11 and F12: of each ranked pair, the places of the lane are looked up instead of written."""
    from roadweave.operators import matching, spatial

    written = []
    for at in (spatial, matching):
        monkeypatch.setattr(at, "materialize", lambda df, whole=at.materialize: written.append(df.columns) or whole(df))
    plans.queries()["drip_match"](spark, "/root/testdata/sf0.01")
    pairs = [c for c in written if "dist" in c]
    assert pairs and all(c[1:] == ["_row", "dist"] for c in pairs), pairs
