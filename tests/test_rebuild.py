"""A network rebuilt around its changes equals one built as a whole."""

import random

from pyspark.sql import functions as F

from roadweave.operators import lane_network as net
from roadweave.operators import rebuild

from .test_lane_network import LANES, road, way


def town(seed, n=7):
    """A grid of one-way streets with lanes and markings at random."""
    rng = random.Random(seed)
    node = lambda i, j: 1 + i * 100 + j
    out = []
    for i in range(n):
        for j in range(n):
            for k, (di, dj) in enumerate(((1, 0), (0, 1))):
                if i + di < n and j + dj < n:
                    ends = [(i * 60.0, j * 60.0), ((i + di) * 60.0, (j + dj) * 60.0)]
                    out.append((1000 + (i * n + j) * 2 + k, ends, way(rng.choice((1, 2, 2, 3)), rng.choice(("primary", "motorway_link")), ref=rng.choice(("A1", "A2"))), (node(i, j), node(i + di, j + dj))))
    return out


def built(lanes, roads):
    walked = net.materialize(net.walks(lanes, roads))
    return lanes, net.connections(walked, net.topology(walked))


def frames(spark, streets):
    lanes = spark.createDataFrame([r for s in streets for r in road(*s)], LANES)
    return net.materialize(lanes), net.materialize(spark.createDataFrame([(n, t["highway"], t) for n, _, t, _ in streets], "road long, highway string, tags map<string,string>"))


def told(connections):
    return {(r.s_id, r.t_id, r.type, r.block, round(r.s_trim, 6), round(r.t_trim, 6), round(r.s_handle, 6), None if r.line is None else tuple((round(p.x, 6), round(p.y, 6)) for p in r.line)) for r in connections.collect()}


def test_equals_a_full_build(spark):
    before = town(3)
    gone, wider = before[0][0], before[30][0]
    after = [s if s[0] != wider else (s[0], s[1], way(4, "primary", ref="A1"), s[3]) for s in before if s[0] != gone]
    (old, old_roads), (new, new_roads) = frames(spark, before), frames(spark, after)
    stored = tuple(map(net.materialize, built(old, old_roads)))
    touched = rebuild.changed(old, new, "lane_count", "line")
    assert {r.road for r in touched.collect()} == {gone, wider}
    lanes, connections, scope = rebuild.rebuilt(stored, old, new, new_roads, touched, built, hops=2)
    assert told(connections) == told(built(new, new_roads)[1]) != told(stored[1])
    assert {r.lane_id for r in lanes.collect()} == {r.lane_id for r in new.collect()}
    assert scope.count() < len(before) / 2


def test_reach_over_nodes_and_near_ends(spark):
    streets = [(k, [(k * 100.0, 0.0), (k * 100.0 + 100 - 20 * (k % 2), 0.0)], way(1), (10 * k, 10 * k + 10 + k % 2)) for k in range(1, 60)]
    lanes, _ = frames(spark, streets)
    every = rebuild.ends(lanes, 130.0)
    for hops in (0, 1, 3):
        got = rebuild.reached(every, spark.createDataFrame([(30,)], "road long"), hops, 130.0)
        assert {r.road for r in got.collect()} == {*range(30 - hops, 31 + hops)}
    assert rebuild.reached(every, lanes.select("road").where(F.lit(False)), 3).count() == 0
