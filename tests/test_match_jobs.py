"""Matches kept up to date equal a full match."""

import random

from roadweave.operators import match_jobs as jobs
from roadweave.operators.buckets import Store

SIGNS = "gantry string, sign long, x double, y double, road string, carriageway string, lane int, bearing double"
LANES = "source_id long, ax double, ay double, bx double, by double, segment string, direction string, lane_id long, lane_nr int, lane_count int, road_id long, ref string, lane_carriageway string, highway string"


def lane(i, y, x, bearing_up=True, ref="A1"):
    a, b = ((x, y), (x + 100.0, y)) if bearing_up else ((x + 100.0, y), (x, y))
    return (i, *a, *b, f"{i}:{i}:{i + 1}", "fwd", i, 1, 1, i // 10, ref, None, "motorway")


def test_changed_lanes_and_signs(spark, tmp_path):
    rng = random.Random(2)
    lanes = [lane(i, rng.uniform(0, 60), 100.0 * (i % 20), rng.random() < 0.7, rng.choice(("A1", "A2"))) for i in range(60)]
    signs = [(f"g{i // 2}", i, 60.0 * (i // 2) + i % 2, rng.uniform(0, 60), rng.choice(("A1", "A2", None)), "R", i % 2 + 1, 90.0) for i in range(60)]
    moved = [lane(7, 5.0, 700.0), lane(99, 8.0, 300.0)] + [r for r in lanes if r[0] not in (7, 30)]
    others = [(*signs[4][:4], "A2", *signs[4][5:]), ("g90", 900, 50.0, 5.0, None, "R", 1, 90.0)] + [s for i, s in enumerate(signs) if i not in (4, 40, 41)]
    make = lambda s, n: jobs.Roads(jobs.materialize(spark.createDataFrame(s, SIGNS)), jobs.materialize(spark.createDataFrame(n, LANES)))
    before, now = make(signs, lanes), make(others, moved)
    store, whole = Store(spark, str(tmp_path / "a"), buckets=8), Store(spark, str(tmp_path / "b"), buckets=8)
    jobs.run(store, before, "v1")
    first = {tuple(r) for r in store.read("assignments").collect()}
    jobs.run(store, now, "v1", before)
    jobs.run(whole, now, "v1")
    told = lambda s, t: sorted(map(str, s.read(t).collect()))
    assert all(told(store, t) == told(whole, t) for t in ("assignments", "links", "report"))
    assert {tuple(r) for r in store.read("assignments").collect()} != first and store.read("assignments").count() == len(others)
    part = {r.gantry for r in jobs.touched(before, now).collect()}
    assert {"g2", "g20", "g90"} <= part and len(part) < 25
    # another version matches all again
    assert jobs.run(store, now, "v2", before) == 3 and {r.version for r in store.read("assignments").collect()} == {"v2"}
