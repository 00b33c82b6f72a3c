"""The lane network: known junctions, and lane claims against a walk in plain Python."""

import random
from math import hypot

import pytest

from roadweave.operators import lane_network as net

LANES = "lane_id string, road long, segment string, direction string, lane int, lane_count int, line array<struct<x:double,y:double>>, axis array<struct<x:double,y:double>>, start_node long, end_node long"
TURNS = {"sharp_left": (-135, -55), "left": (-135, -20), "slight_left": (-60, -5), "through": (-25, 25), "slight_right": (5, 60), "right": (20, 135), "sharp_right": (55, 135), "reverse": (135, 180)}


def road(number, points, tags, nodes):
    """Lane rows of a one-way road of two points, right of its middle or of its placement."""
    (x0, y0), (x1, y1) = (map(float, p) for p in points)
    n, length = int(tags["lanes"]), hypot(x1 - x0, y1 - y0)
    rx, ry = (y1 - y0) / length, -(x1 - x0) / length
    kind, _, k = tags.get("placement", "").partition(":")
    centre = {"right_of": 0, "middle_of": -0.5, "left_of": -1}[kind] + int(k) if k else n / 2
    segment = f"{number}:{nodes[0]}:{nodes[1]}"
    rows = []
    for i in range(1, n + 1):
        s = (i - 0.5 - centre) * 3.5
        rows.append((f"ll:{segment}:fwd:{i}", number, segment, "fwd", i, n, [(x0 + s * rx, y0 + s * ry), (x1 + s * rx, y1 + s * ry)], [(x0, y0), (x1, y1)], *nodes))
    return rows


def way(lanes, highway="motorway", **more):
    return {"highway": highway, "oneway": "yes", "lanes": str(lanes), **{k.replace("__", ":"): v for k, v in more.items()}}


LINK, ENTRY = way(2, "motorway_link", ref="A22", change__lanes="no|no"), way(2, "motorway_link", ref="A22")
ONE, TWO = way(1, ref="A1", placement="right_of:1"), way(2, ref="A1", placement="right_of:1")
CLAIM = ((1, [(0, -60), (0, 0)], way(2, ref="A1"), (1, 3)), (2, [(9, -60), (0, 0)], way(1, "motorway_link"), (2, 3)), (3, [(0, 0), (0, 60)], way(3, ref="A1", placement="right_of:1"), (3, 4)))
#: Junctions of roads (number, points, tags, nodes); all are built at once, a thousand metres, roads and nodes apart.
CASES = {
    "merge": ((1, [(0, 50), (0, 0)], way(3, ref="A22", turn__lanes="none|none|merge_to_left"), (10, 11)), (2, [(0, -2), (0, -50)], way(2, ref="A22"), (11, 12))),
    "blocks": ((1, [(-5, -60), (0, 0)], way(2, ref="A9"), (10, 12)), (2, [(8, -60), (0, 0)], way(2, ref="A22"), (11, 12)), (3, [(0, 0), (0, 60)], way(4, ref="A9"), (12, 13))),
    "slice": ((1, [(0, -40), (0, 0)], way(2, ref="A208"), (10, 20)), (2, [(24, -40), (12, -20)], LINK, (30, 31)), (3, [(12, -20), (0, 0)], LINK | {"placement": "transition"}, (31, 20)), (4, [(0, 0), (0, 40)], way(4, "motorway_link", ref="A22", placement="right_of:1"), (20, 40))),
    "ends": (
        (1, [(30, 50), (0, 0)], way(2, ref="A22"), (10, 12)),
        (2, [(0, 50), (0, 32)], ENTRY, (11, 13)),
        (3, [(0, 32), (0, 0)], ENTRY | {"placement": "transition"}, (13, 12)),
        (4, [(0, 0), (-10, -30)], way(4, ref="A22", placement="right_of:1", turn__lanes="none|none|merge_to_left|none"), (12, 14)),
    ),
    "exit": (
        (1, [(0, -50), (0, 0)], way(4, ref="A22", placement="right_of:1", turn__lanes="none|none|through|slight_right", change__lanes="yes|yes|not_left|yes"), (1, 2)),
        (2, [(0, 0), (2, 50)], way(3, ref="A22", placement="right_of:1", turn__lanes="none|none|slight_right"), (2, 3)),
        (3, [(0, 0), (16, 40)], way(1, "motorway_link", ref="A22", placement="transition"), (2, 4)),
        (4, [(16, 40), (45, 75)], way(1, "motorway_link", ref="A22"), (4, 5)),
    ),
    "short": ((1, [(0, 40), (0, 0)], ONE, (10, 11)), (2, [(0, 0), (0, -12)], TWO, (11, 12)), (3, [(0, -12), (0, -50)], ONE, (12, 13))),
    "bend": ((1, [(0, -40), (0, 0)], way(1, "motorway_link"), (1, 2)), (2, [(0, 0), (20, 0)], way(1, "motorway_link", placement="transition"), (2, 3)), (3, [(20, 0), (20, -40)], way(1, "motorway_link"), (3, 4))),
    "claim": CLAIM,
    "ruled": CLAIM,
}


def apart(case, roads):
    base = 1000 * [*CASES].index(case)
    return [(base + n, [(x + base, y) for x, y in points], tags, tuple(base + node for node in nodes)) for n, points, tags, nodes in roads]


@pytest.fixture(scope="module")
def built(spark):
    """For each case its lanes, connections and transitions."""
    roads = [r for case, group in CASES.items() for r in apart(case, group)]
    lanes = spark.createDataFrame([r for args in roads for r in road(*args)], LANES)
    tags = spark.createDataFrame([(n, t.get("highway"), t) for n, _, t, _ in roads], "road long, highway string, tags map<string,string>")
    at = 1000 * [*CASES].index("ruled")
    one, two = f"{at + 1}:{at + 1}:{at + 3}", f"{at + 3}:{at + 3}:{at + 4}"
    rules = [("block", f"ll:{one}:fwd:2", f"{two}:2"), ("connect", f"{one}:1", f"ll:{two}:fwd:3@fwd")]
    moved, made, placed = net.network(lanes, tags, spark.createDataFrame(rules, "action string, source string, target string"))
    moved, made, placed = moved.collect(), made.collect(), placed.collect()
    of = lambda k: [*CASES][k // 1000]
    out = {case: ({}, [], {}) for case in CASES}
    for r in moved:
        out[of(r.road)][0][r.road % 1000, r.lane] = r.line
    for r in made:
        out[of(r.s_road)][1].append(r)
    for r in placed:
        k = int(r.segment.split(":")[0])
        out[of(k)][2][k % 1000] = r
    return out


def pairs(rows, into=None):
    return {(r.s_road % 1000, r.s_lane, r.t_lane, r.type) for r in rows if into is None or r.t_road % 1000 == into}


def between(rows, a, b):
    return {(r.s_lane, r.t_lane) for r in rows if (r.s_road % 1000, r.t_road % 1000) == (a, b)}


def away(p, q):
    return hypot(p.x - q.x, p.y - q.y)


def test_marked_merge_joins_the_lane_beside(built):
    _, made, _ = built["merge"]
    assert pairs(made) == {(1, 1, 1, "continuation"), (1, 2, 2, "continuation"), (1, 3, 2, "join")}
    join = next(r for r in made if r.type == "join")
    assert 5 <= join.s_trim <= 15 and 5 <= join.t_trim <= 15 and len(join.line) == 13


def test_blocks_fill_a_target_from_the_left(built):
    _, made, _ = built["blocks"]
    assert pairs(made) == {(1, 1, 1, "continuation"), (1, 2, 2, "continuation"), (2, 1, 3, "continuation"), (2, 2, 4, "continuation")}
    assert all(r.block and r.exact for r in made)


def test_transition_takes_its_slice_of_the_target(built):
    lanes, made, placed = built["slice"]
    assert pairs(made, 4) == {(1, 1, 1, "continuation"), (1, 2, 2, "continuation"), (3, 1, 3, "continuation"), (3, 2, 4, "continuation")}
    assert all(r.block for r in made if r.t_road % 1000 == 4) and placed[3].reason is None
    for lane, target in ((1, 3), (2, 4)):
        assert away(lanes[3, lane][-1], lanes[4, target][0]) < 0.05


def test_transition_takes_over_its_neighbours_ends(built):
    lanes, made, placed = built["ends"]
    assert placed.keys() == {3} and placed[3].reason is None
    assert between(made, 3, 4) == {(1, 3), (2, 4)}
    assert all(abs(away(a, b) - 3.5) <= 0.25 for a, b in zip(lanes[3, 1], lanes[3, 2], strict=True))
    assert away(lanes[3, 1][-1], lanes[4, 3][0]) < 0.05 and away(lanes[3, 2][-1], lanes[4, 4][0]) < 0.05
    assert all(x.end_shift > 6.5 for x in placed[3].lanes)
    assert all(r.s_trim <= 5.01 for r in made if (r.s_road % 1000, r.t_road % 1000) == (3, 4))


def test_marked_exit_keeps_its_lane_from_the_mainline(built):
    _, made, placed = built["exit"]
    assert between(made, 1, 2) == {(1, 1), (2, 2), (3, 3)} and between(made, 1, 3) == {(4, 1)}
    assert placed[3].reason is None and 8.7 <= placed[3].lanes[0].start_shift <= 8.8


def test_trims_share_a_short_lane(built):
    _, made, _ = built["short"]
    lane = next(r.t_id for r in made if (r.t_road % 1000, r.t_lane) == (2, 1))
    assert max((r.t_trim for r in made if r.t_id == lane), default=0) + max((r.s_trim for r in made if r.s_id == lane), default=0) <= 9.6 + 0.02
    assert any(r.scaled for r in made)


def test_sharp_transition_is_left_alone(built):
    lanes, _, placed = built["bend"]
    assert placed[2].reason == "transition_angle_too_large" and placed[2].lanes is None and len(lanes[2, 1]) == 2


def test_an_entry_claims_the_added_lane(built):
    assert {p for p in pairs(built["claim"][1], 3) if p[2] == 3} == {(2, 1, 3, "continuation")}


def test_rules_by_hand(spark, built):
    before, after = pairs(built["claim"][1]), pairs(built["ruled"][1])
    assert before - after == {(1, 2, 2, "continuation")} and after - before == {(1, 1, 3, "manual")}
    lanes = spark.createDataFrame([r for args in CLAIM for r in road(*args)], LANES)
    walked = net.walks(lanes, spark.createDataFrame([], "road long, highway string, tags map<string,string>"))
    for name in ("1:1:3:9", "ll:nothing", "1:1:3:1@x"):
        rules = spark.createDataFrame([("connect", name, "3:3:4:3")], "action string, source string, target string")
        with pytest.raises(Exception, match="missing lane"):
            net.overrides_of(rules, walked).collect()


# a walk over each junction, movement after movement ----------------------------------------


def fits(token, turn):
    a, b = TURNS.get(token, (1, 0))
    return abs(turn) >= 135 if token == "reverse" else a <= turn <= b


def mapped(use, tgt, move):
    """(pairs, reason) of two blocks of lanes."""
    n, m = len(use), len(tgt)
    if not n or not m:
        return [], None
    if n == m:
        return [(s["lane"], t["lane"]) for s, t in zip(use, tgt, strict=True)], None
    if n > m:
        heads = {}
        for i, s in enumerate(use):
            if "merge_to_left" in s["marks"]:
                heads[i] = -1
            elif "merge_to_right" in s["marks"]:
                heads[i] = 1
        if len(heads) == n - m:
            stay = dict(zip([i for i in range(n) if i not in heads], tgt, strict=True))
            out = {i: t["lane"] for i, t in stay.items()}
            for i, step in heads.items():
                j = i + step
                while j in heads:
                    j += step
                if j not in stay:
                    break
                out[i] = stay[j]["lane"]
            else:
                return [(use[i]["lane"], t) for i, t in out.items()], None
        return ([(s["lane"], t["lane"]) for s, t in zip(use, tgt, strict=False)] if move["anchored"] else []), "unresolved_narrowing_merge"
    own, its = [s["lane"] for s in use], [t["lane"] for t in tgt]
    side = "right" if its[:n] == own else "left" if its[-n:] == own else None
    if side is None and move["anchored"]:
        side = "right" if its[0] == own[0] else "left" if its[-1] == own[-1] else None
    if side is None:
        return list(zip(own, its, strict=False)), "unresolved_widening_side"
    at, extra = (-1, its[n:]) if side == "right" else (0, its[: m - n])
    out = list(zip(own, its[:n] if side == "right" else its[m - n :], strict=True))
    says = [c for c in use[at]["change"] if c in ("yes", "no", "not_left", "not_right", "only_left", "only_right")]
    if says and not any(c == "yes" or c == f"only_{side}" or (c.startswith("not_") and c != f"not_{side}") for c in says):
        return out, "change_lanes_conflict"
    return out + [(own[at], t) for t in extra], None


def walk(moves):
    """{movement: (reason, [(s_lane, t_lane, type)])} of one source's movements."""
    out, owned = {}, set()
    for first in (True, False):
        for move in moves:
            if (move["kind"] in ("exit", "tagged")) != first:
                continue
            src, tgt, turn = move["src"], move["tgt"], move["turn"]
            if first:
                match = [s for s in src if any(fits(k, turn) for k in s["marks"])]
                to = {"slight_right", "right", "sharp_right"} if turn > 5 else {"slight_left", "left", "sharp_left"} if turn < -5 else set()
                use = [s for s in match if any(k in to and fits(k, turn) for k in s["marks"])] or match or src[len(src) - min(len(src), len(tgt)) :]
                use = [s for s in use if (move["t_ref"] and move["t_ref"] in s["dest_ref"]) or (move["t_name"] and move["t_name"] in s["dest"])] or use
                got, reason = mapped(use, tgt, move)
                held = {s["lane"]: set(s["marks"]) for s in src}
                owned |= {s for s, _ in got if held[s] & ({*TURNS} - {"through"}) and not held[s] & {"none", "through", "merge_to_left", "merge_to_right"}}
            else:
                use = [s for s in src if s["lane"] not in owned]
                if move["kind"] == "entry":
                    k = min(len(use), len(tgt))
                    got, reason = [(s["lane"], t["lane"]) for s, t in zip(use[:k], tgt[len(tgt) - k :], strict=True)], None
                else:
                    got, reason = mapped(use, tgt, move)
            seen_s, seen_t, kept = set(), set(), []
            for s, t in sorted(got):
                if s in seen_s and t in seen_t:
                    continue
                kept.append((s, t, "split" if s in seen_s else "join" if t in seen_t else "continuation"))
                seen_s.add(s)
                seen_t.add(t)
            out[move["s_segment"], move["t_segment"]] = (reason, kept)
    return out


def junctions(rng, n):
    marks = ["none", "through", "left", "slight_right", "right", "merge_to_left", "merge_to_right", "reverse", "sharp_left", "odd"]

    def lane(i):
        some = lambda names, p: rng.sample(names, 1 + (rng.random() < 0.2)) if rng.random() < p else []
        return {"lane": i, "lane_id": f"l{i}", "marks": some(marks, 0.7), "dest": some(["x", "y"], 0.3), "dest_ref": some(["a1", "a2"], 0.3), "change": some(["yes", "no", "not_left", "not_right", "only_left", "only_right", "odd"], 0.4)}

    for j in range(n):
        src = [lane(i) for i in range(1, rng.randrange(2, 7))]
        if rng.random() < 0.2:
            src = src[1:]
        for k in range(rng.randrange(1, 4)):
            start = rng.choice((1, 1, 1, 2))
            yield {"s_segment": f"s{j}", "s_travel": "fwd", "t_segment": f"t{k}", "t_travel": "fwd", "kind": rng.choice(["exit", "tagged", "entry", "continuation", "continuation", "roundabout"]), "turn": rng.choice([-80.0, -20.0, 0.0, 3.0, 20.0, 50.0, 134.0]), "anchored": rng.random() < 0.3, "t_ref": rng.choice(["", "a1"]), "t_name": rng.choice(["", "x"]), "src": src, "tgt": [lane(i) for i in range(start, start + rng.randrange(1, 6))]}


def test_claims_equal_a_walk(spark):
    moves = list(junctions(random.Random(4), 700))
    member = "array<struct<lane:int,lane_id:string,marks:array<string>,dest:array<string>,dest_ref:array<string>,change:array<string>>>"
    schema = f"s_segment string, s_travel string, t_segment string, t_travel string, kind string, turn double, anchored boolean, t_ref string, t_name string, src {member}, tgt {member}"
    df = spark.createDataFrame([tuple(m.values()) for m in moves], schema).repartition(4)
    claimed = net.claimed(df).cache()
    reasons = {(r.s_segment, r.t_segment): r.reason for r in claimed.collect()}
    got: dict = {k: [] for k in reasons}
    for r in net.classified(claimed).collect():
        got[r.s_segment, r.t_segment].append((r.s_lane, r.t_lane, r.type))
    want = {}
    for s in {m["s_segment"] for m in moves}:
        want |= walk([m for m in moves if m["s_segment"] == s])
    assert {k: (reasons[k], sorted(v)) for k, v in got.items()} == want
    assert {v[0] for v in want.values()} == {None, "unresolved_narrowing_merge", "unresolved_widening_side", "change_lanes_conflict"}
