"""Lanes of a road network: cross-sections, segments, offset lines, movements, connectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, refs

#: Lane width, junction radius and most lanes of a road.
WIDTH, JUNCTION_M, MOST = 3.5, 25.0, 12
LANE_LINES = "segment string, direction string, lane int, line array<struct<x:double,y:double>>, failure string"


def cumulative(vertices: DataFrame) -> DataFrame:
    """Running length along each line (line, seq, x, y)."""
    w = Window.partitionBy("line").orderBy("seq")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return vertices.withColumn("_step", step).withColumn("along", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def cross_section(ways: DataFrame) -> DataFrame:
    """Lanes a direction of each way (way, tags): rule, forward, backward and undirected.

    oneway: all lanes run forward (one if untagged). tagged: given by direction, the other one from
    the total. conflict: the numbers disagree, so there are none. assumed: one each way. even: half
    each way. shared: one lane for both. odd: the split is unknown.
    """
    tag = lambda k: refs.tag("tags", k)
    one = F.coalesce(tag("oneway").isin("yes", "true", "1", "-1"), F.lit(False)) | F.coalesce(tag("junction").isin("roundabout", "circular"), F.lit(False))
    turn = lambda k: F.when(tag(k).isNotNull(), F.size(F.split(tag(k), r"\|", -1)))
    total = F.coalesce(refs.small_count(tag("lanes"), 1, MOST), F.when(one, turn("turn:lanes")))
    f = F.coalesce(refs.small_count(tag("lanes:forward"), 1, MOST), turn("turn:lanes:forward"))
    b = F.coalesce(refs.small_count(tag("lanes:backward"), 1, MOST), turn("turn:lanes:backward"))
    rows = ways.withColumns({"_one": one, "_n": total, "_f": f, "_b": b})
    n, f, b = F.col("_n"), F.col("_f"), F.col("_b")
    some = F.coalesce(f, b)
    rule = (
        F.when(F.col("_one"), F.lit("oneway"))
        .when(f.isNotNull() & b.isNotNull() & n.isNotNull() & (f + b != n), F.lit("conflict"))
        .when(f.isNotNull() & b.isNotNull(), F.lit("tagged"))
        .when(some.isNotNull() & n.isNotNull() & (n > some), F.lit("tagged"))
        .when(some.isNotNull(), F.lit("conflict"))
        .when(n.isNull(), F.lit("assumed"))
        .when(n == 1, F.lit("shared"))
        .when(n % 2 == 0, F.lit("even"))
        .otherwise(F.lit("odd"))
    )
    r = F.col("rule")
    half = (n / 2).cast("int")
    return (
        rows.withColumn("rule", rule)
        .withColumn("forward", F.when(r == "oneway", F.coalesce(n, F.lit(1))).when(r == "tagged", F.coalesce(f, n - b)).when(r == "assumed", 1).when(r == "even", half).cast("int"))
        .withColumn("backward", F.when(r == "oneway", 0).when(r == "tagged", F.coalesce(b, n - f)).when(r == "assumed", 1).when(r == "even", half).cast("int"))
        .withColumn("undirected", F.when(r == "shared", 1).when(r == "odd", n).cast("int"))
        .drop("_one", "_n", "_f", "_b")
    )


def lane_rows(sections: DataFrame) -> DataFrame:
    """One row a lane (direction, lane, lane_count, side): ``side`` is its place in metres right of the way.

    Forward lanes lie right of the middle in their order from the median; backward lanes mirror
    them. One-way sections are centred, or placed by the ``placement`` tag's lane.
    """
    fwd, bwd, both = (F.coalesce(c, F.lit(0)) for c in ("forward", "backward", "undirected"))
    many = lambda d, n: F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit(d).alias("direction"), i.alias("lane"), n.cast("int").alias("lane_count")))
    rows = sections.withColumn("_l", F.explode(F.concat(many("fwd", fwd), many("bwd", bwd), many("both", both)))).select("*", "_l.*").drop("_l")
    anchored = refs.placement(refs.tag("tags", "placement"))
    edge = F.when(anchored["kind"] == "right_of", anchored["lane"]).when(anchored["kind"] == "left_of", anchored["lane"] - 1).when(anchored["kind"] == "middle_of", anchored["lane"] - 0.5)
    centre = F.coalesce(F.when(edge <= F.col("lane_count"), edge), F.col("lane_count") / 2.0)
    side = F.when((F.col("rule") == "oneway") | (F.col("direction") == "both"), (F.col("lane") - 0.5 - centre) * WIDTH).when(F.col("direction") == "fwd", (F.col("lane") - 0.5) * WIDTH).otherwise(-(F.col("lane") - 0.5) * WIDTH)
    return rows.withColumn("side", side).where(~F.coalesce(refs.tag("tags", "access") == "no", F.lit(False)))


def logical_segments(nodes: DataFrame) -> DataFrame:
    """Parts of ways (way, pos, node) between ends, nodes of several ways and repeated nodes.

    The id is ``way:start:end`` by node; ``start_pos`` and ``end_pos`` keep repeated parts apart.
    """
    ways = nodes.groupBy("node").agg((F.min("way") != F.max("way")).alias("_shared"))
    w, same = Window.partitionBy("way"), Window.partitionBy("way", "node")
    rows = nodes.join(ways, "node").withColumns({"_first": F.min("pos").over(w), "_last": F.max("pos").over(w), "_again": F.count(F.lit(1)).over(same) > 1})
    cuts = rows.where("_shared or _again or pos = _first or pos = _last").where("_first < _last")
    o = Window.partitionBy("way").orderBy("pos")
    out = cuts.select("way", F.col("pos").alias("start_pos"), F.lead("pos").over(o).alias("end_pos"), F.col("node").alias("start_node"), F.lead("node").over(o).alias("end_node")).where("end_pos is not null")
    return out.withColumn("segment", F.concat_ws(":", "way", "start_node", "end_node"))


def offset_line(x: np.ndarray, y: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray, str | None]:
    """A parallel to the right by ``side`` with mitred bends; the reason why it is no good, if so.

    Its ends have to lie within half a metre of the shifted ends and its length between half and
    twice the original.
    """
    keep = np.r_[True, np.hypot(np.diff(x), np.diff(y)) > 0]
    x, y = x[keep], y[keep]
    if len(x) < 2:
        return x, y, "degenerate"
    dx, dy = np.diff(x), np.diff(y)
    length = np.hypot(dx, dy)
    nx, ny = dy / length, -dx / length
    ax, ay = np.r_[nx[0], nx[:-1] + nx[1:], nx[-1]], np.r_[ny[0], ny[:-1] + ny[1:], ny[-1]]
    scale = np.r_[1.0, 2.0 / np.maximum(ax[1:-1] ** 2 + ay[1:-1] ** 2, 0.5), 1.0]
    ox, oy = x + side * ax * scale, y + side * ay * scale
    total = np.hypot(np.diff(ox), np.diff(oy)).sum()
    if not 0.5 * length.sum() <= total <= 2 * length.sum():
        return ox, oy, "length_ratio"
    return ox, oy, None


def lane_lines(lanes: DataFrame) -> DataFrame:
    """Offset lines of lanes (segment, direction, lane, line, side); backward ones run backwards."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                x, y = (np.array([p[k] for p in r.line], float) for k in ("x", "y"))
                ox, oy, why = offset_line(x, y, float(r.side))
                points = [{"x": float(u), "y": float(v)} for u, v in zip(ox, oy, strict=True)]
                out.append((r.segment, r.direction, r.lane, None if why else points[::-1] if r.direction == "bwd" else points, why))
            yield pd.DataFrame(out, columns=["segment", "direction", "lane", "line", "failure"])

    return lanes.select("segment", "direction", "lane", "line", "side").mapInPandas(run, LANE_LINES)


# movements ----------------------------------------------------------------------------------


def traversals(segments: DataFrame) -> DataFrame:
    """Directed passages of segments (segment, way, direction, start_node, end_node, line, ...)."""
    ways = F.when(F.col("direction") == "both", F.array(F.lit("fwd"), F.lit("bwd"))).when(F.col("direction").isin("fwd", "bwd"), F.array("direction")).otherwise(F.array().cast("array<string>"))
    rows = segments.withColumn("travel", F.explode(ways))
    flip = F.col("travel") == "bwd"
    swap = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    rows = rows.withColumns({"entry": swap("start_node", "end_node"), "exit": swap("end_node", "start_node"), "line": F.when(flip, F.reverse("line")).otherwise(F.col("line"))})
    first, second, last, before = (F.try_element_at("line", F.lit(i)) for i in (1, 2, -1, -2))
    return rows.withColumns({"entry_bearing": geo.azimuth(second["x"] - first["x"], second["y"] - first["y"]), "exit_bearing": geo.azimuth(last["x"] - before["x"], last["y"] - before["y"]), "ex": last["x"], "ey": last["y"], "sx": first["x"], "sy": first["y"]})


def movements(walks: DataFrame, most_turn: float = 150.0) -> DataFrame:
    """(source, target) passages that follow each other: at one node, or ends within a junction's box.

    Exact nodes are an equi-join, near ends a grid join; kind is exact, endpoint (0.5 m) or
    junction. The score orders by kind, same road, class, angle and distance.
    """
    from .spatial import point_join

    side = lambda p, cols: [F.col(c).alias(f"{p}_{c}") for c in cols]
    base = ["segment", "way", "travel", "ref", "highway"]
    out = walks.select(*side("s", base), F.col("exit").alias("node"), F.col("exit_bearing").alias("s_bearing"), F.col("ex").alias("x"), F.col("ey").alias("y"))
    into = walks.select(*side("t", base), F.col("entry").alias("t_node"), F.col("entry_bearing").alias("t_bearing"), F.col("sx").alias("rx"), F.col("sy").alias("ry"))
    exact = out.join(into, F.col("node") == F.col("t_node")).withColumn("dist", F.hypot(F.col("rx") - F.col("x"), F.col("ry") - F.col("y"))).withColumn("kind", F.lit("exact"))
    near = point_join(out, into, JUNCTION_M).where("node <> t_node").withColumn("kind", F.when(F.col("dist") <= 0.5, F.lit("endpoint")).otherwise(F.lit("junction")))
    pairs = exact.unionByName(near).where("s_segment <> t_segment").withColumn("turn", geo.turn("s_bearing", "t_bearing")).where(F.abs("turn") <= most_turn)
    rank = F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "endpoint", 1).otherwise(2)
    other = ~F.coalesce(F.col("s_ref") == F.col("t_ref"), F.lit(False))
    return pairs.withColumn("score", F.struct(rank.alias("kind"), other.alias("other_road"), (F.col("s_highway") != F.col("t_highway")).alias("other_class"), F.abs("turn").alias("turn"), F.col("dist").alias("dist")))


def undominated(moves: DataFrame, walks: DataFrame, reach: float = 25.5, depth: int = 2) -> DataFrame:
    """Movements without those that lead to a target over at most ``depth`` short exact passages."""
    steps = moves.where("kind = 'exact'").select("s_segment", "s_travel", "t_segment", "t_travel")
    length = walks.select(F.col("segment").alias("t_segment"), F.col("travel").alias("t_travel"), geo.line_length("line").alias("len"))
    short = steps.join(length, ["t_segment", "t_travel"])
    frontier, covered = short.select("s_segment", "s_travel", F.col("t_segment").alias("m_segment"), F.col("t_travel").alias("m_travel"), "len"), None
    for _ in range(depth):
        nxt = short.select(F.col("s_segment").alias("m_segment"), F.col("s_travel").alias("m_travel"), F.col("t_segment").alias("n_segment"), F.col("t_travel").alias("n_travel"), F.col("len").alias("n_len"))
        hop = frontier.where(F.col("len") <= reach).join(nxt, ["m_segment", "m_travel"])
        reached = hop.select("s_segment", "s_travel", F.col("n_segment").alias("t_segment"), F.col("n_travel").alias("t_travel"))
        covered = reached if covered is None else covered.unionByName(reached)
        frontier = hop.select("s_segment", "s_travel", F.col("n_segment").alias("m_segment"), F.col("n_travel").alias("m_travel"), (F.col("len") + F.col("n_len")).alias("len"))
    keys = ["s_segment", "s_travel", "t_segment", "t_travel"]
    return moves.where("kind = 'exact'").unionByName(moves.where("kind <> 'exact'").join(covered.distinct(), keys, "left_anti").select(*moves.columns))


def chosen(moves: DataFrame, bucket: float = 45.0, apart: float = 7.5) -> DataFrame:
    """The primary movement of each source and one a branch of class and angle; unclear ones fall."""
    source = ["s_segment", "s_travel"]
    link = F.col("t_highway").endswith("_link")
    rows = moves.withColumns({"_link": link, "_bucket": F.floor((F.col("turn") + bucket / 2) / bucket)})
    every = Window.partitionBy(*source).orderBy("score", "t_segment", "t_travel")
    group = Window.partitionBy(*source, "_link", "_bucket").orderBy("score", "t_segment", "t_travel")
    rows = rows.withColumns({"_all": F.row_number().over(every), "_rank": F.row_number().over(group), "_next": F.lead("turn").over(group), "_kind": F.lead("score.kind").over(group)})
    clear = F.col("_next").isNull() | (F.col("_kind") > F.col("score.kind")) | (F.abs(F.col("_next") - F.col("turn")) >= apart)
    return rows.where((F.col("_rank") == 1) & clear).withColumn("role", F.when(F.col("_all") == 1, F.lit("primary")).otherwise(F.lit("branch"))).drop("_link", "_bucket", "_all", "_rank", "_next", "_kind")


def assigned(moves: DataFrame) -> DataFrame:
    """Lane pairs (s_lane, t_lane) of movements with s_lanes, t_lanes, role and turn.

    Equal counts map one to one. A primary movement that gains lanes opens them on the outer side
    of its bend, one that loses lanes merges there. A branch takes the outermost lane on its side.
    """
    right = F.col("turn") >= 0
    n, m = F.col("s_lanes"), F.col("t_lanes")
    pair = lambda s, t: F.struct(s.cast("int").alias("s_lane"), t.cast("int").alias("t_lane"))
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    primary = F.when(n <= m, F.transform(upto(m), lambda t: pair(F.when(right, F.least(t, n)).otherwise(F.greatest(t - (m - n), F.lit(1))), t))).otherwise(F.transform(upto(n), lambda s: pair(s, F.when(right, F.least(s, m)).otherwise(F.greatest(s - (n - m), F.lit(1))))))
    k = F.least(n, m)
    branch = F.transform(upto(k), lambda i: F.when(right, pair(n - k + i, m - k + i)).otherwise(pair(i, i)))
    return moves.withColumn("_p", F.explode(F.when(F.col("role") == "primary", primary).otherwise(branch))).select(*moves.columns, "_p.s_lane", "_p.t_lane")


def blocks(moves: DataFrame, target: list[str], source: str) -> DataFrame:
    """The lanes first_lane to last_lane of a target that each of its sources gets, from left to right.

    Sources lie in the order of their turn into the target, the sharpest left first. Where they
    bring more lanes than the target has, none gets a block.
    """
    order = Window.partitionBy(*target).orderBy("turn", source)
    before = F.coalesce(F.sum("s_lanes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.sum("s_lanes").over(Window.partitionBy(*target)) <= F.col("t_lanes")
    return moves.withColumns({"first_lane": F.when(fits, (before + 1).cast("int")), "last_lane": F.when(fits, (before + F.col("s_lanes")).cast("int"))})


def classified(pairs: DataFrame) -> DataFrame:
    """split, join or continuation of each lane pair; a pair that would be both is left out.

    The pairs of a movement are gone through by source lane and target lane: one whose source has
    been met is a split, else one whose target has been met a join.
    """
    movement = ["s_segment", "s_travel", "t_segment", "t_travel"]
    a, b = Window.partitionBy(*movement, "s_lane").orderBy("t_lane"), Window.partitionBy(*movement, "t_lane").orderBy("s_lane")
    rows = pairs.withColumns({"_a": F.row_number().over(a), "_b": F.row_number().over(b)})
    split, join = F.col("_a") > 1, F.col("_b") > 1
    return rows.where(~(split & join)).withColumn("kind_of_lane", F.when(split, F.lit("split")).when(join, F.lit("join")).otherwise(F.lit("continuation"))).drop("_a", "_b")


def trims(connections: DataFrame) -> DataFrame:
    """How much of each cross-section end the connectors need: the greatest wish, within the budget.

    ``connections``: segment, travel, end (start or end), wish and length of the segment. Both ends
    together take at most 80 % and leave two metres or a fifth, whichever is more.
    """
    ends = connections.groupBy("segment", "travel", "end").agg(F.max("wish").alias("wish"), F.max("length").alias("length"))
    total = F.sum("wish").over(Window.partitionBy("segment", "travel"))
    budget = F.greatest(F.lit(0.0), F.least(F.col("length") * 0.8, F.col("length") - F.greatest(F.lit(2.0), F.col("length") * 0.2)))
    return ends.withColumn("trim", F.when(total > budget, F.col("wish") * budget / total).otherwise(F.col("wish"))).drop("wish", "length")


def handles(connections: DataFrame) -> DataFrame:
    """Handle length a shared end: the least of what its connectors could take."""
    return connections.groupBy("segment", "travel", "end").agg(F.min("handle").alias("handle"))


def connectors(pairs: DataFrame, touching: float = 0.05, straight: float = 3.0) -> DataFrame:
    """Lines between lane ends (x0, y0, b0, x1, y1, b1, handle): none where they touch, else straight or a curve."""
    gap = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    flat = (geo.angle_between("b0", "b1") <= straight) & (geo.angle_between(geo.azimuth(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), F.col("b0")) <= straight)
    ends = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    curve = geo.bezier("x0", "y0", "b0", "x1", "y1", "b1", F.least(F.col("handle"), gap / 2))
    return pairs.where(gap > touching).withColumn("line", F.when(flat, ends).otherwise(curve))


def overridden(pairs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Lane pairs with manual rules (action block or connect and the pair's keys); connect needs unique ends."""
    keys = ["s_segment", "s_travel", "s_lane", "t_segment", "t_travel", "t_lane"]
    blocked = overrides.where("action = 'block'").select(*keys)
    once = Window.partitionBy(*keys)
    added = overrides.where("action = 'connect'").withColumn("_n", F.count(F.lit(1)).over(once)).where("_n = 1").select(*keys).join(pairs.select(*keys), keys, "left_anti")
    return pairs.join(blocked, keys, "left_anti").unionByName(added, allowMissingColumns=True)


def markings(lanes: DataFrame) -> DataFrame:
    """Turn, destination and change permissions of each lane (tags, direction, lane_count, lane)."""
    own = lambda key: refs.lane_tag("tags", key, "direction", "lane_count", "lane")
    change = own("change:lanes")
    return lanes.withColumns({"turn_mark": own("turn:lanes"), "destination": own("destination:lanes"), "change_left": refs.change_allowed(change, "left"), "change_right": refs.change_allowed(change, "right")})


#: The turns in degrees, right positive, that each marking allows.
TURNS = {"sharp_left": (-135, -55), "left": (-135, -20), "slight_left": (-60, -5), "through": (-25, 25), "slight_right": (5, 60), "right": (20, 135), "sharp_right": (55, 135)}


def compatible(token: Column, turn: Column) -> Column:
    """Whether one of the turn markings at ``;`` fits a signed turn in degrees; unknown markings fit nothing, no marking all."""
    each = lambda x: F.coalesce(*[F.when(x == k, turn.between(a, b)) for k, (a, b) in TURNS.items()], F.when(x == "reverse", F.abs(turn) >= 135), F.lit(False))
    return F.coalesce(F.exists(F.split(token, ";"), lambda x: each(F.lower(F.trim(x)))), F.lit(True))


def traversal_groups(traversals: DataFrame) -> DataFrame:
    """One row a (segment_id, direction) with its lanes in the order of their numbers; the first represents the group."""
    lanes = F.array_sort(F.collect_list(F.struct("lane_nr", "lane_id")))
    return traversals.groupBy("segment_id", "direction").agg(lanes.alias("lanes")).withColumn("representative", F.col("lanes")[0]["lane_id"])
