"""The lane network: which lane leads into which, where transitions lie, and the connectors between.

Lanes are lines in metres. All steps are joins on nodes, grid cells, segments and lanes, windows over
a junction's few movements and array functions over a cross-section's few lanes; nothing gathers more
than one cross-section or one junction arm.

    lanes: lane_id, road, segment, direction (fwd, bwd, both, unknown), lane (from 1, driver's left to
           right), lane_count, line (fwd and bwd in the order of travel), axis (first and last point of
           the way's own segment, null where unknown), start_node, end_node (null or 0: unknown)
    roads: road, highway, tags (map)

Turns are signed degrees, right positive. Where the order of candidates matters, ties go by segment
and direction of travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, refs
from ..scratch import materialize
from .lanes import JUNCTION_M, TURNS, WIDTH
from .spatial import point_join

#: Sharpest turn, angle under which two choices are alike, tolerances of ends in metres.
MOST_TURN, ALIKE, SAME_POINT_M, TOUCHING_M = 135.0, 7.5, 0.5, 0.05
#: Turn markings that leave the road to one side, and those that keep a lane on it.
LEFT = ["left", "slight_left", "sharp_left"]
RIGHT = ["right", "slight_right", "sharp_right"]
KEEP_ON = ["none", "through", "merge_to_left", "merge_to_right"]
#: Change markings that let traffic go to a side, and all known ones.
CHANGE = {"left": ["yes", "not_right", "only_left"], "right": ["yes", "not_left", "only_right"]}
CHANGE_KNOWN = ["yes", "no", "not_left", "not_right", "only_left", "only_right"]
#: Angle, looking back and least distance of blocks that share a target.
BLOCK_TURN, BLOCK_LINK_TURN, BLOCK_BACK_M, BLOCK_APART_M = 30.0, 45.0, 30.0, 1.0
#: Angle, shift of ends, spacing and most samples of a placement transition.
TRANSITION_TURN, TRANSITION_SHIFT_M, TRANSITION_SPACING_M, TRANSITION_SAMPLES = 60.0, 25.0, 0.25, 64

SOURCE, TARGET = ["s_segment", "s_travel"], ["t_segment", "t_travel"]
MOVE = [*SOURCE, *TARGET]


def _text(tags, key: str) -> Column:
    return F.lower(F.trim(F.coalesce(refs.tag(tags, key), F.lit(""))))


def _tokens(field: Column) -> Column:
    return F.filter(F.transform(F.split(field, ";"), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def _fields(tags: str, base: str, travel: str) -> Column:
    """The ``|`` fields of the key that holds for this way of travel; plain keys count for forward travel and reversed one-way roads."""
    back = F.coalesce(refs.tag(tags, f"{base}:backward"), F.when(_text(tags, "oneway") == "-1", refs.tag(tags, base)))
    return F.split(F.when(F.col(travel) == "fwd", F.coalesce(refs.tag(tags, f"{base}:forward"), refs.tag(tags, base))).otherwise(back), r"\|", -1)


def _anchor(tags: str, travel: str, outgoing: bool) -> Column:
    """``struct<kind, lane>`` of the placement at this end: that of the end, else of the direction, else the plain one."""
    end = lambda o: f"placement:{'end' if o else 'start'}"
    first = F.when(F.col(travel) == "fwd", refs.tag(tags, end(outgoing))).otherwise(refs.tag(tags, end(not outgoing)))
    second = F.when(F.col(travel) == "fwd", refs.tag(tags, "placement:forward")).otherwise(refs.tag(tags, "placement:backward"))
    value = F.lower(F.coalesce(first, second, refs.tag(tags, "placement")))
    given = refs.placement(value)
    none = F.lit(None).cast("int")
    return F.when(F.trim(value) == "transition", F.struct(F.lit("transition").alias("kind"), none.alias("lane"))).when(given["lane"] > 0, given)


def fits(token: Column, turn) -> Column:
    """Whether a turn marking allows this turn."""
    turn = F.col(turn) if isinstance(turn, str) else turn
    return F.coalesce(*[F.when(token == k, turn.between(a, b)) for k, (a, b) in TURNS.items()], F.when(token == "reverse", F.abs(turn) >= 135), F.lit(False))


def _bearing(line: Column, at_end: bool) -> Column:
    a, b = (F.try_element_at(line, F.lit(i)) for i in ((-2, -1) if at_end else (1, 2)))
    return geo.azimuth(b["x"] - a["x"], b["y"] - a["y"])


def walks(lanes: DataFrame, roads: DataFrame) -> DataFrame:
    """A row for each lane and way of travel: lines in the order of travel, nodes, the road's tags, the lane's markings.

    Lanes of direction ``both`` are travelled both ways, ``unknown`` ones not at all.
    """
    ways = F.when(F.col("direction") == "both", F.array(F.lit("fwd"), F.lit("bwd"))).when(F.col("direction").isin("fwd", "bwd"), F.array("direction")).otherwise(F.array().cast("array<string>"))
    rows = lanes.withColumn("travel", F.explode(ways)).join(roads.select("road", "highway", F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags")), "road", "left")
    rows = rows.withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))
    back = F.col("travel") == "bwd"
    node = lambda c: F.nullif(F.col(c).cast("long"), F.lit(0))
    rows = rows.withColumns(
        {
            "line": F.when(back & (F.col("direction") == "both"), F.reverse("line")).otherwise(F.col("line")),
            "axis": F.when(back, F.reverse("axis")).otherwise(F.col("axis")),
            "entry": F.when(back, node("end_node")).otherwise(node("start_node")),
            "exit": F.when(back, node("start_node")).otherwise(node("end_node")),
        }
    )
    for name, base in (("marks", "turn:lanes"), ("dest", "destination:lanes"), ("dest_ref", "destination:ref:lanes"), ("change", "change:lanes")):
        rows = rows.withColumn("_f", _fields("tags", base, "travel"))
        rows = rows.withColumn(name, F.when(F.size("_f") == F.col("lane_count"), F.coalesce(_tokens(F.get("_f", F.col("lane") - 1)), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("flags", refs.road_flags(F.col("highway"), F.col("tags"))).drop("_f", "start_node", "end_node")


def cross_sections(walked: DataFrame) -> DataFrame:
    """A row for each segment and way of travel: its lanes as ``members`` in their order, and what the first lane has."""
    member = F.struct("lane", "lane_id", "marks", "dest", "dest_ref", "change")
    first = F.struct("road", "highway", "tags", "flags", "line", "axis", "entry", "exit", "lane_count")
    rows = walked.groupBy("segment", "travel").agg(F.array_sort(F.collect_list(member)).alias("members"), F.min_by(first, F.struct("lane", "lane_id")).alias("_r")).select("segment", "travel", "members", "_r.*")
    fields = _fields("tags", "turn:lanes", "travel")
    return rows.withColumn("turns", F.when(F.size(fields) == F.col("lane_count"), F.flatten(F.transform(fields, _tokens))).otherwise(F.array().cast("array<string>"))).withColumns({"out_anchor": _anchor("tags", "travel", True), "in_anchor": _anchor("tags", "travel", False)})


def _structure(tags: str) -> Column:
    yes = lambda k: ~_text(tags, k).isin("", "no", "false", "0")
    return F.when(yes("bridge"), F.lit("bridge")).when(yes("tunnel"), F.lit("tunnel")).when(yes("covered"), F.lit("covered")).otherwise(F.lit("surface"))


def movements(sections: DataFrame) -> DataFrame:
    """(source, target) cross-sections that may follow each other, with turn, dist, evidence, kind and score.

    evidence: node_exact (one node), endpoint_exact (a node is unknown and the ways' ends are within half
    a metre), else junction_box (within 25 m; level, structure and class have to go together, and road,
    link, roundabout or marking has to speak for it). Sections without axis take no part.
    """
    base = ["segment", "travel", "road", "highway", "tags", "flags", "members", "lane_count"]
    shared = lambda p: [*(F.col(c).alias(f"{p}_{c}") for c in base), F.coalesce(refs.tag("tags", "layer").try_cast("double"), F.when(refs.tag("tags", "layer").isNull(), 0.0), F.lit(0.0)).alias(f"{p}_layer"), _structure("tags").alias(f"{p}_structure")]
    known = sections.where("axis is not null")
    moving = F.when(F.col("out_anchor.kind") == "transition", F.col("axis")).otherwise(F.col("line"))
    coming = F.when(F.col("in_anchor.kind") == "transition", F.col("axis")).otherwise(F.col("line"))
    end, begin = F.try_element_at("axis", F.lit(-1)), F.try_element_at("axis", F.lit(1))
    out = known.select(*shared("s"), F.col("turns").alias("s_turns"), F.col("out_anchor").alias("s_anchor"), F.col("exit"), end["x"].alias("x"), end["y"].alias("y"), _bearing(moving, True).alias("s_bearing"))
    into = known.select(*shared("t"), F.col("in_anchor").alias("t_anchor"), F.col("axis").alias("t_axis"), F.col("entry"), begin["x"].alias("rx"), begin["y"].alias("ry"), _bearing(coming, False).alias("t_bearing"))
    exact = out.join(into, F.col("exit") == F.col("entry")).withColumn("dist", F.hypot(F.col("rx") - F.col("x"), F.col("ry") - F.col("y"))).withColumn("evidence", F.lit("node_exact"))
    near = point_join(out, into, JUNCTION_M).where("not coalesce(exit = entry, false)")
    near = near.withColumn("evidence", F.when((F.col("exit").isNull() | F.col("entry").isNull()) & (F.col("dist") <= SAME_POINT_M), F.lit("endpoint_exact")).otherwise(F.lit("junction_box")))
    pairs = exact.unionByName(near).where("s_segment <> t_segment").withColumn("turn", geo.turn("s_bearing", "t_bearing")).where(F.abs("turn") <= MOST_TURN)

    same = lambda k: F.coalesce((refs.tag("s_tags", k) != "") & (refs.tag("s_tags", k) == refs.tag("t_tags", k)), F.lit(False))
    s_link, t_link = F.col("s_flags.is_link"), F.col("t_flags.is_link")
    round_ = F.col("s_flags.is_roundabout") | F.col("t_flags.is_roundabout")
    tagged = F.exists("s_turns", lambda x: fits(x, "turn"))
    leaving = F.exists("s_turns", lambda x: x.isin(*LEFT, *RIGHT, "reverse") & fits(x, "turn"))
    pairs = pairs.withColumns({"exact": F.col("evidence") != "junction_box", "same_ref": same("ref"), "same_name": same("name")})
    level = (F.abs(F.col("s_layer") - F.col("t_layer")) <= 0.01) & (F.col("s_structure") == F.col("t_structure"))
    motorway = ~s_link & ~t_link & F.coalesce((F.col("s_highway") == "motorway") | (F.col("t_highway") == "motorway"), F.lit(False)) & ~F.col("s_highway").eqNullSafe(F.col("t_highway"))
    spoken = F.col("same_ref") | F.col("same_name") | (s_link != t_link) | round_ | tagged
    pairs = pairs.where(F.col("exact") | (level & ~((s_link != t_link) & (F.abs("turn") > 45)) & ~motorway & spoken))
    kind = (
        F.when(~s_link & t_link & (F.abs("turn") <= 45), F.lit("exit"))
        .when(s_link & ~t_link, F.lit("entry"))
        .when(round_, F.lit("roundabout"))
        .when(leaving, F.lit("tagged"))
        .when(F.col("same_ref"), F.lit("continuation"))
        .when(tagged, F.lit("tagged"))
        .otherwise(F.lit("continuation"))
    )
    rank = F.when(F.col("evidence") == "node_exact", 0).when(F.col("evidence") == "endpoint_exact", 1).otherwise(2)
    score = F.struct(rank.alias("evidence"), (~F.col("same_ref")).alias("other_ref"), (~F.col("same_name")).alias("other_name"), F.abs("turn").alias("turn"), F.col("dist").alias("dist"))
    anchored = F.coalesce((F.col("s_anchor.kind") != "transition") & (F.col("s_anchor.kind") == F.col("t_anchor.kind")) & F.col("s_anchor.lane").eqNullSafe(F.col("t_anchor.lane")), F.lit(False))
    return pairs.withColumns({"kind": kind, "score": score, "anchored": anchored, "s_out": F.coalesce(F.col("s_anchor.kind") == "transition", F.lit(False))}).drop("x", "y", "rx", "ry", "exit", "entry", "s_bearing", "t_bearing", "s_turns", "s_layer", "t_layer", "s_structure", "t_structure")


def undominated(moves: DataFrame, sections: DataFrame, reach: float = JUNCTION_M + 0.5) -> DataFrame:
    """Movements without the near ones that one or two short exact passages make needless.

    A near exit to a link goes too where any exact movement leads into that link; near movements of a
    section without exact successors stay.
    """
    steps = moves.where("exact").select(*MOVE)
    length = sections.select(F.col("segment").alias("t_segment"), F.col("travel").alias("t_travel"), geo.line_length("line").alias("len"))
    short = materialize(steps.join(length, TARGET))
    here = lambda df, *more: df.select(*SOURCE, F.col("t_segment").alias("m_segment"), F.col("t_travel").alias("m_travel"), *more)
    after = short.select(F.col("s_segment").alias("m_segment"), F.col("s_travel").alias("m_travel"), *TARGET, F.col("len").alias("n_len"))
    once = here(short, "len").where(F.col("len") <= reach).join(after, ["m_segment", "m_travel"])
    twice = here(once, (F.col("len") + F.col("n_len")).alias("len")).where(F.col("len") <= reach).join(after, ["m_segment", "m_travel"])
    near = moves.where("not exact").join(once.select(*MOVE).unionByName(twice.select(*MOVE)).distinct(), MOVE, "left_anti")
    reached = steps.select(*TARGET).distinct().withColumn("_reached", F.lit(True))
    near = near.join(reached, TARGET, "left").where(~(~F.col("s_flags.is_link") & F.col("t_flags.is_link") & F.col("_reached").isNotNull()))
    return moves.where("exact").unionByName(near.select(*moves.columns))


def chosen(moves: DataFrame) -> DataFrame:
    """One way on (continuation or entry) of each source and one a branch's kind and side; unclear ones fall.

    Two are alike if they share evidence, road and name and their turns differ by less than 7.5 degrees.
    """
    side = F.when(F.col("turn") < -15, F.lit("left")).when(F.col("turn") > 15, F.lit("right")).otherwise(F.lit("through"))
    rows = moves.withColumn("_g", F.when(F.col("kind").isin("continuation", "entry"), F.lit("on")).otherwise(F.concat_ws(":", "kind", side)))
    w = Window.partitionBy(*SOURCE, "_g").orderBy("score", *TARGET)
    alike = F.coalesce((F.lead("score.evidence").over(w) == F.col("score.evidence")) & (F.lead("score.other_ref").over(w) == F.col("score.other_ref")) & (F.lead("score.other_name").over(w) == F.col("score.other_name")) & (F.abs(F.lead("turn").over(w) - F.col("turn")) < ALIKE), F.lit(False))
    return rows.withColumns({"_rank": F.row_number().over(w), "_alike": alike}).where("_rank = 1 and not _alike").drop("_g", "_rank", "_alike")


def assigned(moves: DataFrame) -> DataFrame:
    """``moves`` (kind, turn, anchored, t_ref, t_name; src and tgt: members of both sides) with pairs (s, t: lanes) and reason.

    Exits and marked branches use the lanes whose marking says so, those to that side first, else as many
    rightmost lanes as the target has; of these the ones signed for the target's road. Entries take the
    target's rightmost lanes. Equal numbers go one to one. Marked merges join the next lane that stays on
    their side. Other losses are left open, unless placements tie the first lanes. Gains open on the side
    where lane numbers or placements leave them, unless the lane beside forbids the change.
    """
    none = F.array().cast("array<struct<s:int,t:int>>")
    upto = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    pair = lambda s, t: F.struct(s["lane"].cast("int").alias("s"), t["lane"].cast("int").alias("t"))
    branch = F.col("kind").isin("exit", "tagged")
    wanted = F.when(F.col("turn") > 5, F.array(*map(F.lit, RIGHT))).when(F.col("turn") < -5, F.array(*map(F.lit, LEFT))).otherwise(F.array().cast("array<string>"))
    rows = moves.withColumn("_match", F.filter("src", lambda x: F.exists(x["marks"], lambda k: fits(k, "turn")))).withColumn("_wanted", wanted)
    rows = rows.withColumn("_there", F.filter("_match", lambda x: F.exists(x["marks"], lambda k: F.array_contains("_wanted", k) & fits(k, "turn"))))
    n, m = F.size("src"), F.size("tgt")
    k = F.least(n, m)
    rows = rows.withColumn("_picked", F.when(F.size("_there") > 0, F.col("_there")).when(F.size("_match") > 0, F.col("_match")).otherwise(F.when(k > 0, F.slice("src", n - k + 1, k)).otherwise(F.slice("src", 1, 0))))
    signed = F.filter("_picked", lambda x: ((F.col("t_ref") != "") & F.array_contains(x["dest_ref"], F.col("t_ref"))) | ((F.col("t_name") != "") & F.array_contains(x["dest"], F.col("t_name"))))
    rows = rows.withColumn("_signed", signed).withColumn("_use", F.when(branch, F.when(F.size("_signed") > 0, F.col("_signed")).otherwise(F.col("_picked"))).otherwise(F.col("src")))
    rows = rows.withColumns({"_n": F.size("_use"), "_m": F.size("tgt"), "_steps": F.transform("_use", lambda x: F.when(F.array_contains(x["marks"], "merge_to_left"), -1).when(F.array_contains(x["marks"], "merge_to_right"), 1).otherwise(0))})
    n, m = F.col("_n"), F.col("_m")
    # a lane that stays has as many before it as its target; one that merges left goes to the one before, right to the next
    place = F.transform("_steps", lambda s, i: F.size(F.filter(F.slice("_steps", F.lit(1), i), lambda x: x == 0)) - F.when(s == -1, 1).otherwise(0))
    rows = rows.withColumn("_place", place)
    merged = (n > m) & (F.size(F.filter("_steps", lambda x: x != 0)) == n - m) & F.forall("_place", lambda p: (p >= 0) & (p < m))
    numbers = lambda c: F.transform(c, lambda x: x["lane"])
    own, its = numbers("_use"), numbers("tgt")
    first, last = lambda c: F.get(c, F.lit(0)), lambda c: F.try_element_at(c, F.lit(-1))
    side = F.when((n > 0) & (n < m), F.when(F.slice(its, F.lit(1), n) == own, F.lit("right")).when(F.slice(its, m - n + 1, n) == own, F.lit("left")).when(F.col("anchored") & (first(its) == first(own)), F.lit("right")).when(F.col("anchored") & (last(its) == last(own)), F.lit("left")))
    rows = rows.withColumns({"_merged": merged & (F.col("kind") != "entry"), "_side": side})
    edge = F.when(F.col("_side") == "right", F.try_element_at("_use", F.lit(-1))).otherwise(F.get("_use", F.lit(0)))["change"]
    known = F.filter(edge, lambda x: x.isin(*CHANGE_KNOWN))
    may = lambda s: F.exists(known, lambda x: x.isin(*CHANGE[s]))
    rows = rows.withColumn("_veto", F.coalesce((F.size(known) > 0) & ~F.when(F.col("_side") == "right", may("right")).when(F.col("_side") == "left", may("left")), F.lit(False)))

    zipped = lambda count, t0: F.transform(upto(F.lit(0), count - 1), lambda i: pair(F.get("_use", i), F.get("tgt", i + t0)))
    k = F.least(n, m)
    gained = F.when(F.col("_veto"), none).when(F.col("_side") == "right", F.transform(upto(n, m - 1), lambda j: pair(F.try_element_at("_use", F.lit(-1)), F.get("tgt", j)))).otherwise(F.transform(upto(F.lit(0), m - n - 1), lambda j: pair(F.get("_use", F.lit(0)), F.get("tgt", j))))
    pairs = (
        F.when((n == 0) | (m == 0), none)
        .when(F.col("kind") == "entry", zipped(k, m - k))
        .when(n == m, zipped(n, F.lit(0)))
        .when(F.col("_merged"), F.transform("_use", lambda x, i: pair(x, F.get("tgt", F.get("_place", i)))))
        .when(n > m, F.when(F.col("anchored"), zipped(m, F.lit(0))).otherwise(none))
        .when(F.col("_side").isNull(), zipped(n, F.lit(0)))
        .otherwise(F.concat(zipped(n, F.when(F.col("_side") == "left", m - n).otherwise(0)), gained))
    )
    plain = (n > 0) & (m > 0) & (F.col("kind") != "entry")
    reason = F.when(plain & (n > m) & ~F.col("_merged"), F.lit("unresolved_narrowing_merge")).when(plain & (n < m) & F.col("_side").isNull(), F.lit("unresolved_widening_side")).when(plain & (n < m) & F.col("_veto"), F.lit("change_lanes_conflict"))
    return rows.withColumns({"pairs": pairs, "reason": reason}).drop("_match", "_wanted", "_there", "_picked", "_signed", "_use", "_n", "_m", "_steps", "_place", "_merged", "_side", "_veto")


def _ready(moves: DataFrame) -> DataFrame:
    return moves.withColumns({"src": F.col("s_members"), "tgt": F.col("t_members"), "t_ref": _text("t_tags", "ref"), "t_name": _text("t_tags", "name")})


def claimed(moves: DataFrame) -> DataFrame:
    """:func:`assigned` where branches come first: lanes marked for their branch alone are closed to the other movements of the source."""
    first = F.col("kind").isin("exit", "tagged")
    branches = assigned(moves.where(first))
    leaving = F.filter("src", lambda x: F.arrays_overlap(x["marks"], F.array(*map(F.lit, [*LEFT, *RIGHT, "reverse"]))) & ~F.arrays_overlap(x["marks"], F.array(*map(F.lit, KEEP_ON))))
    owned = branches.select(*SOURCE, F.explode(F.array_intersect(F.transform(leaving, lambda x: x["lane"].cast("int")), F.transform("pairs", lambda p: p["s"]))).alias("lane")).groupBy(*SOURCE).agg(F.collect_set("lane").alias("_owned"))
    rest = moves.where(~first).join(owned, SOURCE, "left").withColumn("src", F.filter("src", lambda x: ~F.coalesce(F.array_contains("_owned", x["lane"].cast("int")), F.lit(False)))).drop("_owned")
    return branches.unionByName(assigned(rest))


def classified(moves: DataFrame) -> DataFrame:
    """A row (s_lane, t_lane, type) for each pair of ``moves``: split where the source lane has been met, else join where the target has.

    The pairs of a movement are gone through by source and target lane; what would be both is left out.
    """
    pairs = moves.withColumn("_p", F.explode("pairs")).withColumns({"s_lane": F.col("_p.s"), "t_lane": F.col("_p.t")}).drop("_p", "pairs")
    a, b = Window.partitionBy(*MOVE, "s_lane").orderBy("t_lane"), Window.partitionBy(*MOVE, "t_lane").orderBy("s_lane")
    rows = pairs.withColumns({"_a": F.row_number().over(a) > 1, "_b": F.row_number().over(b) > 1})
    return rows.where(~(F.col("_a") & F.col("_b"))).withColumn("type", F.when(F.col("_a"), F.lit("split")).when(F.col("_b"), F.lit("join")).otherwise(F.lit("continuation"))).drop("_a", "_b")


def _line_of(walked: DataFrame, side: str) -> DataFrame:
    return walked.select(F.col("segment").alias(f"{side}_segment"), F.col("travel").alias(f"{side}_travel"), F.col("lane").cast("int").alias(f"{side}_lane"), F.col("lane_id").alias(f"{side}_id"), F.col("direction").alias(f"{side}_stored"), F.col("line").alias(f"{side}_line"))


def joint_blocks(edges: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """``edges`` where sources that fill a target together get a block of its lanes each, in their order from the left.

    All movements into the target have to be exact, at most 30 degrees sharp (45 with a link), with all
    lanes of their sources, and these as many as the target's lanes. The order is that of the sources'
    lanes beside the target's axis some way back; two that lie within a metre leave all as it was, and so
    does a ``blocked`` pair (s_id, t_id).
    """
    back = F.least(F.lit(BLOCK_BACK_M), F.col("axis_len") * 0.5, F.col("least_len") * 0.5)
    lanes = edges.dropDuplicates([*MOVE, "s_lane"]).withColumns({"len": geo.line_length("s_line"), "axis_len": geo.line_length("t_axis")})
    limit = F.when(F.col("s_flags.is_link") | F.col("t_flags.is_link"), BLOCK_LINK_TURN).otherwise(BLOCK_TURN)
    good = F.col("exact") & F.col("kind").isin("continuation", "entry", "exit") & (F.abs("turn") <= limit)
    at = Window.partitionBy(*TARGET)
    lanes = lanes.withColumns({"least_len": F.min("len").over(at), "_good": F.min(good).over(at), "_all": F.count(F.lit(1)).over(at), "_own": F.count(F.lit(1)).over(Window.partitionBy(*MOVE))})
    lanes = materialize(lanes.where("_good and _all = size(t_members)").withColumn("back", back).where("back >= 5"))
    ax, bx = F.get("t_axis", F.lit(0)), F.get("t_axis", F.lit(1))
    ux, uy = geo._unit(bx["x"] - ax["x"], bx["y"] - ax["y"])
    p = geo.point_at("s_line", F.greatest(F.lit(0.0), F.col("len") - F.col("back")))
    lanes = materialize(lanes.withColumn("_p", p)).withColumns({"_dx": F.col("_p.x"), "_dy": F.col("_p.y"), "_ux": ux, "_uy": uy, "_rx": ax["x"] - ux * F.col("back"), "_ry": ax["y"] - uy * F.col("back")})
    spot = [F.first(c).alias(c) for c in ("_ux", "_uy", "_rx", "_ry", "back", "axis_len", "least_len", "_own")]
    blocks = lanes.groupBy(*MOVE).agg(F.size(F.first("s_members")).alias("_whole"), F.avg("_dx").alias("_cx"), F.avg("_dy").alias("_cy"), *spot)
    blocks = blocks.withColumn("left", -F.col("_uy") * (F.col("_cx") - F.col("_rx")) + F.col("_ux") * (F.col("_cy") - F.col("_ry")))
    order = Window.partitionBy(*TARGET).orderBy(F.desc("left"))
    blocks = blocks.withColumns({"_apart": F.col("left") - F.lead("left").over(order), "base": F.coalesce(F.sum("_own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_sources": F.count(F.lit(1)).over(at), "_each": F.min(F.col("_own") == F.col("_whole")).over(at)})
    blocks = blocks.withColumn("_clear", F.min(F.coalesce(F.col("_apart") >= BLOCK_APART_M, F.lit(True))).over(at)).where("_sources > 1 and _each and _clear")
    trim = F.least(F.col("back"), F.col("axis_len") * 0.4, F.col("least_len") * 0.4)
    blocks = blocks.select(*MOVE, "base", trim.alias("_trim"))
    index = F.row_number().over(Window.partitionBy(*MOVE).orderBy("s_lane")) - 1
    made = lanes.select(*edges.columns).join(blocks, MOVE).withColumn("_i", index + F.col("base"))
    made = made.withColumns({"t_lane": F.get("t_members", F.col("_i").cast("int"))["lane"].cast("int"), "t_id": F.get("t_members", F.col("_i").cast("int"))["lane_id"], "type": F.lit("continuation"), "block": F.lit(True), "least_trim": F.when(F.col("s_out"), 0.0).otherwise(F.col("_trim"))})
    made = materialize(made.select(*edges.columns))
    if blocked is not None:
        made = made.join(made.join(blocked, ["s_id", "t_id"], "left_semi").select(*TARGET).distinct(), TARGET, "left_anti").select(*edges.columns)
    return edges.join(made.select(*TARGET).distinct(), TARGET, "left_anti").select(*edges.columns).unionByName(made)


def entry_claims(edges: DataFrame) -> DataFrame:
    """``edges`` without splits into a lane that an entry leads into."""
    entry = F.max(F.col("kind") == "entry").over(Window.partitionBy(*TARGET, "t_lane"))
    return edges.withColumn("_entry", entry).where(~(F.col("_entry") & (F.col("type") == "split") & (F.col("kind") != "entry"))).drop("_entry")


def topology(walked: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Lane to lane: a row for each edge with its movement, type (continuation, split, join), block and least_trim.

    ``blocked``: pairs (s_id, t_id of lanes, s_travel, t_travel) that are not made. A movement all of whose
    pairs are blocked leaves its place to others.
    """
    sections = materialize(cross_sections(walked))
    # plans are cut where array functions would be copied into each other
    moves = materialize(undominated(materialize(movements(sections)), sections))
    ready = materialize(_ready(moves))
    if blocked is not None:
        # a movement all of whose pairs are blocked isn't a choice
        alone = materialize(assigned(ready)).select(*MOVE, "s_members", "t_members", F.explode("pairs").alias("_p"))
        of = lambda c, k: F.filter(c, lambda x: x["lane"] == F.col(k))[0]["lane_id"]
        ids = alone.withColumns({"s_id": of("s_members", "_p.s"), "t_id": of("t_members", "_p.t")}).join(blocked.withColumn("_b", F.lit(True)), ["s_id", "t_id", "s_travel", "t_travel"], "left")
        gone = ids.groupBy(*MOVE).agg(F.max(F.col("_b").isNull()).alias("_some")).where("not _some").select(*MOVE)
        ready = ready.join(materialize(gone), MOVE, "left_anti").select(*ready.columns)
    edges = classified(materialize(claimed(materialize(chosen(ready)))))
    edges = edges.join(_line_of(walked, "s"), [*SOURCE, "s_lane"]).join(_line_of(walked, "t").drop("t_line", "t_stored"), [*TARGET, "t_lane"])
    if blocked is not None:
        edges = edges.join(blocked, ["s_id", "t_id", "s_travel", "t_travel"], "left_anti")
    edges = materialize(edges.withColumns({"block": F.lit(False), "least_trim": F.lit(0.0)}))
    return entry_claims(materialize(joint_blocks(edges, blocked)))


def connections(walked: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with trims and handles of both ends, and the connector's line (null where the ends touch).

    Trims are wished for where lanes near-straight go on beside each other; a cross-section's end shares
    the longest, and a lane keeps a fifth and two metres of itself. A shared end has the shortest handle
    of its connectors. A sideways shift of equal cross-sections is straight, everything else a curve.
    """
    t_line = walked.select(F.col("segment").alias("t_segment"), F.col("travel").alias("t_travel"), F.col("lane").cast("int").alias("t_lane"), F.col("line").alias("t_line"), F.col("direction").alias("t_stored"))
    rows = materialize(edges.join(t_line, [*TARGET, "t_lane"]).withColumns({"s_len": geo.line_length("s_line"), "t_len": geo.line_length("t_line")}))
    at = lambda line, i: F.try_element_at(line, F.lit(i))
    b, c = at("s_line", -1), at("t_line", 1)
    rows = rows.withColumns({"gap": F.hypot(c["x"] - b["x"], c["y"] - b["y"]), "_angle": geo.angle_between(_bearing(F.col("s_line"), True), _bearing(F.col("t_line"), False))})
    a, d = at("s_line", -2), at("t_line", 2)
    lateral = geo.lateral_shift(a["x"], a["y"], b["x"], b["y"], c["x"], c["y"], d["x"], d["y"])
    s_link, t_link = F.col("s_flags.is_link"), F.col("t_flags.is_link")
    change, equal = s_link != t_link, F.col("s_lane_count") == F.col("t_lane_count")
    beside = (F.col("s_flags.is_oneway") == F.col("t_flags.is_oneway")) & (lateral < 0.75)
    still = equal & ((F.col("gap") < 0.75) | F.coalesce(beside, F.lit(False)))
    sharp = F.col("_angle") > F.when(change & F.col("exact"), 45.0).otherwise(30.0)
    straightest = change & F.col("exact") & (F.col("_angle") <= 15)
    wish = F.least(F.when(straightest, 50.0).when(change, 25.0).otherwise(15.0), F.greatest(F.lit(5.0), F.col("gap") * F.when(straightest, 8.0).otherwise(4.0)))
    share = lambda link: F.when(change & link, 0.8).otherwise(0.4)
    none = still | (F.col("gap") > 8) | sharp
    ask = lambda n, link: F.greatest(F.when(none, 0.0).otherwise(F.least(wish, F.col(n) * share(link))), F.col("least_trim"))
    straight = equal & F.col("gap").between(0.75, 8.0) & ~F.coalesce(beside, F.lit(False)) & (F.col("_angle") <= 30)
    turned = lambda p: (F.col(f"{p}_stored") == "both") & (F.col(f"{p}_travel") == "bwd")
    ends = {"s_end": F.when(turned("s"), F.lit("start")).otherwise(F.lit("end")), "t_end": F.when(turned("t"), F.lit("end")).otherwise(F.lit("start"))}
    rows = materialize(rows.withColumns({"s_ask": ask("s_len", s_link), "t_ask": ask("t_len", t_link), "_straight": straight, **ends}).drop("s_tags", "t_tags", "s_members", "t_members", "src", "tgt", "_angle"))

    side = lambda p: rows.select(F.col(f"{p}_segment").alias("segment"), F.col(f"{p}_travel").alias("travel"), F.col(f"{p}_id").alias("id"), F.col(f"{p}_end").alias("end"), F.col(f"{p}_ask").alias("ask"), F.col(f"{p}_len").alias("len"))
    asked = side("s").unionByName(side("t")).groupBy("segment", "travel", "id", "end").agg(F.max("ask").alias("ask"), F.max("len").alias("len"))
    asked = asked.withColumn("ask", F.max("ask").over(Window.partitionBy("id", "end")))
    shared = F.max("ask").over(Window.partitionBy("segment", "travel", "end"))
    asked = asked.withColumn("ask", F.when(F.col("ask") > 0, shared).otherwise(0.0)).groupBy("id", "end").agg(F.max("ask").alias("ask"), F.max("len").alias("len"))
    total = F.sum("ask").over(Window.partitionBy("id"))
    budget = F.least(F.col("len") * 0.8, F.greatest(F.lit(0.0), F.col("len") - F.least(F.col("len"), F.greatest(F.lit(2.0), F.col("len") * 0.2))))
    trims = materialize(asked.withColumn("trim", F.when(total > budget, F.col("ask") * budget / total).otherwise(F.col("ask"))).select("id", "end", "trim", (total > budget).alias("scaled")))
    own = lambda p: trims.select(F.col("id").alias(f"{p}_id"), F.col("end").alias(f"{p}_end"), F.col("trim").alias(f"{p}_trim"), F.col("scaled").alias(f"{p}_scaled"))
    rows = rows.join(own("s"), ["s_id", "s_end"]).join(own("t"), ["t_id", "t_end"])
    rows = materialize(rows.withColumns({"_s": F.when(F.col("s_trim") > 0, geo.clip("s_line", F.lit(0.0), F.col("s_len") - F.col("s_trim"))).otherwise(F.col("s_line")), "_t": F.when(F.col("t_trim") > 0, geo.clip("t_line", F.col("t_trim"), F.col("t_len"))).otherwise(F.col("t_line"))}))
    b, c = at("_s", -1), at("_t", 1)
    rows = materialize(rows.withColumns({"x0": b["x"], "y0": b["y"], "b0": _bearing(F.col("_s"), True), "x1": c["x"], "y1": c["y"], "b1": _bearing(F.col("_t"), False)}).withColumn("span", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).drop("_s", "_t"))
    handle = lambda p: rows.select(F.col(f"{p}_id").alias("id"), F.col(f"{p}_end").alias("end"), F.least(F.lit(15.0), F.col("span") * 0.45).alias("handle"))
    handles = materialize(handle("s").unionByName(handle("t")).groupBy("id", "end").agg(F.min("handle").alias("handle")))
    of = lambda p: handles.select(F.col("id").alias(f"{p}_id"), F.col("end").alias(f"{p}_end"), F.col("handle").alias(f"{p}_handle"))
    rows = rows.join(of("s"), ["s_id", "s_end"]).join(of("t"), ["t_id", "t_end"])
    ends = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    curve = geo.bezier("x0", "y0", "b0", "x1", "y1", "b1", F.col("s_handle"), reach1=F.col("t_handle"))
    line = F.when(F.col("span") > TOUCHING_M, F.when(F.col("_straight"), ends).otherwise(curve))
    keep = [*MOVE, "s_lane", "t_lane", "s_id", "t_id", "s_road", "t_road", "kind", "type", "evidence", "exact", "turn", "dist", "block", "s_trim", "t_trim", "s_handle", "t_handle", (F.col("s_scaled") | F.col("t_scaled")).alias("scaled")]
    return rows.select(*keep, line.alias("line"))


def resolved_transitions(walked: DataFrame, joined: DataFrame) -> DataFrame:
    """segment, travel, reason and lanes (lane_id, line, start_shift, end_shift) of each one-way ``placement=transition`` section.

    Each of its lanes needs one lane before and one behind it (of another road, over an exact connection
    with a line, or else touching it at a shared node; transitions don't count) or its own placement
    there. The lanes then run from one to the other as curves with common handles, unless the ends'
    directions differ by more than 60 degrees, an end moves by more than 25 m, curves cross themselves or
    each other, or two neighbours are not 3.5 m apart, give or take 0.25. Then ``reason`` says so and
    lanes is null.
    """
    own = F.trim(F.lower(F.coalesce(refs.tag("tags", "placement"), F.lit("")))) == "transition"
    moving = walked.where(F.col("flags.is_oneway") & own).select("segment", "travel", "lane", "lane_id", "lane_count", "road", "direction", "line", "axis", "entry", "exit", "tags")
    other = walked.select(F.col("lane_id").alias("o_id"), F.col("travel").alias("o_travel"), F.col("segment").alias("o_segment"), F.col("road").alias("o_road"), F.col("line").alias("o_line"), F.col("entry").alias("o_entry"), F.col("exit").alias("o_exit"), *[F.coalesce(_anchor("tags", "travel", o)["kind"] == "transition", F.lit(False)).alias(f"o_{'out' if o else 'in'}") for o in (True, False)])
    linked = joined.where("exact and line is not null").select("s_id", "s_travel", "t_id", "t_travel")
    me = moving.select("lane_id", "travel", F.col("road").alias("_road"), "line", "entry", "exit")

    def neighbours(before: bool) -> DataFrame:
        """lane_id, travel, n and the one lane before (or behind) each lane that moves."""
        mine, its = (("t", "s") if before else ("s", "t"))
        by_edge = linked.select(F.col(f"{mine}_id").alias("lane_id"), F.col(f"{mine}_travel").alias("travel"), F.col(f"{its}_id").alias("o_id"), F.col(f"{its}_travel").alias("o_travel")).join(other, ["o_id", "o_travel"]).join(me.select("lane_id", "travel", "_road"), ["lane_id", "travel"])
        node = (F.col("entry") == F.col("o_exit")) if before else (F.col("exit") == F.col("o_entry"))
        a, b = (F.get("line", F.lit(0)), F.try_element_at("o_line", F.lit(-1))) if before else (F.try_element_at("line", F.lit(-1)), F.get("o_line", F.lit(0)))
        touching = me.join(by_edge.select("lane_id", "travel").distinct(), ["lane_id", "travel"], "left_anti").join(other, node & (F.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= TOUCHING_M))
        cols = ["lane_id", "travel", "_road", "o_id", "o_segment", "o_road", "o_line", "o_out", "o_in"]
        every = by_edge.select(*cols).unionByName(touching.select(*cols)).where(F.col("o_road") != F.col("_road")).where(~F.col("o_out" if before else "o_in"))
        p = "p" if before else "q"
        return every.groupBy("lane_id", "travel").agg(F.count(F.lit(1)).alias(f"{p}_n"), F.first("o_segment").alias(f"{p}_segment"), F.first("o_line").alias(f"{p}_line"))

    rows = materialize(moving.join(neighbours(True), ["lane_id", "travel"], "left").join(neighbours(False), ["lane_id", "travel"], "left"))

    def given(outgoing: bool) -> Column:
        """The end that the lane's own placement tag gives."""
        anchor = _anchor("tags", "travel", outgoing)
        a, b = F.get("axis", F.lit(0)), F.try_element_at("axis", F.lit(-1))
        ux, uy = geo._unit(b["x"] - a["x"], b["y"] - a["y"])
        left = F.when(anchor["kind"] == "right_of", WIDTH / 2).when(anchor["kind"] == "left_of", -WIDTH / 2).otherwise(0.0) + (anchor["lane"] - F.col("lane")) * WIDTH
        at = b if outgoing else a
        return F.when((anchor["kind"] != "transition") & (anchor["lane"] <= F.col("lane_count")) & F.col("axis").isNotNull(), F.struct((at["x"] - uy * left).alias("x"), (at["y"] + ux * left).alias("y")))

    one = lambda p: F.coalesce(F.col(f"{p}_n") == 1, F.lit(False))
    rows = materialize(rows.withColumns({"_start": given(False), "_end": given(True)}))
    rows = rows.withColumns(
        {
            "start": F.coalesce("_start", F.when(one("p"), F.try_element_at("p_line", F.lit(-1)))),
            "end": F.coalesce("_end", F.when(one("q"), F.get("q_line", F.lit(0)))),
            "b0": F.radians(F.when(one("p"), _bearing(F.col("p_line"), True)).otherwise(_bearing(F.col("line"), False))),
            "b1": F.radians(F.when(one("q"), _bearing(F.col("q_line"), False)).otherwise(_bearing(F.col("line"), True))),
            "p_ref": F.when(one("p"), F.col("p_segment")).otherwise(F.lit("explicit")),
            "q_ref": F.when(one("q"), F.col("q_segment")).otherwise(F.lit("explicit")),
            "_odd": (F.col("direction") == "both") | (F.size("line") != 2),
        }
    )
    rows = materialize(rows.drop("tags", "p_line", "q_line"))
    # of lanes with one flaw each the first in the order of lanes names the section's
    flaw = F.when(F.col("start").isNull(), F.lit("ambiguous_start_anchor")).when(F.col("end").isNull(), F.lit("ambiguous_end_anchor"))
    span = F.hypot(F.col("end.x") - F.col("start.x"), F.col("end.y") - F.col("start.y"))
    at = ["segment", "travel"]
    whole = rows.withColumn("_flaw", flaw).groupBy(*at).agg(
        F.max("_odd").alias("_odd"),
        F.min(F.when(F.col("_flaw").isNotNull(), F.struct("lane", "_flaw")))["_flaw"].alias("_flaw"),
        F.size(F.collect_set("p_ref")).alias("_p"),
        F.size(F.collect_set("q_ref")).alias("_q"),
        *[F.degrees(F.atan2(F.sum(F.sin(b)), F.sum(F.cos(b)))).alias(f"_m{b}") for b in ("b0", "b1")],
        F.avg(span).alias("_span"),
    )
    reason = F.when(F.col("_odd"), F.lit("non_simple_transition_geometry")).when(F.col("_flaw").isNotNull(), F.col("_flaw")).when((F.col("_p") > 1) | (F.col("_q") > 1), F.lit("mixed_neighbor_lane_blocks"))
    reason = reason.when(geo.angle_between("_mb0", "_mb1") > TRANSITION_TURN, F.lit("transition_angle_too_large"))
    whole = whole.withColumns({"reason": reason, "_n": F.greatest(F.lit(12), F.least(F.lit(TRANSITION_SAMPLES), F.ceil("_span"))).cast("int"), "_reach": F.least(F.lit(15.0), F.col("_span") * 0.45)})
    rows = materialize(rows.join(whole.select(*at, "reason", "_n", "_reach"), at))
    curve = geo.bezier(F.col("start.x"), F.col("start.y"), F.degrees("b0"), F.col("end.x"), F.col("end.y"), F.degrees("b1"), F.col("_reach"), samples=F.col("_n"))
    first, last = F.get("line", F.lit(0)), F.try_element_at("line", F.lit(-1))
    away = lambda p, q: F.hypot(p["x"] - F.col(q)["x"], p["y"] - F.col(q)["y"])
    rows = materialize(rows.withColumns({"curve": F.when(F.col("reason").isNull(), curve), "start_shift": away(first, "start"), "end_shift": away(last, "end")}))
    flaw = F.when(F.greatest("start_shift", "end_shift") > TRANSITION_SHIFT_M, F.lit("transition_endpoint_shift_too_large")).when(geo.crosses_itself("curve"), F.lit("transition_curve_not_simple"))
    rows = rows.withColumn("_flaw", F.when(F.col("reason").isNull(), flaw))
    lanes = F.array_sort(F.collect_list(F.struct("lane", "lane_id", F.col("curve").alias("line"), "start_shift", "end_shift")))
    rows = materialize(rows)
    out = rows.groupBy(*at).agg(F.first("reason").alias("reason"), F.min(F.when(F.col("_flaw").isNotNull(), F.struct("lane", "_flaw")))["_flaw"].alias("_flaw"), lanes.alias("lanes"))
    out = materialize(out)
    count = F.size("lanes")
    next_to = F.when(count > 1, F.zip_with(F.slice("lanes", F.lit(1), count - 1), F.slice("lanes", F.lit(2), count - 1), lambda a, b: F.exists(F.zip_with(a["line"], b["line"], lambda p, q: F.abs(F.hypot(p["x"] - q["x"], p["y"] - q["y"]) - WIDTH) > TRANSITION_SPACING_M), lambda x: x)))
    crossing = F.exists("lanes", lambda a: F.exists("lanes", lambda b: (a["lane"] < b["lane"]) & geo.crosses(a["line"], b["line"])))
    reason = F.coalesce("reason", "_flaw", F.when(F.exists(next_to, lambda x: x), F.lit("transition_lane_spacing_out_of_bounds")))
    reason = F.coalesce(reason, F.when(crossing, F.lit("transition_lanes_cross")))
    return out.withColumn("reason", reason).select(*at, "reason", F.when(reason.isNull(), F.transform("lanes", lambda x: F.struct(x["lane_id"], x["line"], x["start_shift"], x["end_shift"]))).alias("lanes"))


def overrides_of(overrides: DataFrame, walked: DataFrame) -> DataFrame:
    """Manual rules (action, source, target) with the lanes they name: s_id, s_travel, t_id, t_travel.

    A reference is ``lane_id@travel``, a lane_id that is travelled one way, or ``segment:lane`` that names
    one lane and way. One that names none or several raises.
    """
    names = walked.select("lane_id", "travel", F.explode(F.array_distinct(F.array(F.concat_ws("@", "lane_id", "travel"), F.col("lane_id"), F.concat_ws(":", "segment", F.col("lane").cast("string"))))).alias("name"))
    found = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("lane_id", "travel")).alias("at"))
    rows = overrides
    for side, p in (("source", "s"), ("target", "t")):
        rows = rows.join(found.select(F.col("name").alias(side), F.col("n").alias(f"_{p}"), F.col("at").alias(f"_at_{p}")), side, "left")
    wrong = lambda p, c: F.when(F.coalesce(F.col(f"_{p}"), F.lit(0)) != 1, F.raise_error(F.concat(F.when(F.col(f"_{p}").isNull(), F.lit("missing")).otherwise(F.lit("ambiguous")), F.lit(" lane: "), F.col(c))))
    ids = {f"{p}_{n}": F.when(F.col(f"_{p}") == 1, F.col(f"_at_{p}.{k}")).otherwise(wrong(p, c)) for p, c in (("s", "source"), ("t", "target")) for n, k in (("id", "lane_id"), ("travel", "travel"))}
    return rows.withColumns(ids).drop("_s", "_t", "_at_s", "_at_t")


def network(lanes: DataFrame, roads: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lanes, connections, transitions): the network is built, transitions are placed by it, and it is built again on their lines.

    ``overrides`` (action: block or connect, source, target): pairs that are not made, and such as are
    made whatever the rules say (type ``manual``).
    """
    given = materialize(walks(lanes, roads))
    manual = None if overrides is None else materialize(overrides_of(overrides, given))
    blocked = None if manual is None else manual.where("action = 'block'").select("s_id", "t_id", "s_travel", "t_travel").distinct()
    first = materialize(connections(given, topology(given, blocked)))
    placed = materialize(resolved_transitions(given, first))
    new = placed.select(F.explode("lanes").alias("_l")).select("_l.lane_id", F.col("_l.line").alias("_line"))
    moved = lanes.join(new, "lane_id", "left").withColumn("line", F.coalesce("_line", "line")).drop("_line")
    again = materialize(walks(moved, roads))
    made = connections(again, topology(again, blocked))
    if manual is not None:
        ends = lambda p: again.select(F.col("lane_id").alias(f"{p}_id"), F.col("travel").alias(f"{p}_travel"), F.col("segment").alias(f"{p}_segment"), F.col("lane").cast("int").alias(f"{p}_lane"), F.col("road").alias(f"{p}_road"), F.col("line").alias(f"_{p}"))
        wanted = manual.where("action = 'connect'").select("s_id", "t_id", "s_travel", "t_travel").distinct().join(ends("s"), ["s_id", "s_travel"]).join(ends("t"), ["t_id", "t_travel"])
        b, c = F.try_element_at("_s", F.lit(-1)), F.get("_t", F.lit(0))
        curve = geo.bezier(b["x"], b["y"], _bearing(F.col("_s"), True), c["x"], c["y"], _bearing(F.col("_t"), False), None)
        wanted = wanted.withColumns({"type": F.lit("manual"), "evidence": F.lit("manual"), "exact": F.lit(True), "block": F.lit(False), "line": F.when(F.hypot(c["x"] - b["x"], c["y"] - b["y"]) > TOUCHING_M, curve)}).drop("_s", "_t")
        made = made.join(wanted.select("s_id", "t_id", "s_travel", "t_travel"), ["s_id", "t_id", "s_travel", "t_travel"], "left_anti").unionByName(wanted, allowMissingColumns=True)
    return moved, made, placed
