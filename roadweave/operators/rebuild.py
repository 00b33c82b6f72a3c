"""Rebuilding the lane network around what changed, instead of as a whole.

A road's lanes, transitions and connectors follow from roads a few junctions away at most: a junction's
movements from the roads that meet there, a lane's trims from both its ends, a transition from the
connections before and behind it. So roads within ``HOPS`` junctions of a changed road are built again,
with as many junctions of context around them, and replace what was stored of them; the rest stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, small
from .lanes import JUNCTION_M
from .snapshot import changed_roads, replace_scoped

#: Junctions that a change reaches: movements, trims of their lanes, the lanes' other ends, and a transition between.
HOPS = 4
#: Side of a tile in metres.
TILE_M = 5_000.0

Build = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def ends(lanes: DataFrame, tile: float = TILE_M) -> DataFrame:
    """(tx, ty, road, x, y, node): both ends of the ways' segments; written by tile, it is read by the tiles asked for."""
    at = lambda i, node: F.struct(F.try_element_at("axis", F.lit(i))["x"].alias("x"), F.try_element_at("axis", F.lit(i))["y"].alias("y"), F.nullif(F.col(node).cast("long"), F.lit(0)).alias("node"))
    rows = lanes.where("axis is not null").select("road", F.explode(F.array(at(1, "start_node"), at(-1, "end_node"))).alias("e")).select("road", "e.*").distinct()
    return rows.select(F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"), "road", "x", "y", "node")


def reached(every: DataFrame, roads: DataFrame, hops: int, tile: float = TILE_M) -> DataFrame:
    """Roads (road) within ``hops`` junctions of ``roads``: over shared nodes, or ends within a junction's radius.

    ``every``: of :func:`ends`. Only the tiles of the roads just reached are read in a step, where the table is
    partitioned by them.
    """
    known = fresh = materialize(roads.select("road").distinct())
    cells = lambda c: F.sequence(F.floor((F.col(c) - JUNCTION_M) / tile), F.floor((F.col(c) + JUNCTION_M) / tile))
    # a road's own ends lie in tiles that are not known beforehand: one look-up a step by road, one by tile
    for _ in range(hops):
        own = materialize(every.join(small(fresh), "road", "left_semi").select("x", "y", F.col("node").alias("n")))
        spread = own.withColumn("tx", F.explode(cells("x"))).withColumn("ty", F.explode(cells("y"))).select("tx", "ty", F.col("x").alias("ox"), F.col("y").alias("oy"), "n")
        near = every.join(small(materialize(spread)), ["tx", "ty"]).where((F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) <= JUNCTION_M) | (F.col("node") == F.col("n")))
        fresh = materialize(near.select("road").distinct().join(known, "road", "left_anti"))
        if fresh.isEmpty():
            break
        known = materialize(known.unionByName(fresh))
    return known


def changed(stored: DataFrame, generated: DataFrame, *columns: str) -> DataFrame:
    """Roads (road) with another set of lanes, or lanes with other values of ``columns``."""
    marked = lambda df: df.select(F.col("road").alias("road_id"), F.concat_ws("|", "lane_id", F.xxhash64(F.to_json(F.struct(*columns)))).alias("id"))
    return changed_roads(marked(stored), marked(generated)).select(F.col("road_id").alias("road"))


def rebuilt(stored: tuple[DataFrame, DataFrame], before: DataFrame, lanes: DataFrame, roads: DataFrame, touched: DataFrame, build: Build, hops: int = HOPS, tile: float = TILE_M) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lanes, connections, scope) after the roads ``touched`` changed.

    ``stored``: lanes and connections as they were built from the given lanes ``before``; ``lanes``: the
    given lanes now, with those of new roads and without those of roads that went. ``build`` makes both
    from given lanes and roads. Roads near a touched one, before or now, are the scope that is replaced.
    """
    every = materialize(ends(before.select("road", "axis", "start_node", "end_node"), tile).unionByName(ends(lanes.select("road", "axis", "start_node", "end_node"), tile)).distinct())
    scope = reached(every, touched, hops, tile)
    context = reached(every, scope, hops, tile)
    held, inside = small(context), small(scope)
    made_lanes, made = build(lanes.join(held, "road", "left_semi"), roads.join(held, "road", "left_semi"))
    old_lanes, old = stored
    new_lanes = old_lanes.join(inside, "road", "left_anti").unionByName(made_lanes.join(inside, "road", "left_semi").select(*old_lanes.columns))
    made = materialize(made)
    of = lambda end: made.join(inside.withColumnRenamed("road", end), end, "left_semi")
    here = of("s_road").select(*old.columns).unionByName(of("t_road").join(scope.withColumnRenamed("road", "s_road"), "s_road", "left_anti").select(*old.columns))
    return new_lanes, replace_scoped(old, here, scope.withColumnRenamed("road", "road_id"), ["s_road", "t_road"]), scope
