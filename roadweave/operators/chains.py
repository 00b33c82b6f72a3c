"""Location chains: every point names its next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def walk(chain: DataFrame, pairs: DataFrame, most: int = 400) -> DataFrame:
    """(start, goal, path) of pairs whose goal is reached along ``chain`` (loc, next) in ``most`` steps.

    By doubling: a table holds the next 2^k places of each place and is joined with itself for the next
    power, and each round gives all walks that many places more, so 400 steps take nine rounds. A walk
    leaves where its goal is among its places or the chain ends; one in a circle has met all it will ever
    meet within ``most`` steps. Both tables are written a round.
    """
    pairs = pairs.select("start", "goal")
    ahead = chain.where("next is not null and loc is not null").select("loc", F.array("next").alias("ahead"))
    done = pairs.where("start = goal").select("start", "goal", F.array("start").alias("path"))
    live = pairs.where("start <> goal").select("start", "goal", F.array("start").alias("path"))
    size = 1
    while True:
        moved = live.withColumn("loc", F.element_at("path", -1)).join(ahead, "loc")
        moved = moved.select("start", "goal", F.concat("path", "ahead").alias("path"), (F.size("ahead") == size).alias("_whole"))
        moved = materialize(moved.withColumn("_at", F.array_position("path", F.col("goal"))))
        done = done.unionByName(moved.where(f"_at > 0 and _at <= {most + 1}").select("start", "goal", F.slice("path", F.lit(1), F.col("_at").cast("int")).alias("path")))
        live = moved.where(f"_at = 0 and _whole and size(path) <= {most}").select("start", "goal", "path")
        if live.isEmpty():
            return done
        further = ahead.select(F.col("loc").alias("_end"), F.col("ahead").alias("_more"))
        longer = ahead.withColumn("_end", F.when(F.size("ahead") == size, F.element_at("ahead", -1))).join(further, "_end", "left")
        ahead = materialize(longer.select("loc", F.when(F.col("_more").isNotNull(), F.concat("ahead", "_more")).otherwise(F.col("ahead")).alias("ahead")))
        size *= 2


def walk_both(tmc: DataFrame, pairs: DataFrame, most: int = 400) -> DataFrame:
    """Along ``pos_off`` where it arrives, else along ``neg_off``; adds ``way``."""
    ahead = walk(tmc.select(F.col("loc_nr").alias("loc"), F.col("pos_off").alias("next")), pairs, most).withColumn("way", F.lit("pos"))
    rest = pairs.join(ahead.select("start", "goal"), ["start", "goal"], "left_anti")
    back = walk(tmc.select(F.col("loc_nr").alias("loc"), F.col("neg_off").alias("next")), rest, most).withColumn("way", F.lit("neg"))
    return ahead.unionByName(back)


def line_of(paths: DataFrame, points: DataFrame) -> DataFrame:
    """(start, goal, line) through the points (loc, x, y) of each path; repeats in a row collapse."""
    spots = paths.select("start", "goal", F.posexplode("path").alias("pos", "loc")).join(points, "loc")
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    lines = spots.groupBy("start", "goal").agg(line.alias("line"))
    return lines.withColumn("line", F.filter("line", lambda p, i: (i == 0) | (p != F.get("line", i - 1))))


def road_line_of(paths: DataFrame, points: DataFrame, chain: DataFrame, roads: DataFrame) -> DataFrame:
    """(start, goal, line) along the roads of each path; paths that come to fewer than two points are left out.

    ``points``: loc, x, y; ``chain``: loc, lin_ref (the road of a place); ``roads``: lin_ref, line. Between two
    places of one road the line is that road's from one place's projection to the other's, turned into
    this order; else, or where a place or the road has no geometry, it is straight. Points that repeat
    the one before are left out.
    """
    from ..functions import geo

    steps = paths.where("size(path) > 1").select("start", "goal", "path", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("pos", "a")).withColumn("b", F.get("path", F.col("pos") + 1)).drop("path")
    spot = lambda k: points.select(F.col("loc").alias(k), F.struct("x", "y").alias(f"at_{k}"))
    road = lambda k: chain.select(F.col("loc").alias(k), F.col("lin_ref").alias(f"on_{k}"))
    for k in ("a", "b"):
        steps = steps.join(spot(k), k, "left").join(road(k), k, "left")
    steps = steps.withColumn("lin_ref", F.when(F.col("on_a") == F.col("on_b"), F.col("on_a"))).join(roads.select("lin_ref", F.col("line").alias("_road")), "lin_ref", "left")
    at = lambda k: F.when(F.col(f"at_{k}").isNotNull(), geo.project("_road", F.col(f"at_{k}.x"), F.col(f"at_{k}.y"))["along"])
    steps = materialize(steps.withColumns({"_from": at("a"), "_to": at("b")}))
    straight = F.filter(F.array("at_a", "at_b"), lambda p: p.isNotNull())
    piece = F.coalesce(F.when(F.col("_from").isNotNull() & F.col("_to").isNotNull(), geo.clip("_road", "_from", "_to")), straight)
    lines = steps.select("start", "goal", "pos", piece.alias("piece")).groupBy("start", "goal").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("_p"))
    whole = lines.select("start", "goal", F.flatten(F.transform("_p", lambda p: p["piece"])).alias("line"))
    return whole.withColumn("line", F.filter("line", lambda p, i: (i == 0) | (p != F.get("line", i - 1)))).where("size(line) > 1")


#: How far places may be from their line, how alike two parts may be, and half the tangent's span.
PLACE_M, TIE_M, TANGENT_M = 50.0, 0.5, 20.0


def component(parts, tx, ty, nx, ny) -> Column:
    """The part of a line (array of lines) nearest to two places together, both within 50 m.

    Null where no part is that near, or where the second best is within half a metre of the best.
    """
    from ..functions import geo

    away = lambda part, x, y: geo.project(part, x, y)["dist"]
    whole = F.filter(F.col(parts) if isinstance(parts, str) else parts, lambda p: F.size(p) > 1)
    scored = F.transform(whole, lambda p: F.struct(away(p, tx, ty).alias("t"), away(p, nx, ny).alias("n"), p.alias("line")))
    near = F.transform(F.filter(scored, lambda s: (s["t"] <= PLACE_M) & (s["n"] <= PLACE_M)), lambda s: F.struct((s["t"] + s["n"]).alias("sum"), s["line"].alias("line")))
    best = lambda o: F.when((F.size(o) == 1) | (F.get(o, F.lit(1))["sum"] - F.get(o, F.lit(0))["sum"] > TIE_M), F.get(o, F.lit(0))["line"])
    return F.element_at(F.transform(F.array(F.array_sort(near)), lambda o: F.when(F.size(o) > 0, best(o))), 1)


def direction(sites: DataFrame) -> DataFrame:
    """Travel bearing of sites from a chain: (bearing, derived carriageway) columns added.

    ``sites``: parts (the lines of a place's road) or line, tmc and neighbour places (tx, ty, nx, ny), place
    (x, y), neighbour_is_positive, tmc_direction, hecto_dir and carriageway. The tangent over 20 m around
    the site on the chosen part follows the chain, against it for ``negative``; there is none where the
    two places are within half a metre along it. The carriageway is R where the chain's sign is the
    hectometre direction, whatever the line.
    """
    from ..functions import geo

    parts = F.col("parts") if "parts" in sites.columns else F.array("line")
    rows = materialize(sites.withColumn("_part", component(parts, "tx", "ty", "nx", "ny")))
    at = lambda x, y: geo.project("_part", x, y)["along"]
    rows = materialize(rows.withColumns({"_t": at("tx", "ty"), "_n": at("nx", "ny"), "_s": at("x", "y"), "_len": geo.line_length("_part")}))
    rows = rows.withColumns({"_from": F.greatest(F.lit(0.0), F.col("_s") - TANGENT_M), "_to": F.least(F.col("_len"), F.col("_s") + TANGENT_M)})
    rows = materialize(rows.withColumns({"_a": geo.point_at("_part", "_from"), "_b": geo.point_at("_part", "_to")}))
    dx, dy = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    ahead = (F.col("_n") > F.col("_t")) == F.col("neighbour_is_positive")
    ok = F.col("_part").isNotNull() & F.col("tmc_direction").isin("positive", "negative") & (F.abs(F.col("_n") - F.col("_t")) >= 0.5) & (F.col("_to") - F.col("_from") >= 0.5) & (F.hypot(dx, dy) >= 0.01)
    turned = (~ahead).cast("int") + (F.col("tmc_direction") == "negative").cast("int")
    bearing = F.when(ok, F.round(F.pmod(geo.azimuth(dx, dy) + turned * 180.0, F.lit(360.0)), 1))
    sign = F.when(F.col("tmc_direction") == "negative", -1).when(F.col("tmc_direction") == "positive", 1)
    derived = F.when(F.col("hecto_dir").isin(-1, 1) & sign.isNotNull(), F.when(sign == F.col("hecto_dir"), F.lit("R")).otherwise(F.lit("L")))
    conflict = F.when(F.col("carriageway").isin("R", "L"), F.col("carriageway") != F.col("derived_carriageway"))
    return rows.withColumns({"chain_bearing": bearing, "derived_carriageway": derived}).withColumn("carriageway_conflict", conflict).select(*sites.columns, "chain_bearing", "derived_carriageway", "carriageway_conflict")
