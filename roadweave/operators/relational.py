"""Relational operators of the traffic store: filters, joins, latest-row windows, rollups.

All are DataFrame in, DataFrame out, and lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in this order; Spark cuts groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def beyond(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """What :func:`latest` leaves out (what a history cap deletes)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") > n).drop("_rank")


def pivot_max(rows: DataFrame, keys: Sequence[str], kind: str, value: str, kinds: dict[str, str]) -> DataFrame:
    """One row a key; a column for each kind with the greatest value of that kind."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col(kind) == k, F.col(value))).alias(name) for k, name in kinds.items()])


def merge_lanes(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One reading a lane from the sensors (speed, flow, n_inputs, std_dev, ts, seq) that report it.

    Of the readings with a speed that is not 0 and a time, those of the latest time are averaged.
    Without any, the latest timed reading stands as it is, else the first by ``seq``.
    """
    usable = F.col("speed").isNotNull() & (F.col("speed") != 0) & F.col("ts").isNotNull()
    last = F.max(F.when(usable, F.col("ts"))).over(Window.partitionBy(*keys))
    rows = readings.withColumn("_last", last).withColumn("_same", usable & (F.col("ts") == F.col("_last")))
    same = lambda c: F.when(F.col("_same"), F.col(c))
    whole = F.struct("speed", "flow", "n_inputs", "std_dev", "ts")
    merged = rows.groupBy(*keys).agg(
        F.struct(F.round(F.avg(same("speed")), 1).alias("speed"), F.round(F.avg(same("flow")), 0).alias("flow"), F.sum(same("n_inputs")).alias("n_inputs"), F.round(F.avg(same("std_dev")), 2).alias("std_dev"), F.max("_last").alias("ts")).alias("mean"),
        F.max_by(whole, F.when(F.col("ts").isNotNull(), F.struct(F.col("ts"), -F.col("seq")))).alias("timed"),
        F.min_by(whole, "seq").alias("first"),
    )
    plain = F.coalesce("timed", "first")
    pick = lambda c: F.when(F.col("mean.ts").isNotNull(), F.col(f"mean.{c}")).otherwise(plain[c]).alias(c)
    return merged.select(*keys, *[pick(c) for c in ("speed", "flow", "n_inputs", "std_dev", "ts")])


def inherited(rows: DataFrame, place: Sequence[str], given: Sequence[str]) -> DataFrame:
    """Fill ``given`` where its first column is null if all others at the place agree on one tuple.

    Adds ``inherited`` (whether the row was filled). Two or more values leave it null.
    """
    w = Window.partitionBy(*place)
    known = F.when(F.col(given[0]).isNotNull(), F.struct(*given))
    rows = rows.withColumns({"_least": F.min(known).over(w), "_most": F.max(known).over(w)})
    fill = F.col(given[0]).isNull() & F.col("_least").isNotNull() & F.col("_least").eqNullSafe(F.col("_most"))
    return rows.withColumn("inherited", fill).withColumns({c: F.when(fill, F.col(f"_least.{c}")).otherwise(F.col(c)) for c in given}).drop("_least", "_most")


def effective_road(sites: DataFrame, place: Sequence[str] = ("x", "y", "side", "direction")) -> DataFrame:
    """road, carriageway and road_source: explicit, else from the chain's number, else inherited."""
    source = F.when(F.col("road").isNotNull(), F.lit("explicit")).when(F.col("chain_road").isNotNull(), F.lit("chain_number"))
    rows = sites.withColumn("road_source", source).withColumns({"road": F.coalesce("road", "chain_road"), "carriageway": F.coalesce("carriageway", "chain_carriageway")})
    rows = inherited(rows, list(place), ["road", "carriageway"])
    return rows.withColumn("road_source", F.when(F.col("inherited"), F.lit("inherited")).otherwise(F.col("road_source")))


def location_buckets(sites: DataFrame) -> DataFrame:
    """One row for each place, road, carriageway (else direction) and side.

    ``sites``: site_id, lon, lat, road, carriageway, direction, side, num_lanes, km, bearing, roadway.
    The representative id prefers the aggregate system's; roadway only where all agree.
    """
    keys = [F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), F.col("road"), F.coalesce("carriageway", "direction").alias("way"), F.col("side")]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("site_id")))
    return sites.groupBy(*keys).agg(
        F.min_by("site_id", F.struct(~F.col("site_id").contains("_MONIBAS_"), F.col("site_id"))).alias("site_id"),
        F.array_sort(F.collect_set(F.get(F.split("site_id", "_"), F.lit(1)))).alias("systems"),
        F.countDistinct("site_id").alias("source_count"),
        F.nullif(F.max(F.coalesce("num_lanes", F.lit(0))), F.lit(0)).alias("num_lanes"),
        first("km").alias("km"),
        first("bearing").alias("bearing"),
        F.when(F.min("roadway") == F.max("roadway"), F.min("roadway")).alias("roadway"),
    )


def km_window(rows: DataFrame, low: float, high: float, keep_unknown: bool) -> DataFrame:
    """Kilometres within the window; with a viewport, rows without kilometre stay."""
    inside = F.col("km").between(low, high)
    return rows.where(inside | F.col("km").isNull() if keep_unknown else inside)


def bounded_candidates(rows: DataFrame, usable: Column, key: str, order: Sequence[Column], limit: int, factor: int = 6) -> tuple[DataFrame, DataFrame]:
    """(rows of the first limit * factor keys with usable rows, those keys): bounds work before joins."""
    ids = rows.where(usable).groupBy(key).agg(F.min(F.struct(*order)).alias("_order")).orderBy("_order", key).limit(limit * factor).select(key)
    return rows.where(usable).join(ids, key, "left_semi"), ids


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join where null equals null; columns of ``right`` beside the keys follow."""
    r = right.select([F.col(k).alias(f"_r_{k}") for k in keys] + [c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        on = c if on is None else on & c
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def first_groups(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """All rows of the first ``limit`` distinct keys; the limit counts groups, not rows."""
    groups = rows.select(*keys).distinct().orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(limit)
    return null_safe_join(rows, groups, keys, "left_semi")


def page(rows: DataFrame, order: Sequence[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows in a fixed order with ``truncated``: whether more were there."""
    probe = rows.orderBy(*order).limit(cap + 1)
    rank = F.row_number().over(Window.orderBy(*order))
    more = F.count(F.lit(1)).over(Window.partitionBy())
    return probe.withColumns({"_rank": rank, "truncated": more > cap}).where(F.col("_rank") <= cap).drop("_rank")


def rollup_or_unknown(parents: DataFrame, children: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Sums over children; unknown (null) without any, a null value counts as 0."""
    totals = children.groupBy(key).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(name) for name, c in sums.items()])
    return parents.join(totals, key, "left")


def latest_of_feed(runs: DataFrame, feed: str, run: str) -> DataFrame:
    """The row with the greatest run of each feed, and how many there were."""
    last = runs.groupBy(feed).agg(F.max_by(F.struct(*runs.columns), run).alias("_r"), F.count(F.lit(1)).alias("runs"))
    return last.select("_r.*", "runs")


def tiered(roads: DataFrame, zoom: int) -> DataFrame:
    """Highway classes by zoom: none below 7, motorways below 9, main roads below 11, else all."""
    if zoom < 7:
        return roads.where(F.lit(False))
    classes = ["motorway", "motorway_link"] + (["trunk", "trunk_link", "primary", "primary_link"] if zoom >= 9 else [])
    return roads if zoom >= 11 else roads.where(F.col("highway").isin(*classes))


def first_and_latest(locations: DataFrame, states: DataFrame) -> DataFrame:
    """First location and latest state of each uuid (pos: place in the feed); either may be missing.

    Times compare as text; of equal ones the earlier in the feed wins.
    """
    first = locations.groupBy("uuid").agg(F.min_by(F.struct(*[c for c in locations.columns if c not in ("uuid", "pos")]), "pos").alias("location"))
    last = states.groupBy("uuid").agg(F.max_by(F.struct(*[c for c in states.columns if c not in ("uuid", "pos")]), F.struct(F.col("ts"), -F.col("pos"))).alias("state"))
    return first.join(last, "uuid", "full_outer").select("uuid", "location.*", "state.*")


def match_report(assignments: DataFrame, by: str, distance: str) -> DataFrame:
    """Counts and p05, p50, p95 of the distance for each value of ``by``."""
    p = F.percentile(distance, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return assignments.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.round(p[i], 3).alias(name) for i, name in enumerate(("p05", "p50", "p95"))])


def counters(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(counter, value, n) of each value of each column, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).groupBy("p.counter", "p.value").agg(F.count(F.lit(1)).alias("n"))


def fastest_per_place(rows: DataFrame) -> DataFrame:
    """One row a (road, km), or a site where km is null: the fastest."""
    place = F.when(F.col("km").isNull(), F.concat(F.lit("site:"), F.col("site_id").cast("string"))).otherwise(F.concat_ws("@", "road", F.col("km").cast("string")))
    return rows.groupBy(place.alias("place")).agg(F.max_by("site_id", F.struct(F.coalesce("speed", F.lit(-1.0)), -F.col("site_id"))).alias("site_id"), F.max("speed").alias("speed"))


def top_per_angle(rows: DataFrame, keys: Sequence[str], angle: str, order: Sequence[Column], bucket: float, apart: float) -> DataFrame:
    """Best row of each key and angle bucket, dropped where the second best is within ``apart`` degrees."""
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = rows.withColumn("_bucket", F.floor(F.col(angle) / bucket)).withColumns({"_rank": F.row_number().over(w), "_next": F.lead(angle).over(w)})
    return rows.where((F.col("_rank") == 1) & (F.col("_next").isNull() | (F.abs(F.col("_next") - F.col(angle)) >= apart))).drop("_bucket", "_rank", "_next")
