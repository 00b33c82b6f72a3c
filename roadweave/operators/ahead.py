"""What lies ahead of a device on its road: sensors, gantries, bands, gradients."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def _here(device: dict) -> tuple[Column, Column]:
    return geo.offset(F.lit(device["lon"]), F.lit(device["lat"]), F.col("lon"), F.col("lat"))


def ahead_geometric(sensors: DataFrame, device: dict, most_angle: float = 55.0) -> DataFrame:
    """Sensors of the device's road and carriageway in front of it, with ``along`` in metres."""
    dx, dy = _here(device)
    rows = sensors.where((F.col("road") == device["road"]) & (F.col("carriageway") == device["carriageway"]))
    aligned = geo.angle_between("bearing", F.lit(device["heading"])) <= most_angle
    return rows.withColumn("along", geo.along(dx, dy, F.lit(device["heading"]))).where((F.col("along") > 0) & aligned)


def upcoming(sensors: DataFrame, device: dict, context: dict, span: float = 10_000.0) -> DataFrame:
    """Sensors ahead by kilometre where both know theirs, else by geometry.

    ``context``: road, carriageway, km of the anchor, and roadway if known. On R kilometres rise
    ahead, on L they fall. A kilometre distance shorter than the straight way, or over four times
    it beyond 2 km, is not believed. Adds along and placement (km or geometry).
    """
    dx, dy = _here(device)
    direct = F.hypot(dx, dy)
    sign = 1.0 if context["carriageway"] == "R" else -1.0
    by_km = (F.col("km") - F.lit(context.get("km"))) * 1000 * sign
    believed = (direct <= by_km + 100) & ((by_km <= 4 * direct) | (by_km <= 2000))
    geometric = geo.along(dx, dy, F.lit(device.get("heading")))
    rows = sensors.where((F.col("road") == context["road"]) & (F.col("carriageway").isNull() | (F.col("carriageway") == context["carriageway"])))
    if context.get("roadway") and "roadway" in sensors.columns:
        rows = rows.where(F.col("roadway").isNull() | (F.col("roadway") == context["roadway"]))
    use_km = F.coalesce(by_km.isNotNull() & believed, F.lit(False))
    rows = rows.withColumns({"along": F.when(use_km, by_km).otherwise(geometric), "placement": F.when(use_km, F.lit("km")).otherwise(F.lit("geometry"))})
    return rows.where((F.col("along") > 0) & (F.col("along") <= span))


def one_per_band(rows: DataFrame, keys: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """One entry a distance band: one already shown if there is any, else the nearest."""
    band = F.lit(0)
    for e in edges:
        band = band + (F.col("along") >= e).cast("int")
    rank = F.row_number().over(Window.partitionBy(*keys, "band").orderBy(F.col("held").desc(), "along", "id"))
    return rows.withColumn("band", band).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def corridor(rows: DataFrame, device: dict, width: float = 60.0, span: float = 3000.0) -> DataFrame:
    """ahead, passed or outside for places around a heading."""
    dx, dy = _here(device)
    h = F.radians(F.lit(device["heading"]))
    along, across = geo.along(dx, dy, F.lit(device["heading"])), dx * F.cos(h) - dy * F.sin(h)
    state = F.when((F.abs(across) > width) | (F.abs(along) > span), F.lit("outside")).when(along >= 0, F.lit("ahead")).otherwise(F.lit("passed"))
    return rows.withColumns({"along": along, "across": across, "state": state})


def next_signs(signs: DataFrame, device: dict) -> DataFrame:
    """The nearest sign ahead of each kind (gantry, panel); without a heading there is none."""
    if device.get("heading") is None:
        return signs.limit(0)
    rows = corridor(signs, device).where("state = 'ahead'")
    return rows.groupBy("kind").agg(F.min(F.struct(F.col("along"), F.col("id"))).alias("n")).select("kind", "n.id", "n.along")


def current_lane(lanes: DataFrame, previous: str | None, hysteresis: float = 5.0, most: float = 30.0) -> DataFrame:
    """The lane under the device (lane_id, dist): the previous one unless another is 5 m nearer."""
    bonus = F.when(F.col("lane_id") == F.lit(previous), F.lit(hysteresis)).otherwise(F.lit(0.0))
    return lanes.where(F.col("dist") <= most).orderBy(F.col("dist") - bonus, "lane_id").limit(1)


def section_progress(lines: DataFrame, px, py) -> DataFrame:
    """Progress (0 to 1) and metres left of a position along section lines it is within 60 m of."""
    at = geo.project("line", px, py)
    return lines.withColumn("_at", at).where("_at.dist <= 60").withColumns({"progress": F.col("_at.along") / F.col("_at.total"), "left": F.col("_at.total") - F.col("_at.along")}).drop("_at")


def gradient(sensors: DataFrame, pieces: int = 8, least: float = 1.0, shortest: float = 0.5) -> DataFrame:
    """(line, piece, start, stop, speed) along lines with ``sensors`` (line, seq, along, speed, total: the line's length).

    From the start, a reading under ``least`` metres beyond a node's first joins it, with the mean of both
    speeds; any other begins a node. Between two nodes the speed goes linearly over ``pieces`` pieces;
    before the first and behind the last it stays. Pieces under ``shortest`` metres are left out, and
    lines of fewer than two nodes have none: they keep their own speed.
    """
    rows = sensors.where("speed is not null and along is not null").groupBy("line").agg(F.array_sort(F.collect_list(F.struct(F.col("along").cast("double").alias("along"), "seq", F.col("speed").cast("double").alias("speed")))).alias("_s"), F.max("total").cast("double").alias("_total"))
    node = lambda along, speed: F.struct(along.alias("along"), speed.alias("speed"))

    def met(nodes: Column, s: Column) -> Column:
        top = F.element_at(nodes, -1)
        joined = F.concat(F.slice(nodes, F.lit(1), F.size(nodes) - 1), F.array(node(top["along"], (top["speed"] + s["speed"]) / 2)))
        return F.when(s["along"] - top["along"] < least, joined).otherwise(F.concat(nodes, F.array(node(s["along"], s["speed"]))))

    first = F.array(node(F.get("_s", F.lit(0))["along"], F.get("_s", F.lit(0))["speed"]))
    rows = rows.withColumn("_n", F.reduce(F.slice("_s", F.lit(2), F.size("_s")), first, met)).where("size(_n) > 1")
    ends = lambda a, b, speed: F.struct(a.alias("start"), b.alias("stop"), speed.alias("speed"))

    def cut(i: Column) -> Column:
        a, b = F.get("_n", i), F.get("_n", i + 1)
        at = lambda c, k: a[c] + (b[c] - a[c]) * k / float(pieces)
        return F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: ends(at("along", k), at("along", k + 1), at("speed", k + 0.5)))

    head, tail = F.get("_n", F.lit(0)), F.element_at("_n", -1)
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_n") - 2), cut))
    whole = F.concat(F.array(ends(F.lit(0.0), head["along"], head["speed"])), spans, F.array(ends(tail["along"], F.col("_total"), tail["speed"])))
    cuts = rows.select("line", F.posexplode(whole).alias("piece", "_c"))
    return cuts.select("line", "piece", "_c.start", "_c.stop", F.round("_c.speed", 1).alias("speed")).where(F.col("stop") - F.col("start") >= shortest)


def main_and_extra(sites: DataFrame) -> DataFrame:
    """Split readings (lanes: array of struct with lane) into the road's own lanes and those beyond."""
    n = F.col("lane_count")
    return sites.withColumns({"main": F.filter("lanes", lambda x: n.isNull() | (x["lane"] <= n)), "extra": F.filter("lanes", lambda x: n.isNotNull() & (x["lane"] > n))})


def anchor_km(km, carriageway: str, driven) -> Column:
    """Kilometre of the device after ``driven`` metres from its anchor."""
    return geo._c(km) + (1 if carriageway == "R" else -1) * geo._c(driven) / 1000.0


def road_context(sites: DataFrame, device: dict, k: int = 25, reach: float = 1500.0, most_angle: float = 55.0) -> DataFrame:
    """Road, carriageway and anchor kilometre at a position from the ``k`` nearest tagged sites.

    With a heading the nearest site within reach and angle decides, and without any there is no
    answer; without a heading the nearest within reach does. The kilometre comes from the nearest
    site of that carriageway that has one, less what lies between.
    """
    from .spatial import nearest_to

    dx, dy = _here(device)
    heading = device.get("heading")
    near = nearest_to(sites.where("road is not null"), device["lon"], device["lat"], k, "site_id").withColumns({"_dist": F.hypot(dx, dy), "_along": geo.along(dx, dy, F.lit(heading).cast("double"))}).where(F.col("_dist") <= reach)
    fits = near if heading is None else near.where(geo.angle_between("bearing", F.lit(heading)) <= most_angle)
    first = fits.orderBy("_dist", "site_id").limit(1).select(F.col("road").alias("r"), F.col("carriageway").alias("c"))
    known = near.join(F.broadcast(first), (F.col("road") == F.col("r")) & F.col("carriageway").eqNullSafe(F.col("c"))).where("km is not null")
    sign = F.when(F.col("c") == "R", 1.0).when(F.col("c") == "L", -1.0).otherwise(0.0)
    km = known.orderBy("_dist", "site_id").limit(1).select((F.col("km") - sign * F.col("_along") / 1000).alias("km"))
    return first.select(F.col("r").alias("road"), F.col("c").alias("carriageway"), F.lit(1).alias("_one")).join(km.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def context_states(fixes: DataFrame) -> DataFrame:
    """When a device's context is fetched or dropped, over ordered fixes (device, ts, x, y, heading, road).

    A fetch is due on a new road, 150 m, 20 degrees or 30 s from the last fetch, or with the first
    heading after a fetch without one. Another road, 120 degrees or over 120 s make the context void
    at once (discard, which also fetches). What the last fetch was depends on all before it, so
    each device's fixes are walked in order; a task holds one fetch, not a device's fixes.
    """
    also = [c for c in ("event_id",) if c in fixes.columns]
    rows = fixes.withColumn("_at", F.unix_timestamp("ts")).repartition("device").sortWithinPartitions("device", "ts", *also)
    read = ["device", "_at", "x", "y", "heading", "road"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for device, at, x, y, heading, road in zip(*(b.column(c).to_pylist() for c in read), strict=True):
                fresh = last is None or last[0] != device
                turned = None if fresh or heading is None or last[4] is None else abs((heading - last[4] + 180) % 360 - 180)
                void = not fresh and (last[5] != road or (turned is not None and turned >= 120) or at - last[1] > 120)
                due = fresh or void or math.hypot(x - last[2], y - last[3]) >= 150 or at - last[1] >= 30
                due = due or (heading is not None and (last[4] is None or turned >= 20))
                if due:
                    last = (device, at, x, y, heading, road)
                out.append("discard" if void else "fetch" if due else "keep")
            yield b.append_column("action", pa.array(out, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, action string").drop("_at")


def held_selection(choices: DataFrame, hold: int = 4) -> DataFrame:
    """Choices (channel, ts, id or null) where a gap of up to ``hold`` seconds keeps the last id."""
    w = Window.partitionBy("channel").orderBy("ts", *(c for c in ("event_id",) if c in choices.columns)).rowsBetween(Window.unboundedPreceding, 0)
    last, seen = F.last("id", ignorenulls=True).over(w), F.last(F.when(F.col("id").isNotNull(), F.unix_timestamp("ts")), ignorenulls=True).over(w)
    return choices.withColumn("shown", F.when(F.unix_timestamp("ts") - seen <= hold, last))
