"""The gantry matcher as a job: its assignments are stored, reported, and kept up to date.

A gantry's match follows from its signs and the lanes within the radius of one of them. So where lanes or
signs change, the changed lanes are joined with the signs near them (the search the other way round), the
gantries found and those whose signs changed are matched again as a whole, and their assignments and links
replace the stored ones; all others stay.

    signs: gantry, sign, x, y, road, carriageway, lane, bearing
    lanes: source_id, ax, ay, bx, by, segment, direction, lane_id, lane_nr, lane_count, road_id, ref,
           lane_carriageway, highway
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, small
from .buckets import Change, Store
from .matching import GANTRY_RADIUS_M, gantry_report, lanes_near, match_gantries
from .spatial import distance_join

KIND = "matrix_sign"
LINK = ["segment", "direction", "lane_id", "applies_to", "dist", "angle", "ref_quality"]


@dataclass(frozen=True)
class Roads:
    """Signs and lanes at one time."""

    signs: DataFrame
    lanes: DataFrame


def matched(now: Roads, version: str, radius: float = GANTRY_RADIUS_M) -> tuple[DataFrame, DataFrame]:
    """(assignments, links): a row a sign with status and reason, and a link for each matched one."""
    signs = now.signs
    near = lanes_near(signs.select("sign", "x", "y"), now.lanes, "sign", radius).drop("x", "y", "rank")
    pairs = near.join(signs.select("sign", "gantry"), "sign")
    found = materialize(match_gantries(signs.select("gantry", "sign", "road", "carriageway", "lane", "bearing"), pairs))
    key = [F.lit(KIND).alias("source_kind"), F.col("sign").cast("string").alias("source_key"), "gantry"]
    assignments = found.select(*key, F.lit(version).alias("version"), "status", "reason", "confidence", "candidates", "dist")
    return assignments, found.where("status = 'matched'").select(*key, F.lit(0).alias("link_index"), *LINK)


def _changed(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Rows of either table that the other one doesn't hold as they are."""
    columns = before.columns
    marked = lambda df, side: df.select(*columns, F.xxhash64(F.to_json(F.struct(*columns))).alias("_mark"), F.lit(side).alias("_side"))
    both = marked(before, 1).unionByName(marked(now, 2))
    odd = both.groupBy(key, "_mark").agg(F.bit_or("_side").alias("_sides")).where("_sides <> 3")
    return both.join(odd.select(key, "_mark"), [key, "_mark"], "left_semi").select(*columns)


def touched(before: Roads, now: Roads, radius: float = GANTRY_RADIUS_M) -> DataFrame:
    """Gantries (gantry) whose match may have changed."""
    lanes = materialize(_changed(before.lanes, now.lanes, "source_id"))
    signs = before.signs.select("gantry", "x", "y").unionByName(now.signs.select("gantry", "x", "y")).distinct()
    near = distance_join(signs, lanes.select("source_id", "ax", "ay", "bx", "by"), radius).select("gantry")
    return materialize(near.unionByName(_changed(before.signs, now.signs, "sign").select("gantry")).distinct())


def run(store: Store, now: Roads, version: str, before: Roads | None = None, radius: float = GANTRY_RADIUS_M) -> int:
    """Match and publish assignments, links and the report as one version of the ``store``; its number.

    Without ``before``, or where the stored assignments are another algorithm ``version``'s, all signs are matched;
    else those of the gantries :func:`touched` since ``before``.
    """
    again = before is not None and store.manifest()["mark"] == version
    part = touched(before, now, radius) if again else None
    # gantries are dealt by key, whichever table they come from
    some = now if part is None else Roads(now.signs.join(small(part), "gantry", "left_semi").select(*now.signs.columns), now.lanes)
    assignments, links = map(materialize, matched(some, version, radius))
    replace = lambda old, new: new if part is None or old is None else old.join(small(part), "gantry", "left_anti").select(*new.columns).unionByName(new)
    at = dict(by=["gantry"], whole=part is None, touched=part)
    changes = [Change("assignments", assignments, change=replace, **at), Change("links", links, change=replace, **at)]
    stored = store.read("assignments") if again else None
    report = gantry_report(replace(stored, assignments))
    return store.commit([*changes, Change("report", report, ["status"], lambda old, new: new, whole=True)], mark=version)
