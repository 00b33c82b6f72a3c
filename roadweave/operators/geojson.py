"""GeoJSON as JSON text built in the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import _c


def point(lon, lat, digits: int = 6) -> Column:
    at = F.array(F.round(_c(lon), digits), F.round(_c(lat), digits))
    return F.when(number(lon).isNotNull() & number(lat).isNotNull(), F.struct(F.lit("Point").alias("type"), at.alias("coordinates")))


def line(points, digits: int = 6) -> Column:
    at = F.transform(_c(points), lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits)))
    return F.when(_c(points).isNotNull(), F.struct(F.lit("LineString").alias("type"), at.alias("coordinates")))


def number(value) -> Column:
    """A double as JSON knows numbers: NaN and infinities become null."""
    v = _c(value)
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def feature(geometry: Column, properties: dict[str, Column]) -> Column:
    """One feature; null properties are left out. Doubles that may be NaN have to go through :func:`number`."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties")))


def tag_properties(tags, typed: dict[str, Column]) -> Column:
    """Map of all tags without nulls; typed columns win over tags of their name."""
    own = F.map_filter(F.create_map(*[x for k, v in typed.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    rest = F.map_filter(_c(tags), lambda k, v: v.isNotNull() & ~k.isin(*typed))
    return F.map_concat(rest, own)


def collection(features: DataFrame, column: str = "feature", order: str | None = None) -> str:
    """A FeatureCollection of a result page (bounded by the page's limit), as compact text."""
    rows = features.orderBy(order) if order else features
    return '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in rows.select(column).toLocalIterator()) + "]}"


def write_lines(features: DataFrame, path: str, column: str = "feature") -> None:
    """Any number of features as newline-delimited GeoJSON."""
    features.select(F.col(column).alias("value")).write.text(path)


def best_geometry(mode: str, source: str, matched: str) -> Column:
    """source, matched, or matched where there is one."""
    return {"source": F.col(source), "matched": F.col(matched), "best": F.coalesce(matched, source)}[mode]
