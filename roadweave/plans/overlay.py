"""A road network over the driver's tables: the same integer arithmetic in Spark and in SQL.

Customers stand for measurement sites, parts for lane segments. Roads, carriageways, directions
and lanes follow from the keys. Places are metres in one plane around 4.70 E, 52.50 N.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..session import table

ORIGIN = (4.70, 52.50)
EAST = geo.M_LON * math.cos(math.radians(ORIGIN[1]))


def _place(key: Column, a: int, m: int, base: float) -> Column:
    return F.lit(base) + F.pmod(key * a, F.lit(m)) / F.lit(float(m)) * F.lit(0.03)


def plane(lon: Column, lat: Column) -> tuple[Column, Column]:
    return (lon - ORIGIN[0]) * EAST, (lat - ORIGIN[1]) * geo.M_LAT


def road_name(key: Column) -> Column:
    return F.concat(F.when(key % 2 == 0, F.lit("A")).otherwise(F.lit("N")), (key % 20).cast("string"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("site_id"), _place(k, 7919, 10007, 4.70).alias("lon"), _place(k, 104729, 10009, 52.50).alias("lat"), F.when(k % 9 != 0, (k * 37) % 360).cast("double").alias("bearing"),
        F.when(k % 5 != 0, road_name(k)).alias("road_ref"), F.when(k % 7 != 0, F.when(k % 2 == 0, F.lit("R")).otherwise(F.lit("L"))).alias("carriageway"), (k % 4 + 1).cast("int").alias("num_lanes"),
        F.when(k % 11 != 0, F.col("c_acctbal") / 100).alias("km"),
    )
    x, y = plane(F.col("lon"), F.col("lat"))
    return rows.withColumns({"x": x, "y": y})


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("source_id"), _place(k, 7907, 10007, 4.70).alias("alon"), _place(k, 104723, 10009, 52.50).alias("alat"), (((k * 31) % 21) - 10).alias("dx"), (((k * 17) % 13) - 6).alias("dy"),
        F.when(k % 3 != 0, road_name(k)).alias("ref"), F.when(k % 2 == 0, F.lit("fwd")).otherwise(F.lit("bwd")).alias("direction"), (F.col("p_size") % 4 + 1).cast("int").alias("lane_count"),
    )
    rows = rows.where("dx <> 0 or dy <> 0").withColumns({"blon": F.col("alon") + F.col("dx") * F.lit(0.0001), "blat": F.col("alat") + F.col("dy") * F.lit(0.0001)})
    (ax, ay), (bx, by) = plane(F.col("alon"), F.col("alat")), plane(F.col("blon"), F.col("blat"))
    return rows.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by}).drop("dx", "dy")


#: The same rows for DuckDB, as the head of a WITH clause.
SQL = f"""
site AS (
  SELECT *, (lon - 4.70::DOUBLE) * {EAST!r}::DOUBLE AS x, (lat - 52.50::DOUBLE) * 110540.0::DOUBLE AS y FROM (
    SELECT c_custkey AS site_id, 4.70::DOUBLE + ((c_custkey * 7919) % 10007) / 10007.0::DOUBLE * 0.03::DOUBLE AS lon,
      52.50::DOUBLE + ((c_custkey * 104729) % 10009) / 10009.0::DOUBLE * 0.03::DOUBLE AS lat,
      CASE WHEN c_custkey % 9 <> 0 THEN ((c_custkey * 37) % 360)::DOUBLE END AS bearing,
      CASE WHEN c_custkey % 5 <> 0 THEN (CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'N' END) || (c_custkey % 20)::VARCHAR END AS road_ref,
      CASE WHEN c_custkey % 7 <> 0 THEN (CASE WHEN c_custkey % 2 = 0 THEN 'R' ELSE 'L' END) END AS carriageway,
      (c_custkey % 4 + 1)::INTEGER AS num_lanes, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal / 100 END AS km
    FROM customer)),
lane AS (
  SELECT source_id, ref, direction, lane_count, alon, alat, blon, blat,
    (alon - 4.70::DOUBLE) * {EAST!r}::DOUBLE AS ax, (alat - 52.50::DOUBLE) * 110540.0::DOUBLE AS ay,
    (blon - 4.70::DOUBLE) * {EAST!r}::DOUBLE AS bx, (blat - 52.50::DOUBLE) * 110540.0::DOUBLE AS by_ FROM (
    SELECT *, alon + dx * 0.0001::DOUBLE AS blon, alat + dy * 0.0001::DOUBLE AS blat FROM (
      SELECT p_partkey AS source_id, 4.70::DOUBLE + ((p_partkey * 7907) % 10007) / 10007.0::DOUBLE * 0.03::DOUBLE AS alon,
        52.50::DOUBLE + ((p_partkey * 104723) % 10009) / 10009.0::DOUBLE * 0.03::DOUBLE AS alat,
        ((p_partkey * 31) % 21) - 10 AS dx, ((p_partkey * 17) % 13) - 6 AS dy,
        CASE WHEN p_partkey % 3 <> 0 THEN (CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'N' END) || (p_partkey % 20)::VARCHAR END AS ref,
        CASE WHEN p_partkey % 2 = 0 THEN 'fwd' ELSE 'bwd' END AS direction, (p_size % 4 + 1)::INTEGER AS lane_count
      FROM part) WHERE dx <> 0 OR dy <> 0))
"""

#: All (site, lane) pairs within {radius} metres, by brute force.
PAIRS = """
near0 AS (SELECT s.*, l.*, CASE WHEN (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) > 0
    THEN greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) ELSE 0.0 END AS t
  FROM site s, lane l WHERE x BETWEEN least(ax, bx) - {radius} AND greatest(ax, bx) + {radius} AND y BETWEEN least(ay, by_) - {radius} AND greatest(ay, by_) + {radius}),
near AS (SELECT *, sqrt((ax + t * (bx - ax) - x) * (ax + t * (bx - ax) - x) + (ay + t * (by_ - ay) - y) * (ay + t * (by_ - ay) - y)) AS dist,
    ((degrees(atan2(bx - ax, by_ - ay)) % 360) + 360) % 360 AS line_bearing FROM near0
  WHERE sqrt((ax + t * (bx - ax) - x) * (ax + t * (bx - ax) - x) + (ay + t * (by_ - ay) - y) * (ay + t * (by_ - ay) - y)) <= {radius})
"""


def near_sql(radius: float) -> str:
    return SQL + "," + PAIRS.format(radius=radius)
