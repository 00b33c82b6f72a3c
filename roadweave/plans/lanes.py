"""Lane claims over all lineitems, and the SQL twin, written as rows instead of arrays.

An order is a road with lanes and markings from its key, each of its different lines a movement into another road.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lane_network as net
from ..operators.lanes import TURNS

MARKS = ["none", "through", "slight_left", "slight_right", "right", "merge_to_left", "merge_to_right", "left"]
CHANGES = ["yes", "no", "not_left", "not_right", "only_left", "only_right"]
KINDS = ["exit", "tagged", "entry", "continuation", "continuation", "roundabout"]


def lane_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    rows = rows.withColumn("movement", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    at = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    key, part, supplier, number = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    none = F.array().cast("array<string>")

    def lane(i):
        ref = F.when((key + i) % 4 == 0, F.array(F.lit("a1"))).otherwise(none)
        return F.struct(i.cast("int").alias("lane"), i.cast("string").alias("lane_id"), F.array(at(MARKS, (key * 7 + i * 3) % 8)).alias("marks"), none.alias("dest"), ref.alias("dest_ref"), F.array(at(CHANGES, (key + i) % 6)).alias("change"))

    first = F.when(supplier % 7 == 0, 2).otherwise(1)
    moves = rows.select(
        key.cast("string").alias("s_segment"),
        F.lit("fwd").alias("s_travel"),
        F.col("movement").cast("string").alias("t_segment"),
        F.lit("fwd").alias("t_travel"),
        at(KINDS, (part + number) % 6).alias("kind"),
        ((part * 13) % 240 - 120).cast("double").alias("turn"),
        (supplier % 3 == 0).alias("anchored"),
        F.when(number % 2 == 1, F.lit("a1")).otherwise(F.lit("")).alias("t_ref"),
        F.lit("").alias("t_name"),
        F.transform(F.sequence(F.lit(1), (key % 5 + 1).cast("int")), lane).alias("src"),
        F.transform(F.sequence(first, (first + part % 5).cast("int")), lambda i: F.struct(i.cast("int").alias("lane"), i.cast("string").alias("lane_id"), *[none.alias(c) for c in ("marks", "dest", "dest_ref", "change")])).alias("tgt"),
    )
    edges = net.classified(net.materialize(net.claimed(net.materialize(moves))))
    return edges.select(F.col("s_segment").cast("long").alias("l_orderkey"), F.col("t_segment").cast("int").alias("movement"), "s_lane", "t_lane", "type")


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_FITS = "CASE mark " + " ".join(f"WHEN '{k}' THEN turn BETWEEN {a} AND {b}" for k, (a, b) in TURNS.items()) + " ELSE false END"


def _mapped(use: str, name: str) -> str:
    """CTEs that map the lanes ``use`` (o, k, lane, mark, chg and the movement's columns) to target lanes: ``name`` (o, k, s, t)."""
    return f"""
{name}_a AS (SELECT *, CASE mark WHEN 'merge_to_left' THEN -1 WHEN 'merge_to_right' THEN 1 ELSE 0 END AS step,
    row_number() OVER (PARTITION BY o, k ORDER BY lane) - 1 AS i, count(*) OVER (PARTITION BY o, k) AS n FROM {use}),
{name}_b AS (SELECT *, coalesce(sum((step = 0)::INT) OVER (PARTITION BY o, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - (step = -1)::INT AS place FROM {name}_a),
{name}_c AS (SELECT o, k, n > any_value(m) AND sum((step <> 0)::INT) = n - any_value(m) AND bool_and(place BETWEEN 0 AND m - 1) AS merged,
    CASE WHEN n >= any_value(m) THEN NULL WHEN bool_and(lane = t1 + i) THEN 'right' WHEN bool_and(lane = t1 + m - n + i) THEN 'left'
         WHEN any_value(anch) AND min(lane) = any_value(t1) THEN 'right' WHEN any_value(anch) AND max(lane) = any_value(t1) + any_value(m) - 1 THEN 'left' END AS side,
    arg_max(chg, i) AS chg_last, arg_min(chg, i) AS chg_first FROM {name}_b GROUP BY o, k, n),
{name}_d AS (SELECT b.*, merged, side, CASE side WHEN 'right' THEN chg_last IN ('yes', 'not_left', 'only_right') WHEN 'left' THEN chg_first IN ('yes', 'not_right', 'only_left') END AS free FROM {name}_b b JOIN {name}_c c USING (o, k)),
{name} AS (
  SELECT o, k, lane AS s, CASE WHEN kind = 'entry' THEN t1 + m - least(n, m) + i WHEN n = m THEN t1 + i WHEN merged THEN t1 + place WHEN n > m THEN t1 + i WHEN side = 'left' THEN t1 + m - n + i ELSE t1 + i END AS t
  FROM {name}_d WHERE CASE WHEN kind = 'entry' THEN i < least(n, m) WHEN n = m OR merged THEN true WHEN n > m THEN anch AND i < m ELSE true END
  UNION ALL
  SELECT o, k, lane, unnest(CASE WHEN side = 'right' THEN range(t1 + n, t1 + m) ELSE range(t1, t1 + m - n) END) FROM {name}_d
  WHERE kind <> 'entry' AND n < m AND free AND i = CASE WHEN side = 'right' THEN n - 1 ELSE 0 END)"""


SQL = {
    "lane_claims": f"""
WITH mv AS MATERIALIZED (
  SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS k, [{_in(KINDS)}][1 + (l_partkey + l_linenumber) % 6] AS kind, ((l_partkey * 13) % 240 - 120)::DOUBLE AS turn, l_suppkey % 3 = 0 AS anch,
    l_linenumber % 2 = 1 AS ref, 1 + l_partkey % 5 AS m, CASE WHEN l_suppkey % 7 = 0 THEN 2 ELSE 1 END AS t1, 1 + l_orderkey % 5 AS n0
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
src AS (SELECT *, unnest(range(1, n0 + 1)) AS lane FROM mv),
lanes AS MATERIALIZED (SELECT *, [{_in(MARKS)}][1 + (o * 7 + lane * 3) % 8] AS mark, [{_in(CHANGES)}][1 + (o + lane) % 6] AS chg, (o + lane) % 4 = 0 AS there FROM src),
b1 AS (SELECT *, CASE WHEN NOT ({_FITS}) THEN 0 WHEN (turn > 5 AND mark IN ({_in(net.RIGHT)})) OR (turn < -5 AND mark IN ({_in(net.LEFT)})) THEN 2 ELSE 1 END AS cls FROM lanes WHERE kind IN ('exit', 'tagged')),
b2 AS (SELECT *, max(cls) OVER (PARTITION BY o, k) AS best FROM b1),
b3 AS (SELECT * FROM b2 WHERE CASE WHEN best > 0 THEN cls = best OR (best = 1 AND cls >= 1) ELSE lane > n0 - least(n0, m) END),
b4 AS (SELECT *, bool_or(ref AND there) OVER (PARTITION BY o, k) AS signed FROM b3),
use_b AS (SELECT * FROM b4 WHERE NOT signed OR there),{_mapped("use_b", "pb")},
owned AS (SELECT DISTINCT p.o, p.s AS lane FROM pb p JOIN lanes l ON l.o = p.o AND l.k = p.k AND l.lane = p.s WHERE l.mark IN ({_in([*net.LEFT, *net.RIGHT, "reverse"])})),
use_r AS (SELECT l.* FROM lanes l ANTI JOIN owned w ON w.o = l.o AND w.lane = l.lane WHERE l.kind NOT IN ('exit', 'tagged')),{_mapped("use_r", "pr")},
p AS (SELECT * FROM pb UNION ALL SELECT * FROM pr),
q AS (SELECT *, row_number() OVER (PARTITION BY o, k, s ORDER BY t) > 1 AS again, row_number() OVER (PARTITION BY o, k, t ORDER BY s) > 1 AS met FROM p)
SELECT o AS l_orderkey, k AS movement, s::INT AS s_lane, t::INT AS t_lane, CASE WHEN again THEN 'split' WHEN met THEN 'join' ELSE 'continuation' END AS type
FROM q WHERE NOT (again AND met)
"""
}

QUERIES = {"lane_claims": lane_claims}
