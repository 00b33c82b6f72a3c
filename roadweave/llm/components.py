"""Distributed connected components: alternating large-star and small-star steps
(Kiveris et al., Connected Components in MapReduce and Beyond, 2014)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges a task writes at least; keeps rounds over few edges from writing many small files.
EDGES_A_TASK = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b: long); component is the smallest id reachable.

    Null ends and loops are left out. Every step joins a node's smallest neighbour to its edges
    (joins that AQE can split, minima that are combined before the shuffle): a node's edges are
    never gathered in one task. Each round is written to the shared folder. The rounds end when
    the edges are stars: no node has two smaller neighbours or both a smaller and a larger one.
    """
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a is not null and b is not null and a <> b").distinct()
    e = materialize(e)
    while True:
        count, open_ = _state(e)
        if not open_:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = materialize(moved.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct().coalesce(max(4, math.ceil(count / EDGES_A_TASK))))
    roots = e.select(F.col("lo").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots)


def _state(e: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether any node keeps them from being stars."""
    ends = e.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    r = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))), F.lit(False))).first()
    return r[0], r[1]


def forest_roots(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric boolean matrix the least node of its component."""
    label = np.arange(len(linked))
    while len(label):
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
