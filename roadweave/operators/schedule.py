"""Which feeds are due: cadence, idle time and budgets as one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds without requests before background and maintenance feeds run; bulk budget.
IDLE = {"background": 300, "maintenance": 900}
BULK = 4


def due(feeds: DataFrame, idle: int, bulk: int = BULK) -> DataFrame:
    """Feeds to start now. ``feeds``: feed, class, cadence, in_flight, age (null: never ran), and place (order of registry).

    Realtime feeds always run when due. Others need idle time and share the budget left by those of
    them in flight, in the registry's order (that of their names without ``place``).
    """
    place = "place" if "place" in feeds.columns else "feed"
    bulky = F.col("class") != "realtime"
    ready = ~F.col("in_flight") & (F.col("age").isNull() | (F.col("age") >= F.col("cadence")))
    calm = ~bulky | F.coalesce(*[F.when(F.col("class") == k, F.lit(idle >= v)) for k, v in IDLE.items()], F.lit(False))
    rows = feeds.withColumns({"_busy": F.count_if(bulky & F.col("in_flight")).over(Window.partitionBy()), "_starts": ready & calm})
    turn = F.count_if(F.col("_starts")).over(Window.partitionBy(bulky).orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_turn", turn).where(F.col("_starts") & (~bulky | (F.col("_turn") <= F.lit(bulk) - F.col("_busy")))).drop("_busy", "_starts", "_turn")


def ages(registry: DataFrame, runs: DataFrame, now) -> DataFrame:
    """The registry with the seconds since each feed last finished."""
    last = runs.groupBy("feed").agg(F.max("finished").alias("_finished"))
    return registry.join(last, "feed", "left").withColumn("age", F.unix_timestamp(F.lit(now)) - F.unix_timestamp("_finished")).drop("_finished")
