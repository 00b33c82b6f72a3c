"""Latest-snapshot semantics: a table holds what its feeds said last.

Each function takes the stored snapshot and a batch and returns the new snapshot; nothing is
changed in place. :mod:`roadweave.operators.buckets` stores what changed and publishes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAMP = "ingested_at"


def last_of_batch(batch: DataFrame, keys: Sequence[str], seq: str | Column) -> DataFrame:
    """The last row of each key by its place in the batch."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy((F.col(seq) if isinstance(seq, str) else seq).desc()))
    return batch.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str], now: Column, seq: str | None = None) -> DataFrame:
    """Insert the batch; on a known key every other column is overwritten, by null where it is missing."""
    batch = last_of_batch(batch, keys, seq) if seq else batch
    given = set(batch.columns)
    new = batch.withColumn(STAMP, now).select(*[F.col(c) if c in given or c == STAMP else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns])
    return stored.join(new.select(*keys), list(keys), "left_anti").select(*stored.columns).unionByName(new)


def merge_changed(stored: DataFrame, batch: DataFrame, keys: Sequence[str], values: Sequence[str], now: Column, seq: str | None = None) -> DataFrame:
    """Like :func:`upsert`, but a row whose values are the same keeps its stamp.

    One full outer join on the keys; the last row of the batch wins whatever its own time is.
    """
    batch = last_of_batch(batch, keys, seq) if seq else batch
    new = batch.select(*keys, F.struct(*values).alias("_new"))
    old = stored.select(*keys, F.struct(*values).alias("_old"), F.col(STAMP).alias("_stamp"))
    both = old.join(new, list(keys), "full_outer")
    same = F.col("_new").isNull() | (F.col("_old").isNotNull() & F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(*keys, *[F.when(same, F.col(f"_old.{v}")).otherwise(F.col(f"_new.{v}")).alias(v) for v in values], F.when(same, F.col("_stamp")).otherwise(now).alias(STAMP))


def upsert_preserving(stored: DataFrame, batch: DataFrame, keys: Sequence[str], kept: Sequence[str], now: Column) -> DataFrame:
    """Upsert in which stored non-null values of ``kept`` columns win over the batch's."""
    values = [c for c in stored.columns if c not in {*keys, STAMP}]
    old = stored.select(*keys, *[F.col(v).alias(f"_old_{v}") for v in values], F.col(STAMP).alias("_stamp"))
    both = old.join(batch.select(*keys, *values, F.lit(True).alias("_given")), list(keys), "full_outer")
    given = F.coalesce(F.col("_given"), F.lit(False))
    pick = lambda v: (F.coalesce(f"_old_{v}", v) if v in kept else F.when(given, F.col(v)).otherwise(F.col(f"_old_{v}"))).alias(v)
    return both.select(*keys, *[pick(v) for v in values], F.when(given, now).otherwise(F.col("_stamp")).alias(STAMP)).select(*stored.columns)


def prune(stored: DataFrame, batch: DataFrame, keys: Sequence[str], category: str, value: str) -> DataFrame:
    """Drop the category's rows that the batch does not hold; an empty batch empties the category."""
    other = stored.where(~F.col(category).eqNullSafe(F.lit(value)))
    return other.unionByName(stored.where(F.col(category) == value).join(batch.select(*keys).distinct(), list(keys), "left_semi"))


def guarded_prune(stored: DataFrame, batch: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Prune every category that the batch has rows of; one that vanished as a whole stays."""
    alive = batch.select(category).distinct().withColumn("_alive", F.lit(True))
    held = batch.select(*keys).distinct().withColumn("_held", F.lit(True))
    rows = stored.join(alive, category, "left").join(held, list(keys), "left")
    return rows.where(F.col("_alive").isNull() | F.col("_held").isNotNull()).select(*stored.columns)


def shrinks(stored: DataFrame, batch: DataFrame, share: float = 0.5) -> None:
    """Guard: raise where the batch has under ``share`` of the stored rows."""
    was, now = stored.count(), batch.count()
    if now < share * was:
        raise ValueError(f"the new snapshot has {now} rows, the stored one {was}: refused")


def replace_extract(members: DataFrame, roads: DataFrame, batch: DataFrame, extract: str) -> tuple[DataFrame, DataFrame]:
    """New membership of one extract (extract, road_id) and the roads that still have any."""
    kept = members.where(F.col("extract") != extract).unionByName(batch.select(F.lit(extract).alias("extract"), "road_id").distinct())
    return kept, roads.join(kept.select("road_id").distinct(), "road_id", "left_semi")


def replace_children(stored: DataFrame, batch: DataFrame, parent: str) -> DataFrame:
    """Children of the batch's parents are replaced as a whole; others stay."""
    return stored.join(batch.select(parent).distinct(), parent, "left_anti").select(*stored.columns).unionByName(batch.select(*stored.columns))


def update_only(stored: DataFrame, batch: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Known keys take the batch's non-null values; unknown keys are not inserted."""
    new = batch.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values])
    return stored.join(new, list(keys), "left").withColumns({v: F.coalesce(f"_new_{v}", v) for v in values}).select(*stored.columns)


def replace_scoped(stored: DataFrame, rebuilt: DataFrame, scope: DataFrame, ends: Sequence[str]) -> DataFrame:
    """Replace all rows that touch a road of ``scope`` (road_id) at any of their ends."""
    rest = stored
    for end in ends:
        rest = rest.join(scope.select(F.col("road_id").alias(end)).distinct(), end, "left_anti")
    return rest.select(*stored.columns).unionByName(rebuilt.select(*stored.columns))


def replace_assignments(assignments: DataFrame, links: DataFrame, batch: DataFrame, batch_links: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Assignments of other versions go, the batch's are upserted; links follow matched ones only."""
    keys = ["source_kind", "source_key"]
    kept = assignments.where(F.col("version") == version).join(batch.select(*keys), keys, "left_anti").select(*assignments.columns).unionByName(batch.select(*assignments.columns))
    matched = kept.where("status = 'matched'").select(*keys)
    rest = links.join(batch.select(*keys), keys, "left_anti").unionByName(batch_links.select(*links.columns))
    return kept, rest.join(matched, keys, "left_semi").select(*links.columns)


def changed_roads(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """Roads (road_id) whose set of row ids differs between two tables (road_id, id)."""
    a, b = existing.select("road_id", "id", F.lit(1).alias("side")), generated.select("road_id", "id", F.lit(2).alias("side"))
    sides = a.unionByName(b).groupBy("road_id", "id").agg(F.bit_or("side").alias("sides"))
    return sides.where("sides <> 3").select("road_id").distinct()


def _fs(spark: SparkSession, folder: str):
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make
