"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import BROADCAST_ROWS, drop_scratch, fresh, materialize, qualified, scratch_dir, small

__all__ = ["BROADCAST_ROWS", "drop_scratch", "fresh", "looked_up", "lower_ascii", "materialize", "numbered", "portions", "qualified", "scratch_dir", "set_apart", "small", "table", "without", "word_count", "words"]

#: Bytes of a column that a Python worker unpacks at once.
PORTION = 2 << 20
#: The white space that separates words, and A-Z with a-z.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.size(words(text)).cast("long")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add under these names."""
    return df.drop(*[c for c in df.columns if c in names])


def set_apart(df: DataFrame, needed: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with all columns but the ``needed`` ones under names that clash with nothing, and every column's name there."""
    names = {c: c if c in needed else f"_column_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def looked_up(rows: DataFrame, known: DataFrame, key: str, spread: Column, salts: int = 16) -> DataFrame:
    """Left join of ``rows`` with ``known`` (a written table, one row a key).

    A small table goes to all tasks and the rows stay where they are. Beyond that the rows of a hot
    key are dealt over ``salts`` tasks by ``spread``, and each row of ``known`` is there for all.
    """
    marked = small(known)
    if marked is not known:
        return rows.join(marked, key, "left")
    salt = fresh([*rows.columns, *known.columns], "_salt")
    every = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(every, [key, salt], "left").drop(salt)


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``row_number`` from 0 in this order, without one task seeing all of them.

    The sorted rows are written; a row's number is its place in its file plus the rows of all files
    before. Where a task cuts its rows into several files (``spark.sql.files.maxRecordsPerFile``), their
    names end with a counter, by which they follow each other.
    """
    name = F.col("_metadata.file_name")
    file, place = fresh(rows.columns, "_file"), fresh(rows.columns, "_place")
    there = materialize(rows.orderBy(*order)).select("*", name.alias(file), F.col("_metadata.row_index").alias(place))
    in_order = Window.orderBy(F.regexp_extract(file, r"^part-(\d+)", 1).cast("long"), F.regexp_extract(file, r"-c(\d+)\.", 1).cast("long")).rowsBetween(Window.unboundedPreceding, -1)
    before = fresh(rows.columns, "_before")
    files = materialize(there.groupBy(file).count()).select(file, F.coalesce(F.sum("count").over(in_order), F.lit(0)).alias(before))
    return there.join(small(materialize(files)), file).withColumn("row_number", F.col(before) + F.col(place)).drop(file, place, before)


def portions(batches: Iterator[pa.RecordBatch], column: str, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of ``column``, so that what a worker unpacks is bounded; a longer value is alone."""
    for b in batches:
        part = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // size
        for a, z in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]):
            yield b.slice(a, z - a)
