"""Operator 10: sharding by a Feistel permutation of global row numbers.

Rows are ordered by doc_id and text digest and numbered from 0. A Feistel network over the
smallest even number of bits that holds all numbers, walked along its cycle until it falls below
the row count, permutes them. ``shard = image mod shards`` and ``slot = image div shards``: the
law ``rows`` holds (counts at most one apart, slots without gaps), and anyone who knows the
count, the seed and a row's number can compute its place.

Texts are read once, for size, checksum and digest; sorting and numbering see these alone.

Defined results: null texts have size 1 and checksum 0; very long texts count whole; null doc_ids
come last; rows that repeat doc_id and text are in a tie that any order breaks, each with a place
of its own; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Images of ``numbers``, all below ``count``, under the permutation of range(count)."""
    half = np.uint64(max(1, ((max(count, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, seed * 0x2545F4914F6CDD1D + r) & mask)
        out[todo] = image = (left << half) | right
        todo = todo[image >= np.uint64(count)]
    return out.astype(np.int64)


def shard(docs: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("_digest")))
    count = rows.count()
    numbers = numbered(rows, [F.col("doc_id").asc_nulls_last(), F.col("_digest")]).drop("_digest")

    @F.pandas_udf("long")
    def image(n: pd.Series) -> pd.Series:
        return pd.Series(permuted(n.to_numpy(), count, seed))

    return numbers.withColumn("_image", image("row_number")).select(
        "doc_id", "size", "text_crc32", "row_number", F.pmod("_image", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_image") / F.lit(shards)).cast("long").alias("slot")
    )
