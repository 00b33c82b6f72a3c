"""Operator 6: exact top-k inner products with multi-resolution segment statistics.

Vectors are cut into 1, 4 and 16 segments. With a segment's mean and deviation of both vectors,
``|segment| * (mean * mean + deviation * deviation)`` summed over segments bounds their inner
product from above (Cauchy and Schwarz on the centred parts), and so their distance from below.
Coarse to fine, the bound removes candidates that can't reach the k-th best score known so far;
the survivors get exact scores.

Candidates are dealt into blocks of like vectors (by the signs of random products), whose size does
not depend on the table's up to ``MOST_BLOCKS`` blocks; beyond, blocks grow. Each query first meets
its own block, which gives a k-th best score to beat. A block's least and greatest segment means and
its greatest deviations bound all its members' scores: a query goes on to the blocks whose bound
reaches that score, and to no other. The k best of a query's blocks meet in one ranking.

Defined results: rows without vec_id, null vectors and vectors with null or non-finite components
take no part; vectors of different length are not compared; a row never answers a query with its
own vec_id; of rows that repeat a query's vec_id one (the greatest vector) asks; rows that repeat a
vec_id all answer; ties go to the smaller vec_id; an empty table gives an empty table; other columns
play no part whatever their names are. Scores are exact integers; from 2^62 on the search raises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small
from .embdedup import matrix

RESOLUTIONS = (1, 4, 16)
#: Bound of the table of block summaries, which all tasks get.
MOST_BLOCKS = 20_000
BITS = 24
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
SUMMARY = "block int, dim int, vec_id long, least double, low array<double>, high array<double>, spread array<double>"


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means, then deviations of each segment, all scaled by the root of its length."""
    border = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    n = np.diff(border)
    mean = np.add.reduceat(x, border[:-1], axis=1) / n
    square = np.add.reduceat((x - np.repeat(mean, n, axis=1)) ** 2, border[:-1], axis=1)
    return np.hstack((mean * np.sqrt(n), np.sqrt(square)))


def slack(of_x: np.ndarray, of_q: np.ndarray) -> float:
    """Margin for rounded bounds, relative to the norms."""
    return 1 + 1e-9 * float(np.abs(of_x).max(initial=0) * np.abs(of_q).sum())


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of vectors of integers (held as doubles) with one."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).sum()) >= 2.0**62:
        raise ValueError("scores of 2^62 and more are not supported")
    return x.astype(np.int64) @ q.astype(np.int64)


def best(queries: np.ndarray, query_ids: np.ndarray, known: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best candidates of each query, less those that can't reach the ``known`` score."""
    of_x = [segment_statistics(x, s) for s in RESOLUTIONS]
    of_q = [segment_statistics(queries, s) for s in RESOLUTIONS]
    rows, cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in range(len(queries)):
        bound = of_x[0] @ of_q[0][r]
        margin = slack(of_x[0], of_q[0][r])
        left = np.flatnonzero((ids != query_ids[r]) & (bound + margin >= known[r]))
        first = left if len(left) <= 4 * k else left[np.argpartition(-bound[left], 4 * k)[: 4 * k]]
        score = x[first] @ queries[r]
        least = max(known[r], np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf)
        left = left[bound[left] + margin >= least]
        for level in range(1, len(RESOLUTIONS)):
            if len(left) <= 4 * k:
                break
            bound = of_x[level][left] @ of_q[level][r]
            left = left[bound + margin >= least]
        score = x[left] @ queries[r]
        if len(left) > k:
            left = left[score + margin >= np.partition(score, len(score) - k)[len(score) - k]]
        score = exact_scores(x[left], queries[r])
        order = np.lexsort((ids[left], -score))[:k]
        rows.append(np.full(len(order), r))
        cols.append(left[order])
        scores.append(score[order])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``code``, the signs of random products: like vectors have like codes."""
    planes: dict[int, np.ndarray] = {}
    for b in batches:
        dims, code = b.column("dim").to_numpy(), np.zeros(b.num_rows, np.int64)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            if dim not in planes:
                planes[dim] = np.random.default_rng([11, int(dim)]).standard_normal((int(dim), BITS))
            code[at] = (matrix(b.column("vector").take(pa.array(at)), int(dim)) @ planes[dim] > 0) @ (1 << np.arange(BITS, dtype=np.int64))
        yield b.append_column("code", pa.array(code))


def _first(k: int):
    """A block's summary, and of each query in it the k-th best score among the block's others."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        block, dim = key[0].as_py(), key[1].as_py()
        group = group.combine_chunks()
        x, ids, asks = matrix(group.column("vector").chunk(0), dim), group.column("vec_id").to_numpy(), group.column("asks").to_numpy()
        n = min(RESOLUTIONS[-1], dim)
        s = segment_statistics(x, RESOLUTIONS[-1])
        low, high, spread = s[:, :n].min(axis=0), s[:, :n].max(axis=0), s[:, n:].max(axis=0)
        at = np.flatnonzero(asks)
        r, _, score = best(x[at], ids[at], np.full(len(at), -np.inf), x, ids, k)
        known = [float(score[r == i].min()) if (r == i).sum() == k else -math.inf for i in range(len(at))]
        none = [None] * len(at)
        return pa.table({"block": pa.array([block] * (1 + len(at)), pa.int32()), "dim": pa.array([dim] * (1 + len(at)), pa.int32()), "vec_id": pa.array([None, *ids[at].tolist()], pa.int64()), "least": pa.array([None, *known], pa.float64()), "low": pa.array([low, *none], pa.list_(pa.float64())), "high": pa.array([high, *none], pa.list_(pa.float64())), "spread": pa.array([spread, *none], pa.list_(pa.float64()))})

    return run


def _reached(summaries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
    """``blocks`` of each query: those of its length whose bound reaches its ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, found = b.column("dim").to_numpy(), [[]] * b.num_rows
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim not in summaries:
                    continue
                names, low, high, spread = summaries[dim]
                q = segment_statistics(matrix(b.column("vector").take(pa.array(at)), int(dim)), RESOLUTIONS[-1])
                n = low.shape[1]
                mean, deviation, known = q[:, :n], q[:, n:], b.column("least").to_numpy()[at]
                bound = np.maximum(mean, 0) @ high.T + np.minimum(mean, 0) @ low.T + deviation @ spread.T
                largest = max(np.abs(low).max(), np.abs(high).max(), spread.max())
                for i, row in zip(at, bound + 1 + 1e-9 * largest * np.abs(q).sum(axis=1, keepdims=True) >= known[:, None], strict=True):
                    found[i] = names[row].tolist()
            yield b.append_column("blocks", pa.array(found, pa.list_(pa.int32())))

    return run


def _search(k: int):
    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return OUT.empty_table()
        dim = key[1].as_py()
        q, x = (matrix(t.column("vector").combine_chunks(), dim) for t in (queries, candidates))
        query_ids, ids = queries.column("vec_id").to_numpy(), candidates.column("vec_id").to_numpy()
        r, c, score = best(q, query_ids, queries.column("least").to_numpy(), x, ids, k)
        return pa.table({"query_id": query_ids[r], "vec_id": ids[c], "score": score}, schema=OUT)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, query_block: int = 4096, candidate_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` greatest inner products of each query.

    Components become floor(scale * x). ``is_query``: which rows of ``vectors`` (vec_id,
    embedding) ask; all rows answer.
    """
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.where(fine & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"), F.size("embedding").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    coded = materialize(rows.mapInArrow(_signs, "vec_id long, vector array<double>, dim int, asks boolean, code long"))
    blocks = max(1, min(MOST_BLOCKS, math.ceil(coded.count() / candidate_block)))
    dealt = coded.repartitionByRange(blocks, "dim", "code", F.xxhash64("vec_id", "vector"))
    dealt = materialize(dealt.select("vec_id", "vector", "dim", "asks", F.spark_partition_id().alias("block")))
    first = materialize(dealt.groupBy("block", "dim").applyInArrow(_first(k), SUMMARY))
    summaries: dict = {}
    for r in first.where("low is not null").select("block", "dim", "low", "high", "spread").collect():  # a row for each block and length
        summaries.setdefault(r.dim, []).append((r.block, r.low, r.high, r.spread))
    summaries = {dim: (np.array([x[0] for x in every], np.int32), *(np.array([x[i] for x in every]) for i in (1, 2, 3))) for dim, every in summaries.items()}
    # one row for each query id; equal ids meet before the vectors are dealt out
    known = first.where("low is null").groupBy("block", "dim", "vec_id").agg(F.min("least").alias("least"))
    asked = dealt.where("asks").join(known, ["block", "dim", "vec_id"]).groupBy("vec_id").agg(F.max(F.struct("vector", "dim", "least")).alias("q")).select("vec_id", "q.*")
    sent = asked.mapInArrow(_reached(summaries), "vec_id long, vector array<double>, dim int, least double, blocks array<int>")
    sent = materialize(sent.select("vec_id", "vector", "dim", "least", F.explode("blocks").alias("block")))
    parts = small(materialize(sent.groupBy("block", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(query_block)).cast("int").alias("parts"))))
    key = ["block", "dim", "part"]
    q = sent.join(parts, ["block", "dim"]).select("vec_id", "vector", "least", "block", "dim", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
    c = dealt.join(parts, ["block", "dim"]).select("vec_id", "vector", "block", "dim", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    ranks = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
