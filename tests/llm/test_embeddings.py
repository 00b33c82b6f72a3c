"""Vector near-duplicates and exact top-k against plain numpy."""

import math

import numpy as np
from pyspark.sql import functions as F

from roadweave.llm import embdedup, topk

SCHEMA = "vec_id long, embedding array<float>"


def vectors(seed=1, n=400, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for i in range(0, n, 4):
        x[i] = x[(i * 7) % n] * (1 + i % 3) + rng.standard_normal(dim).astype(np.float32) * (0.05 if i % 8 else 0.35)
    x[10] = x[20] = x[30]
    return x


def brute_links(ids, x, cosine=0.9):
    x = x.astype(np.float64)
    c = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    linked = c >= cosine
    np.fill_diagonal(linked, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], 1 << 60).min(axis=1))
        if (new == label).all():
            return {(int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, linked.sum(axis=1), label, strict=True)}
        label = new


def found(spark, rows, **options):
    return {tuple(r) for r in embdedup.near_vectors(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_links_equal_all_pairs(spark):
    x = vectors()
    ids = [3 * i + 1 for i in range(len(x))]
    rows = list(zip(ids, x.tolist(), strict=True))
    assert found(spark, rows, miss=1e-9) == brute_links(ids, x)
    assert found(spark, rows, miss=1e-9, bucket=16, block=8) == brute_links(ids, x)


def test_hot_bucket_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = (np.ones((300, 16)) + rng.standard_normal((300, 16)) * 0.25).astype(np.float32)
    ids = list(range(300))
    assert found(spark, list(zip(ids, x.tolist(), strict=True)), miss=1e-9, block=50) == brute_links(ids, x)


def test_copies_count_without_pairs(spark):
    got = found(spark, [(i, [1.0, 2.0]) for i in range(5, 1005)] + [(1, [2.0, 4.0]), (2, [-2.0, 1.0])])
    assert {r for r in got if r[0] == 7} == {(7, 1000, 1, False)} and {r for r in got if r[0] == 2} == {(2, 0, 2, True)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, nan]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [1.0, -0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 0.0]), (6, [1.0, 0.0])]
    got = sorted(map(tuple, embdedup.near_vectors(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1))).collect()), key=str)
    assert len(got) == 11
    alone = {r[0]: r for r in got if r[0] not in (6, 7)}
    assert all(alone[i] == (i, 0, i, True) for i in (1, 2, 3, 4, 5, 8, 9)) and alone[None] == (None, 0, None, True)
    assert [r for r in got if r[0] in (6, 7)] == [(6, 2, 6, True), (6, 2, 6, True), (7, 2, 6, False)]
    assert found(spark, []) == set()


def test_tables_hold_the_miss_rate():
    for n in (10, 10_000, 10**9):
        bits, tables = embdedup.tables_for(n, 0.9, 256, 1e-4)
        meets = (1 - math.acos(0.9) / math.pi) ** bits
        assert (1 - meets) ** tables <= 1e-4


def brute_top(ids, x, asks, k=5):
    e = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    out = set()
    for i, q in zip(ids, e, strict=True):
        if asks(i):
            scored = sorted((-int(q @ v), j) for j, v in zip(ids, e, strict=True) if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


def test_top_k_equals_all_scores(spark):
    x = vectors(2)
    ids = list(range(len(x)))
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), SCHEMA)
    want = brute_top(ids, x, lambda i: i % 10 == 0)
    for options in ({}, {"query_block": 7, "candidate_block": 50}, {"query_block": 3, "candidate_block": 9}):
        assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, **options).collect()} == want


def test_top_k_odd_inputs(spark):
    nan = float("nan")
    rows = [(0, [1.0, 1.0]), (50, [0.5, 0.5]), (1, [1.0, nan]), (2, None), (3, [1.0, None]), (4, [2.0, 2.0]), (5, [2.0, 2.0]), (None, [9.0, 9.0]), (6, [1.0])]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")), F.col("vec_id") % 50 == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [4, 5, 50]
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


def test_segment_bound_holds():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((50, 19)), rng.standard_normal((9, 19))
    for s in topk.RESOLUTIONS:
        assert (topk.segment_statistics(x, s) @ topk.segment_statistics(q, s).T >= x @ q.T - 1e-9).all()


def test_top_k_of_clusters_in_few_blocks(spark, monkeypatch):
    """Queries meet only blocks that their bound reaches, and lose nothing by it."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 32)) * 5
    x = (np.repeat(centres, 50, axis=0) + rng.standard_normal((600, 32)) * 0.05).astype(np.float32)
    ids = rng.permutation(600).tolist()
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), SCHEMA)
    tables = []
    monkeypatch.setattr(topk, "materialize", lambda d, real=topk.materialize: tables.append(real(d)) or tables[-1])
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, candidate_block=50).collect()
    assert {tuple(r) for r in got} == brute_top(ids, x, lambda i: i % 10 == 0)
    sent = next(t for t in tables if t.columns == ["vec_id", "vector", "dim", "least", "block"])
    assert sent.count() < 60 * 12 / 2


def test_large_scores_are_exact(spark):
    rows = [(0, [2.0**22, 1.0, 3.0]), (1, [2.0**22, 1.0, 2.0]), (2, [2.0**22, 1.0, 3.0]), (3, [2.0**22, 1.00390625, 3.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    e = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, sum(a * b for a, b in zip(e[0], e[i], strict=True))) for i in (3, 2, 1)]
