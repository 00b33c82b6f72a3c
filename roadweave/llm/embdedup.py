"""Operator 9: near-duplicate vectors by random-hyperplane signs in several tables.

The signs of a vector's products with ``bits`` random planes are its bucket in one table; two
vectors at angle t share a bucket with probability (1 - t / pi)^bits. The number of bits follows
the number of vectors, so that a bucket holds about ``bucket`` of them, and the number of tables
follows the bits: a pair at exactly the threshold is missed in all of them with probability
``miss`` at most. Within a bucket all cosines are computed exactly, in double precision.

A pair counts in the first table where it meets, which both ends can tell from their bucket
numbers (packed into one, two or four bytes a table); so tasks give sums of links and spanning
forests, never pairs. Equal vectors are one class with a weight. A bucket of over ``block`` classes
is dealt out by pairs of blocks. Vectors travel as they are given (floats as floats), once a table;
the number of tables grows with about the third root of the number of vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link
with nothing, nor do rows without vec_id; vectors of different length never link; a cosine of just
the threshold links; rows that repeat a vec_id share a component; an empty table gives an empty
table; other columns play no part whatever their names are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small
from .components import connected_components, forest_roots


def usable(vector: Column) -> Column:
    """Whether all components are finite numbers and one at least is not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, all of this length, as doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def tables_for(count: int, cosine: float, bucket: int, miss: float) -> tuple[int, int]:
    """Bits of a bucket number and number of tables."""
    bits = min(30, max(4, round(math.log2(max(count, 1) / bucket)) if count > bucket else 4))
    meets = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - meets))) if meets < 1 else 1


def _code_type(bits: int) -> np.dtype:
    return np.dtype("u1" if bits <= 8 else "u2" if bits <= 16 else "u4")


def _coded(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``classes`` with ``codes``, the bucket in each table, and the same ``packed``."""
    weights, kind = 1 << np.arange(bits, dtype=np.int64), _code_type(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            codes: list = [None] * b.num_rows
            dims = np.asarray(b.column("dim").to_numpy(zero_copy_only=False))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes = {dim: np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), bits * tables))}
                x = matrix(b.column("vector").take(pa.array(at)), int(dim))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                for i, c in zip(at, ((x @ planes[dim]).reshape(-1, tables, bits) > 0) @ weights, strict=True):
                    codes[i] = c.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.list_(pa.int32())), pa.array([c.astype(kind).tobytes() for c in codes], pa.binary())], names=[*b.schema.names, "codes", "packed"])

    return classes.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in classes.schema)}, codes array<int>, packed binary")


def _bucket_links(cosine: float, bits: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        table, dim, i, j = key[0].as_py(), key[1].as_py(), key[3].as_py(), key[4].as_py()
        group = group.combine_chunks()
        x = matrix(group.column("vector").chunk(0) if group.num_rows else pa.array([], pa.list_(pa.float64())), dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine
        np.fill_diagonal(linked, False)
        if i != j:
            block = group.column("block").to_numpy()
            linked &= block[:, None] != block[None, :]
        touched = np.flatnonzero(linked.any(axis=1))
        none = {"id": [], "tag": [], "links": [], "root": []}
        if not len(touched):
            return pa.table(none, schema=OUT)
        linked = linked[np.ix_(touched, touched)]
        ids, tags, copies = (group.column(c).to_numpy()[touched] for c in ("id", "tag", "copies"))
        roots = ids[forest_roots(linked)]
        r, c = np.nonzero(linked)
        if table:
            codes = np.frombuffer(b"".join(group.column("packed").take(pa.array(touched)).to_pylist()), _code_type(bits)).reshape(len(touched), -1)
            first = np.ones(len(r), bool)
            for a in range(0, len(r), 1 << 16):
                s = slice(a, a + (1 << 16))
                first[s] = ~(codes[r[s], :table] == codes[c[s], :table]).any(axis=1)
            r, c = r[first], c[first]
        links = np.zeros(len(touched), np.int64)
        np.add.at(links, r, copies[c])
        return pa.table({"id": ids, "tag": tags, "links": links, "root": roots}, schema=OUT)

    return run


OUT = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def near_vectors(vectors: DataFrame, cosine: float = 0.9, miss: float = 1e-4, bucket: int = 1024, block: int = 2048, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding)."""
    given = vectors.schema["embedding"].dataType.elementType.simpleString()
    number = "float" if given == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: (x.cast(number) + F.lit(0.0).cast(number)).cast(number)).alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("vec_id").isNotNull())
    hashed = rows.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("vector")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "vector"))})
    classes = materialize(hashed.where("ok").groupBy("h1", "h2", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", F.col("h1").alias("tag"), F.col("h2").alias("tag2"), "copies", F.size("vector").alias("dim"), "vector"))
    bits, tables = tables_for(classes.count(), cosine, bucket, miss)
    coded = materialize(_coded(classes.select("id", "tag", "copies", "dim", "vector"), bits, tables, seed))
    key = ["table", "dim", "code"]
    hot = materialize(coded.select("dim", F.posexplode("codes").alias("table", "code")).groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / F.lit(block)).cast("int").alias("blocks")))
    entries = (
        coded.select("*", F.posexplode("codes").alias("table", "code"))
        .join(small(hot), key, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("id", "tag"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .select(*key, "i", "j", "block", "id", "tag", "copies", "vector", "packed")
    )
    found = materialize(entries.groupBy(*key, "i", "j").applyInArrow(_bucket_links(cosine, bits), "id long, tag long, links long, root long"))
    links = found.groupBy("id", "tag").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.select("id", F.col("tag").alias("h1"), F.col("tag2").alias("h2"), "copies").join(links.withColumnRenamed("tag", "h1"), ["id", "h1"], "left").join(parts, "id", "left")
    return (
        hashed.select("vec_id", "h1", "h2")
        .join(known, ["h1", "h2"], "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN m ON m.v = e.vec_id LEFT JOIN l ON l.a = e.vec_id
"""
