"""Merkle trees, proofs and folds against a plain Python walk, and row numbers of files that were cut."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from roadweave.llm import manifest, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, tree string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text) -> str:
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(one, (doc_id, source, lang, n_chars, text)))


def climb(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def fold(levels: list[list[str]], i: int, start: str) -> tuple[list[str], str]:
    others = []
    for level in levels[:-1]:
        run = list(level[i // 2 * 2 : i // 2 * 2 + 2])
        others += run[: i % 2] + run[i % 2 + 1 :]
        run[i % 2] = start
        start, i = h(*run), i // 2
    return others, start


def expected(rows: list[tuple]) -> list[tuple]:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of rows (doc_id, text, lang, source, n_chars)."""
    trees: dict = {}
    for doc_id, text, lang, source, n in rows:
        new = n if n is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 else n + 1
        trees.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n, text)), doc_id, leaf(doc_id, source, lang, new, text)))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    inner = {lang: climb([row[0][2] for row in sorted(trees[lang])]) for lang in order}
    top = climb([inner[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for i, ((_, _, own), doc_id, changed) in enumerate(sorted(trees[lang])):
            first, sub = fold(inner[lang], i, changed)
            second, root = fold(top, k, sub)
            out.append((doc_id, own, inner[lang][-1][0], top[-1][0], h(*first, *second), root, root == top[-1][0]))
    return out


def some(rng: random.Random, n: int, langs: int) -> list[tuple]:
    names = [None, "", "é", "zz", *(f"l{i}" for i in range(langs))]
    rows = [(rng.choice([None, rng.randrange(4 * n), -i]), rng.choice([None, "", "ü x", "long " * 500, str(i)]), names[min(int(rng.expovariate(0.4)), len(names) - 1)] if langs < 50 else rng.choice(names), rng.choice([None, "s"]), rng.choice([None, i, 2**63 - 1]), 1, "t") for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize(("n", "langs", "bits", "most"), [(120, 3, 11, 1 << 14), (150, 2, 2, 4), (90, 80, 2, 3), (3, 0, 11, 16)])
def test_against_a_plain_walk(spark, n, langs, bits, most):
    rows = some(random.Random(n + bits), n, langs)
    got = manifest.audited(spark.createDataFrame(rows, DOCS), bits, most)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected([r[:5] for r in rows]), key=str)


def test_one_leaf_an_empty_table_and_carried_columns(spark):
    rows = [(1, "a", "en", "s", 1, 5, "t")]
    docs = spark.createDataFrame(rows, DOCS)
    [got] = manifest.audited(docs).collect()
    assert tuple(got) == expected([rows[0][:5]])[0] and got.root == got.leaf and got.proof_sha256 == h("")
    assert manifest.audited(docs.limit(0)).count() == 0
    carried = manifest.manifest(docs, {"n": F.col("n"), "place": F.col("tree"), "bits": F.lit(None).cast("array<int>")})
    assert carried.columns == ["doc_id", "lang", "leaf", "n", "place", "bits", "subroot", "root", "proof"]
    assert tuple(carried.first())[3:6] == (5, "t", None)


def test_row_numbers_of_cut_files(spark):
    """Files of one task that ``maxRecordsPerFile`` cuts follow each other by their counter."""
    key = "spark.sql.files.maxRecordsPerFile"
    spark.conf.set(key, 7)
    try:
        docs = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
        got = sharding.shard(docs, shards=8).collect()
        assert sorted(r.row_number for r in got) == list(range(500)) and all(r.row_number == r.doc_id for r in got)
        assert len({(r.shard, r.slot) for r in got}) == 500
        rows = some(random.Random(5), 100, 3)
        assert sorted(map(tuple, manifest.audited(spark.createDataFrame(rows, DOCS), 3, 8).collect()), key=str) == sorted(expected([r[:5] for r in rows]), key=str)
    finally:
        spark.conf.unset(key)


def test_query_against_sql(spark):
    import duckdb

    from roadweave.llm.queries import op13_merkle_manifest, oracle_sql

    sf_dir = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = duckdb.sql(oracle_sql()["op13_merkle_manifest"])
    got = op13_merkle_manifest(spark, sf_dir)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and {r[-1] for r in rows} == {True, False}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert rows == sorted(expected(docs))
