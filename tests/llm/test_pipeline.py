"""The pipeline against its stages in plain Python, and the entry's guard."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from roadweave.llm import quality
from roadweave.llm.queries import oracle_sql, queries

from .test_minhash import brute
from .test_mixing import filled
from .test_quality_tokens import OWN

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_run_equals_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    scorer = quality.Scorer(quality.learned(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    good = {i for i, r in rows.items() if scorer.score(r.text) >= quality.KEEP}
    kept = {d for d, _, _, k in brute([(i, rows[i].text) for i in sorted(good)], 5) if k}
    out = corpus_pipeline.run(spark, SF).collect()
    words = {i: len([w for w in (rows[i].text or "").split() if w]) for i in kept}
    sizes = {}
    for i in kept:
        sizes[rows[i].source] = sizes.get(rows[i].source, 0) + words[i]
    taken = {}
    for r in out:
        assert r.doc_id in kept
        ids = OWN.encode_ordinary(rows[r.doc_id].text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        taken[r.source] = taken.get(r.source, 0) + words[r.doc_id]
    for s, target in filled(sizes).items():
        assert abs(taken.get(s, 0) - target) <= max(words[i] for i in kept if rows[i].source == s)
    staged = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        staged = stage(spark, staged, SF)
        assert staged.columns == docs.columns


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "some words here", "en", "s", 3), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "word " * 3000, "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (df, df.limit(0)):
        staged = frame
        for _, stage in corpus_pipeline.STAGES:
            staged = stage(spark, staged, SF)
        staged.collect()


def test_repeated_rows_and_clashing_names(spark):
    """Exact rows of a document leave one; every stage passes columns of any name through."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(1, text, "en", "s", 5)] * 40 + [(2, text, "en", "s", 5), (3, "other words that stand alone here", "en", "t", 1), (4, None, "en", "t", 1), (4, None, "en", "t", 1), (None, text, "en", "t", 1)]
    df = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.one_of_each_group(spark, df, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, text), (3, rows[41][1]), (4, ""), (0, text)])
    clash = "_dropped _repeated _copy mix_x mix_size quality_score count n_tokens digest _column_2 component_id kept".split()
    odd = df.withColumns({c: F.lit(c) for c in clash})
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        got = out.collect()
        assert got and all(r[c] == c for r in got for c in clash)
    assert corpus_pipeline.encoded_documents(spark, odd, SF).count() == len(rows)


def test_every_operator_is_registered():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(oracle_sql()) <= set(names)
