"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embdedup, licenses, manifest, minhash, mixing, periodic, quality, sharding, token_hist, topk, urlfilter, warc
from .common import table

#: The vocabulary of the queries; the operators take any rank file and pattern.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: Context limits that op4 answers whether or not a document is as long.
CONTEXTS = [2**k for k in range(7, 21)]

#: The given URL rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers for every length that occurs and for usual context limits."""
    return token_hist.limits(token_hist.histogram(table(spark, sf_dir, "documents"), RANKS, PATTERN), CONTEXTS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=1000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a page: those of the document with its number; low quality or toxic means block."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    votes = labels.select(F.col("doc_id").alias("page_id"), F.expr("quality = 0 or toxic = 1").alias("blocked"))
    return urlfilter.judged(pages, URL_RULES, urlfilter.mined(pages, votes))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digested(bpe.with_text(table(spark, sf_dir, "documents")), RANKS, PATTERN).drop("text")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digested(periodic.periodic(periodic.planted(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text")))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "places")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audited(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_mixing, op2_minhash, op3_quality, op4_token_counts, op5_warc, op6_topk, op7_url_filter, op8_bpe, op9_embedding_dedup, op10_sharding, op11_periodic_runs, op12_license_scan, op13_merkle_manifest)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op2_minhash": minhash.SQL, "op5_warc": warc.SQL, "op6_topk": topk.SQL, "op9_embedding_dedup": embdedup.SQL, "op13_merkle_manifest": manifest.SQL}
