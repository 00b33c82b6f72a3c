"""A corpus pipeline of four operators: quality classifier, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import bpe, minhash, mixing, quality
from roadweave.llm.common import fresh, materialize, set_apart, small, table
from roadweave.llm.queries import PATTERN, RANKS

#: None: the classifier and the encoder can't be put in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, gives a score of ``quality.KEEP`` or more.

    Null, empty and very long texts, ties at the bound, repeated rows and an empty table are scored as
    ``quality`` states; rows are judged one by one, so repeated ones stay or go together. A column
    of the score's name passes through like any other.
    """
    model = quality.learned(docs, table(spark, sf_dir, "labels"))
    apart, names = set_apart(docs, ["doc_id", "text"])
    return quality.scored(apart, model).where(F.col("quality_score") >= quality.KEEP).select(*[F.col(names[c]).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near-duplicates (five-word shingles, similarity 0.8), and of each group the least doc_id.

    Texts are judged, not their ids: of two texts under one doc_id each has its own duplicates. Of rows
    that repeat doc_id and text one stays, whichever its other columns. Texts without words, null texts
    and rows without doc_id have no duplicates; an empty table gives an empty table. No column name
    clashes with those of the joins.
    """
    dropped, gone_mark, repeated = (fresh(docs.columns, c) for c in ("_dropped", "_mark", "_repeated"))
    gone = materialize(minhash.repeats(docs).select(F.col("doc_id").alias(dropped), F.col("mark").alias(gone_mark)))
    left = docs.join(small(gone), (F.col("doc_id") == F.col(dropped)) & (F.md5("text") == F.col(gone_mark)), "left_anti")
    twice = left.where("doc_id is not null").groupBy(F.col("doc_id").alias(repeated), F.md5("text")).count().where("count > 1").select(repeated).distinct()
    twice = small(materialize(twice))
    once = left.join(twice, F.col("doc_id") == F.col(repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, F.col("doc_id") == F.col(repeated), "left_anti").unionByName(once)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources to the weights 5, 2, 1 takes them.

    Null texts, null sources, very long texts, ties, repeated rows and an empty table go as ``mixing``
    states; columns of any name pass through.
    """
    apart, names = set_apart(docs, ["doc_id", "text", "source"])
    return mixing.repeated(mixing.mix(apart)).select(*[F.col(names[c]).alias(c) for c in docs.columns])


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of ids and decoded bytes of each document.

    Null and empty texts have no tokens; every row gives a row, repeated ones too; other columns, those
    with names of outputs among them, play no part.
    """
    return bpe.digested(docs.select("doc_id", "source", "text"), RANKS, PATTERN).drop("text")


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each_group), ("mixing", mixed_sources), ("encoding", encoded_documents)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
