"""Operator 3: a quality classifier by compression.

Two Zstandard dictionaries are built, one from text labelled good and one from text labelled bad.
A text is cut into windows of 256 bytes, so that the dictionary and not the text's own past
decides, and all windows are compressed with both. With ``g`` and ``b`` the summed sizes,

    difference = (b - g) / max(b, g)        normalised compressed-size difference

goes through a logistic calibration fitted on labelled rows that gave no dictionary text.

The fit has one bound, a parameter: ``sample_rows`` rows of each label, those with the least
digests of their doc_ids, give dictionaries and calibration. Of these rows whole texts count:
their windows are dealt out to tasks by ``CHUNK_BYTES``, each task trains a dictionary, and the
dictionaries of a label are the text of its final one. Calibrating rows weigh as many as all
labelled rows of their label do, so that the share of good rows does not depend on the bound. The
driver sees two dictionaries and a number for each calibrating row.

Defined results: null and empty texts, and texts of white space only, hold nothing to judge; they
score as the text " " does. Very long texts are compressed window by window. Rows that repeat a
doc_id, text and label teach once; a doc_id with both labels teaches both. Labels that are null or
neither 0 nor 1, and rows without doc_id, teach nothing; without rows of both labels every score
is the share of good ones (0.5 without any). A score of just ``KEEP`` is good. An empty table gives
an empty table; other columns of the documents pass through, one named like the output is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, portions, without

WINDOW = 256
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 6000
#: Bytes of text that a task trains a dictionary on.
CHUNK_BYTES = 2 << 20
KEEP = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float]


def windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, len(text), WINDOW)]


class Scorer:
    """A model with its compressors, one for each process that scores."""

    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) if d else None
        self.good, self.bad = make(model.good), make(model.bad)

    def difference(self, text: str | None) -> float:
        raw = (text or "").encode()
        raw = raw if raw.strip() else b" "
        g = b = 0
        good, bad = self.good.compress, self.bad.compress
        for w in windows(raw):
            g += len(good(w))
            b += len(bad(w))
        return (b - g) / max(b, g)

    def score(self, text: str | None) -> float:
        if self.good is None:
            return float(self.weights[1])
        return float(1 / (1 + np.exp(-np.clip(self.weights @ (self.difference(text), 1.0), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, often: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, row i counting ``often[i]`` times; the last is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (often * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (often * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return w


def _trained(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, MemoryError):  # too little text for statistics: its content serves as it is
        content = b"".join(pieces)[-DICTIONARY_BYTES:]
        return content if len(content) >= 8 else content.ljust(8)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """quality, digest, place and piece: all windows of the texts."""
    for b in portions(batches, "text"):
        for quality, digest, text in zip(*(b.column(c).to_pylist() for c in ("quality", "digest", "text")), strict=True):
            raw = text.encode()
            every = windows(raw) if raw.strip() else []
            for a in range(0, len(every), 1 << 14):
                part = every[a : a + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([quality] * len(part), pa.int32()), pa.array([digest] * len(part)), pa.array(range(a, a + len(part)), pa.int64()), pa.array(part, pa.binary())], names=["quality", "digest", "place", "piece"])


def _dictionary(key: tuple, group: pa.Table) -> pa.Table:
    group = group.sort_by([("digest", "ascending"), ("place", "ascending")])
    return pa.table({"quality": pa.array([key[0].as_py()], pa.int32()), "digest": [str(key[1].as_py()).zfill(12)], "dictionary": pa.array([_trained(group.column("piece").to_pylist())], pa.binary())})


def dictionaries(texts: DataFrame) -> dict[int, bytes]:
    """A dictionary for each quality of ``texts`` (a written table: text, quality, digest)."""
    sizes = texts.groupBy("quality").agg(F.ceil(F.sum(F.octet_length("text")) / F.lit(CHUNK_BYTES)).cast("long").alias("chunks"))
    pieces = texts.mapInArrow(_pieces, "quality int, digest string, place long, piece binary").join(F.broadcast(sizes), "quality")
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("digest", "place"), F.greatest("chunks", F.lit(1))))
    first = materialize(dealt.select("quality", "chunk", "digest", "place", "piece").groupBy("quality", "chunk").applyInArrow(_dictionary, "quality int, digest string, dictionary binary"))

    def joined(key: tuple, group: pa.Table) -> pa.Table:
        every = group.sort_by("digest").column("dictionary").to_pylist()
        return pa.table({"quality": pa.array([key[0].as_py()], pa.int32()), "dictionary": pa.array([_trained([w for d in every for w in windows(d)])], pa.binary())})

    return {r.quality: bytes(r.dictionary) for r in first.groupBy("quality").applyInArrow(joined, "quality int, dictionary binary").collect()}


def _differences(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in portions(batches, "text"):
            yield b.select(["quality", "digest"]).append_column("x", pa.array([scorer.difference(t) for t in b.column("text").to_pylist()], pa.float64()))

    return run


def fit(sample: DataFrame, known: dict[int, tuple[int, int]]) -> Model:
    """``sample`` (a written table): text, quality, calibrates (whether the row is for the
    calibration) and digest. ``known``: of each label all rows and those for the calibration.
    """
    rows = sum(n for n, _ in known.values())
    unknown = Model(b"", b"", (0.0, known.get(1, (0, 0))[0] / rows if rows else 0.5))
    made = dictionaries(sample.where("not calibrates"))
    if len(made) < 2:
        return unknown
    model = Model(made[1], made[0], (0.0, 0.0))
    later = sample.where("calibrates").mapInArrow(_differences(model), "quality int, digest string, x double").toPandas().sort_values(["quality", "digest"], kind="stable")
    label = later["quality"].to_numpy()
    if len({*label}) < 2:
        return unknown
    often = np.array([known[k][1] / (label == k).sum() for k in (0, 1)])[label]
    return Model(model.good, model.bad, tuple(map(float, logistic(later[["x"]].to_numpy(), label.astype(float), often))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string")), F.lit(4)) == 2, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model from labelled rows whose crc32(doc_id) mod 4 is not 2; those with 3 calibrate it."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(4))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").distinct()
    known = known.select("doc_id", "quality", rest.alias("rest"), F.md5(F.col("doc_id").cast("string")).alias("digest")).where("rest <> 2")
    chosen = known.where("quality = 1").orderBy("digest").limit(sample_rows).unionByName(known.where("quality = 0").orderBy("digest").limit(sample_rows))
    rows = materialize(chosen)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    eligible = texts.select("doc_id", F.md5("text").alias("text")).join(known, "doc_id").select("doc_id", "text", "quality", "rest").distinct()
    counts = eligible.groupBy("quality").agg(F.count(F.lit(1)), F.count_if(F.col("rest") == 3)).collect()
    sample = texts.join(F.broadcast(rows), "doc_id").dropDuplicates(["doc_id", "text", "quality"]).select("text", "quality", F.expr("rest = 3").alias("calibrates"), F.concat("digest", F.md5("text")).alias("digest"))
    return fit(materialize(sample), {k: (n, later) for k, n, later in counts})


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with quality_score (0 to 1)."""
    docs = without(docs, ["quality_score"])
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in portions(batches, "text"):
            scores = [scorer.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "quality_score"])

    return docs.mapInArrow(run, f"{', '.join(names)}, quality_score double")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``KEEP`` on) of every document."""
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learned(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP).cast("int").alias("predicted"))
