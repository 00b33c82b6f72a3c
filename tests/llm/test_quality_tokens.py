"""Classifier by held-out accuracy; encoder against tiktoken; histogram, sharding against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadweave.llm import bpe, quality, sharding, token_hist
from roadweave.llm.queries import CONTEXTS, op3_quality, op4_token_counts, op8_bpe, op10_sharding

PATH = P.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op3_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (crc(i) % 4 == 2) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q in labels.items() if crc(i) % 4 == 2]
    assert len(held) > 60 and sum(p == q for p, q in held) / len(held) >= 0.93


def test_scores_depend_on_text_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.learned(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model == quality.learned(docs.orderBy(F.desc("doc_id")), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(1, "The cat sat on the mat.", "x"), (2, "The cat sat on the mat.", "y"), (3, None, "z"), (4, "", "z"), (5, " \n", "z"), (6, "word " * 50_000, "z")]
    got = quality.scored(spark.createDataFrame(rows, DOCS + ", quality_score string"), model).collect()
    s = {r.doc_id: r.quality_score for r in got}
    assert s[1] == s[2] and s[3] == s[4] == s[5] and all(0 <= v <= 1 for v in s.values())


def test_held_out_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"good clean text number {i} about rivers and hills " * 5 if i % 2 else "### !! $$$ %% " * 20) for i in range(300)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.learned(docs, labels) == quality.learned(docs, turned)
    out = quality.classified(docs, labels).where("held_out").collect()
    assert all(r.predicted == r.doc_id % 2 for r in out)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classified(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (None, 1), (1, 7)], "doc_id long, quality int")
    assert {r.score for r in quality.classified(docs, odd).collect()} == {0.5}
    assert quality.classified(spark.createDataFrame([], DOCS), none).collect() == []


CODEC = bpe.Codec(PATH, P.PATTERN)
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


def test_decoding_reverses_the_byte_table():
    assert {i: bpe.unseen(t) for t, i in CODEC.tokenizer.get_vocab().items()} == {r: t for t, r in bpe.read_ranks(PATH).items()} == CODEC.tokens
    assert all(bpe.unseen(bpe.visible(bytes([b]))) == bytes([b]) for b in range(256))


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4")


def test_encoder_equals_tiktoken_on_documents(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert ids(r.text).tolist() == OWN.encode_ordinary(r.text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_tiktoken(text):
    got = ids(text)
    assert got.tolist() == OWN.encode_ordinary(text) and CODEC.decode(got) == text.encode()
    starts, ends = CODEC.offsets(text, got)
    assert all(CODEC.decode(got[i : i + 1]).decode("utf-8", "ignore") in text[a:b] for i, (a, b) in enumerate(zip(starts, ends, strict=True)))
    assert not len(got) or (starts[0] == 0 and ends[-1] == len(text) and (starts[1:] <= ends[:-1]).all())


def test_memory_bound_of_the_encoder(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "LONGEST", 4)
    own = bpe.Codec(PATH, P.PATTERN)
    for t in ("one two three four five", "six seven eight nine ten eleven", " ".join(map(str, range(100)))):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == OWN.encode_ordinary(t)


def test_encoding_frames(spark):
    rows = [(1, "Hello wörld 😀"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "a " * 100_000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("clash"))
    enc = bpe.encoded(df, PATH, P.PATTERN, offsets=True)
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decoded(enc, PATH, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in rows}
    for r in bpe.digested(df, PATH, P.PATTERN).collect():
        want = OWN.encode_ordinary(r.text or "")
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert op8_bpe(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.digested(spark.createDataFrame([], DOCS), PATH, P.PATTERN).collect() == []


def test_histogram_limits(spark, monkeypatch):
    monkeypatch.setattr(token_hist, "BLOCK", 5)
    rng = random.Random(1)
    lengths = [rng.randrange(30) for _ in range(500)]
    df = spark.createDataFrame([(n,) for n in lengths], "n_tokens long").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("documents"))
    got = {r.context_limit: r for r in token_hist.limits(df).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert (r.documents, r.documents_fitting, r.documents_cut) == (lengths.count(n), sum(x <= n for x in lengths), sum(x > n for x in lengths))
        assert (r.tokens_fitting, r.tokens_kept, r.tokens_total) == (sum(x for x in lengths if x <= n), sum(min(x, n) for x in lengths), sum(lengths))
    q = {r.share: r.n_tokens for r in token_hist.quantiles(token_hist.limits(df), [0.5, 1.0]).collect()}
    assert q == {0.5: sorted(lengths)[249], 1.0: max(lengths)}
    assert token_hist.limits(df.limit(0)).collect() == []
    asked = {r.context_limit: r for r in token_hist.limits(df, [3, 7, 1000]).collect()}
    assert set(asked) == {*lengths, 3, 7, 1000} and asked[1000].tokens_kept == sum(lengths) and asked[1000].documents == 0
    assert asked[7].tokens_kept == sum(min(x, 7) for x in lengths)
    assert [(r.context_limit, r.tokens_total, r.quantile) for r in token_hist.limits(df.limit(0), [5]).collect()] == [(5, 0, None)]


def test_histogram_counts_documents(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "one two")], DOCS)
    want = len(OWN.encode_ordinary("one two"))
    assert {tuple(r) for r in token_hist.histogram(docs, PATH, P.PATTERN).collect()} == {(0, 2), (want, 2)}


def test_token_query_equals_tiktoken(spark):
    """The query on whole texts against lengths counted with tiktoken; a very long text and clashing columns among them."""
    lengths = [len(OWN.encode_ordinary(r.text or "")) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.context_limit: r for r in op4_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {*lengths, *CONTEXTS}
    for n, r in got.items():
        assert (r.documents, r.documents_fitting, r.tokens_kept, r.tokens_total) == (lengths.count(n), sum(x <= n for x in lengths), sum(min(x, n) for x in lengths), sum(lengths))
    docs = spark.createDataFrame([(1, "word " * 60_000, 5), (1, "word " * 60_000, 5)], "doc_id long, text string, documents int").withColumn("n_tokens", F.lit("x"))
    assert [tuple(r) for r in token_hist.histogram(docs, PATH, P.PATTERN).collect()] == [(len(OWN.encode_ordinary("word " * 60_000)), 2)]


def walked(number, count, seed):
    """The Feistel network with cycle walking for one number, in plain integers."""
    full, half = 2**64 - 1, max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)

    def mixed(x, key):
        x = ((x ^ (key & full)) * 0x9E3779B97F4A7C15) & full
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    while True:
        left, right = number >> half, number & (1 << half) - 1
        for r in range(6):
            left, right = right, left ^ mixed(right, seed * 0x2545F4914F6CDD1D + r) & (1 << half) - 1
        number = left << half | right
        if number < count:
            return number


def test_sharding_query_equals_a_scalar_walk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    order = sorted(docs, key=lambda r: (r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()))
    want = {}
    for i, r in enumerate(order):
        image = walked(i, len(order), 1)
        want.setdefault((r.doc_id, len((r.text or "").encode()) + 1, crc32(r.text), "rows", image % 8, image // 8, None), 0)
    assert {tuple(r) for r in op10_sharding(spark, "/root/testdata/sf0.001").collect()} == set(want)


def crc32(text):
    return zlib.crc32((text or "").encode())


def test_sharding_of_a_very_long_text(spark):
    got = sharding.shard(spark.createDataFrame([(1, "é" * 400_000), (2, "a")], DOCS), 2).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(1, 800_001, crc32("é" * 400_000)), (2, 2, crc32("a"))}


def test_permutation_is_one():
    for n in (1, 2, 3, 8, 100, 1000, 4097):
        out = sharding.permuted(np.arange(n), n, 3)
        assert sorted(out.tolist()) == list(range(n))
        if n >= 100:
            assert out.tolist() != list(range(n)) and (sharding.permuted(np.arange(n), n, 4) != out).any()
    assert sharding.permuted(np.zeros(0, np.int64), 0, 1).tolist() == []


def test_shards_and_slots(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(60) if i % 9 else None, None if i % 7 == 0 else "é" * rng.randrange(5)) for i in range(203)]
    df = spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit("x"))
    got = sharding.shard(df, 8).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    key = lambda r: (r.doc_id is None, r.doc_id, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, sharding.shard(df.repartition(7), 8).collect())) == sorted(map(key, got))
    numbers = sorted(r.row_number for r in got)
    assert numbers == list(range(203))
    image = sharding.permuted(np.array([r.row_number for r in got]), 203, 1)
    assert all(r.shard == i % 8 and r.slot == i // 8 for r, i in zip(got, image.tolist(), strict=True))
    assert sharding.shard(spark.createDataFrame([], DOCS)).collect() == []


def test_share_of_good_rows_does_not_depend_on_the_bound(spark):
    """Labels that have nothing to do with the text, nine good ones to a bad one: the score is about 0.9 for any bound."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for i in range(1500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(1500)], "doc_id long, quality int")
    for bound in (100, 6000):
        scores = quality.scored(docs, quality.learned(docs, labels, bound)).where(quality.held_out(F.col("doc_id")))
        assert abs(scores.agg(F.avg("quality_score")).first()[0] - 0.9) < 0.1


def test_fit_sees_whole_texts(spark):
    """What tells good from bad comes after the first 20,000 characters."""
    rng = random.Random(6)
    text = lambda k: "one and the same start " * 900 + " ".join(f"{'good' if k else 'bad'}{rng.randrange(200)}" for _ in range(2000))
    docs = spark.createDataFrame([(i, text(i % 2)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    scores = quality.scored(docs, quality.learned(docs, labels)).groupBy((F.col("doc_id") % 2).alias("k")).agg(F.avg("quality_score").alias("s")).collect()
    means = {r.k: r.s for r in scores}
    assert means[1] - means[0] > 0.3


def test_dictionaries_of_several_tasks(spark, monkeypatch):
    """All windows of all texts reach a dictionary, however many tasks share them."""
    monkeypatch.setattr(quality, "CHUNK_BYTES", 20_000)
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(f"{'good' if i % 2 else 'bad'}{rng.randrange(300)}" for _ in range(300))) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 2, "doc_id long, quality int")
    model = quality.learned(docs, labels)
    assert model == quality.learned(docs.repartition(7), labels)
    got = quality.classified(docs.unionByName(docs), labels).where("held_out").collect()
    assert got and all(r.predicted == r.doc_id % 2 for r in got)


def test_query_equals_plain_zstandard(spark):
    """The query's scores from its two dictionaries, with zstandard and the logistic function alone; the fit by a fixed point."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learned(docs, labels)

    def difference(text):
        raw = (text or "").encode()
        raw = raw if raw.strip() else b" "
        sizes = []
        for d in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes.append(sum(len(c.compress(raw[i : i + 256])) for i in range(0, len(raw), 256)))
        return (sizes[1] - sizes[0]) / max(sizes)

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in op3_quality(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(texts)
    w, c = model.weights
    for i, t in texts.items():
        assert abs(got[i].score - 1 / (1 + math.exp(-(w * difference(t) + c)))) < 1e-9
    fit = {(r.doc_id, r.quality) for r in labels.collect() if r.quality in (0, 1) and r.doc_id in texts and texts[r.doc_id] is not None and crc(r.doc_id) % 4 == 3}
    slope = [0.0, 0.0]
    for i, y in fit:
        x = difference(texts[i])
        r = y - 1 / (1 + math.exp(-(w * x + c)))
        slope = [slope[0] + r * x, slope[1] + r]
    assert abs(slope[0] - 1e-3 * w) < 1e-6 and abs(slope[1] - 1e-3 * c) < 1e-6
