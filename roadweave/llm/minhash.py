"""Operator 2: near-duplicate documents by min-max hashing.

Each of ``permutations`` hash functions is evaluated once a shingle and gives two signature
values, the least and the greatest (Ji et al., Min-Max Hash for Jaccard Similarity, 2013). Bands
of ``rows`` minima or maxima are looked up; with 32 bands of 5 values a pair of similarity 0.8 is
missed with probability (1 - 0.8^5)^32 = 3e-6, a more similar pair less often.

Texts with equal words are one class, whatever their number; classes are the nodes that are linked. In each bucket the pairs (member,
least member) are candidates; those whose signature bytes agree too rarely for the threshold (four
and a half standard deviations) fall, the others are confirmed on full shingle sets. Confirmed
pairs make parts. A bucket with one part is done, which is what a bucket of copies comes to: it
costs its size, not its square. In a bucket of several parts the signature bytes of all members
outside its largest part are compared with those of all others of about their size, in blocks, and
a spanning forest of the likely pairs leaves a task. All likely pairs make groups of parts; in a
group of several parts all members outside its largest part are compared with all others in the
same way, but exactly. So a pair of similarity 0.8 counts unless the two share no bucket, or their
signature bytes agree too rarely.

Defined results: texts without words, null texts and rows without doc_id link with nothing and
are kept; all texts of a doc_id are compared and share its component; an empty table gives an empty
table; other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, looked_up, materialize, numbered, portions, small
from .components import connected_components, forest_roots
from .shingles import mix64, shingle_sets

#: Shingles of a text that are hashed at once; shingles and members of a block of exact comparisons.
CHUNK = 4096
COLUMNS = 8192
MEMBERS = 512
#: Bytes of compressed texts on a side of such a block.
MEMBER_BYTES = 8 << 20


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 2**63, n, dtype=np.uint64)[:, None], rng.integers(1, 2**62, n, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minima of all functions, then maxima."""
    low = high = None
    for a in range(0, len(shingles), CHUNK):
        x = (shingles[None, a : a + CHUNK] ^ functions[0]) * functions[1]
        lo, hi = x.min(axis=1), x.max(axis=1)
        low = lo if low is None else np.minimum(low, lo)
        high = hi if high is None else np.maximum(high, hi)
    return np.concatenate((low, high))


def digest_of(text: bytes) -> bytes:
    """Of the words in order, A-Z as a-z."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    parts = mix64(sig).reshape(-1, rows)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = mix64((key ^ parts[:, k]) * np.uint64(0xD6E8FEB86659FD93))
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int, permutations: int, rows: int) -> DataFrame:
    """doc_id, mark (md5 of the text), digest of the words, n_shingles, sketch (a byte of each value) and band keys."""
    functions = _functions(permutations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            digests, counts, sketches, bands = [], [], [], []
            for t, s in zip(texts, shingle_sets(texts, width), strict=True):
                digests.append(digest_of(t))
                counts.append(len(s))
                if len(s):
                    sig = signature(s, functions)
                    sketches.append((mix64(sig) & np.uint64(255)).astype(np.uint8).tobytes())
                    bands.append(band_keys(sig, rows))
                else:
                    sketches.append(b"")
                    bands.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("mark"), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "digest", "n_shingles", "sketch", "bands"],
            )
        pa.default_memory_pool().release_unused()  # a worker process lives on for other tasks

    return docs.select(F.col("doc_id").cast("long"), "text", F.md5("text").alias("mark")).mapInArrow(run, "doc_id long, mark string, digest binary, n_shingles long, sketch binary, bands array<long>")


def least_agreement(threshold: float, values: int) -> float:
    """Least share of equal sketch bytes with which a pair may be this similar."""
    return threshold - 4.5 * (threshold * (1 - threshold) / values) ** 0.5


def likely(pairs: DataFrame, sketches: DataFrame, threshold: float, permutations: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree as pairs of at least this similarity would."""
    values = 2 * permutations
    floor = least_agreement(threshold, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, values) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= floor))

    x, y = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and compressed text of the documents (doc_id, digest) in ``wanted`` (node, doc_id, digest), a written table.

    Few wanted ones go to all tasks and other texts are left where they are; many meet the
    compressed texts in a shuffle.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for b in portions(batches, "text"):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(digest_of, texts), pa.binary()), pa.array(map(packer.compress, texts), pa.binary())], names=["doc_id", "digest", "packed"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    if wanted.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    found = docs.mapInArrow(pack, "doc_id long, digest binary, packed binary").join(wanted, ["doc_id", "digest"])
    return found.dropDuplicates(["node"]).select("node", "packed")


def confirmed(pairs: DataFrame, packed: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        known: dict[int, np.ndarray] = {}
        for batch in portions(batches, "y"):
            a = batch.column("a").to_pylist()
            px, py = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            known = {k: known[k] for k in {*a} if k in known}
            new = {k: p for k, p in zip(a, px, strict=True) if k not in known}
            known |= dict(zip(new, shingle_sets(map(reader.decompress, new.values()), width), strict=True))
            held = []
            for k, s in zip(a, shingle_sets(map(reader.decompress, py), width), strict=True):
                both = len(np.intersect1d(known[k], s, assume_unique=True))
                held.append(100 * both >= percent * (len(known[k]) + len(s) - both))
            yield batch.select(["a", "b"]).filter(pa.array(held, pa.bool_()))

    x, y = packed.select(F.col("node").alias("a"), F.col("packed").alias("x")), packed.select(F.col("node").alias("b"), F.col("packed").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of 0/1 matrices over the shared shingles."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(often > 1) - 1
    shared = often[column] > 1
    of, column = of[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (lo, lo + COLUMNS)))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[of[part], column[part] - lo] = 1
        out += (m @ m.T).astype(np.int64)  # a block's products are whole numbers that float32 holds
    return out


def _group_links(width: int, percent: int):
    """Spanning forest of the exact links between parts within a group (or a pair of its blocks)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        reader = zstandard.ZstdDecompressor()
        group = group.group_by("rep").aggregate([("part", "min"), ("packed", "min")]) if group.num_rows > 1 else group.rename_columns({"part": "part_min", "packed": "packed_min"})
        ids, parts = group.column("rep").to_numpy(), group.column("part_min").to_numpy()
        sets = list(shingle_sets(map(reader.decompress, group.column("packed_min").to_pylist()), width))
        n = np.array([len(s) for s in sets])
        both = common_counts(sets)
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        linked &= parts[:, None] != parts[None, :]
        touched = np.flatnonzero(linked.any(axis=1))
        roots = forest_roots(linked[np.ix_(touched, touched)])
        ids = ids[touched]
        keep = roots != np.arange(len(roots))
        return pa.table({"a": pa.array(ids[roots][keep], pa.int64()), "b": pa.array(ids[keep], pa.int64())})

    return run


def blocks_across(groups: DataFrame) -> DataFrame:
    """whole, i, j, rep and part: the blocks (whole, i, j) in which members of different parts meet.

    ``groups``: rep, part, whole (the group) and weight (bytes of what a member brings). Members of a
    group's largest part meet the others only, in blocks of about ``MEMBERS`` by ``MEMBERS`` members and
    ``MEMBER_BYTES`` on a side: the largest part costs its size times that of the rest.
    """
    sizes = groups.groupBy("whole", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    totals = sizes.groupBy("whole").agg(F.sum("n").alias("all"), F.sum("weight").alias("weight"), F.max(F.struct("n", "part", "weight")).alias("top")).where(F.col("all") > F.col("top.n"))
    blocks = lambda n, weight: F.least(n, F.ceil(F.greatest(n / F.lit(MEMBERS), weight / F.lit(MEMBER_BYTES)))).cast("int")
    totals = materialize(
        totals.select("whole", F.col("top.part").alias("top"), blocks(F.col("all"), F.col("weight")).alias("columns"), blocks(F.col("all") - F.col("top.n"), F.col("weight") - F.col("top.weight")).alias("lines"))
    )
    rows = groups.join(small(totals), "whole")
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    as_column = rows.select("*", place(F.col("columns")).alias("j"), F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("i"))
    as_line = rows.where("part <> top and columns > 1").select("*", place(F.col("lines")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"))
    return as_column.unionByName(as_line).select("whole", "i", "j", "rep", "part")


def crowds(entries: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """whole, rep, part and weight (0) of the members of buckets that hold several parts.

    ``entries``: rep, n_shingles and key (the bucket). A pair of the threshold's similarity has sizes
    within its ratio, so that a bucket is split by size: a member is in the class of its size and in
    the next one, and such a pair meets in one of them. Buckets of the same members count once.
    """
    size = F.floor(F.log(F.col("n_shingles")) / math.log(100.1 / percent)).cast("int")
    held = entries.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("part"), "key", F.explode(F.array(size, size + 1)).alias("size"))
    held = materialize(held)
    same = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")]
    several = held.groupBy("key", "size").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), *same).where("lo <> hi")
    several = several.groupBy("n", "x", "y").agg(F.min(F.struct("key", "size")).alias("one")).select("one.key", "one.size")
    return held.join(small(materialize(several)), ["key", "size"]).select(F.xxhash64("key", "size").alias("whole"), "rep", "part", F.lit(0).alias("weight"))


def likely_across(groups: DataFrame, sketches: DataFrame, threshold: float, permutations: int) -> DataFrame:
    """Edges (a, b) that join all documents of different parts within each group whose sketches agree as in ``likely``."""
    values = 2 * permutations
    floor = least_agreement(threshold, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for members in batch.column("members"):
                rows = members.values
                ids, parts = rows.field("rep").to_numpy(), rows.field("part").to_numpy()
                sketch = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(-1, values).T.copy()
                agree = np.zeros((len(ids), len(ids)), np.uint16)
                for v in sketch:
                    agree += v[:, None] == v[None, :]
                linked = (agree >= floor * values) & (parts[:, None] != parts[None, :])
                touched = np.flatnonzero(linked.any(axis=1))
                roots = forest_roots(linked[np.ix_(touched, touched)])
                keep = roots != np.arange(len(roots))
                a.append(ids[touched][roots][keep])
                b.append(ids[touched][keep])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    dealt = blocks_across(groups).join(sketches.withColumnRenamed("node", "rep"), "rep")
    blocks = dealt.groupBy("whole", "i", "j").agg(F.collect_list(F.struct("rep", "part", "sketch")).alias("members"))
    return blocks.select("members").mapInArrow(run, "a long, b long").distinct()


def links_across(groups: DataFrame, packed: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) that join all linked documents of different parts within each group (see ``blocks_across``).

    Sets are compared exactly; what comes out is linear in the members.
    """
    dealt = blocks_across(groups).join(packed.withColumnRenamed("node", "rep"), "rep")
    return dealt.groupBy("whole", "i", "j").applyInArrow(_group_links(width, percent), "a long, b long")


def text_groups(docs: DataFrame, width: int, percent: int, permutations: int, rows: int, same_ids: bool) -> DataFrame:
    """doc_id, mark (md5 of the text), n_shingles, rep, own, head and leads of each row of ``docs``.

    Nodes are classes of texts with equal words, numbered (rep) in the order of their least doc_ids (own).
    ``same_ids``: classes that share a doc_id are connected. head is the least doc_id of the component;
    leads says whether the row's class is that with the component's least number. Rows without words or
    doc_id have no class.
    """
    if permutations % rows:
        raise ValueError("bands hold minima or maxima only: rows has to divide permutations")
    sigs = materialize(signatures(docs, width, permutations, rows))
    classes = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("own"))
    classes = materialize(numbered(classes, [F.col("own"), F.col("digest")]).withColumnRenamed("row_number", "rep"))
    members = looked_up(sigs.select("doc_id", "mark", "digest", "n_shingles"), classes, "digest", F.struct("doc_id", "mark"))
    members = materialize(members.select("doc_id", "mark", "n_shingles", *[F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("rep", "own")]))
    reps = sigs.join(classes.select("digest", F.col("own").alias("doc_id"), F.col("rep").alias("node")), ["doc_id", "digest"])
    reps = materialize(reps.select("node", "doc_id", "digest", "n_shingles", "sketch", "bands").dropDuplicates(["node"]))
    entries = reps.select(F.col("node").alias("rep"), "n_shingles", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first")).where("n > 1")
    pairs = entries.join(shared, "key").where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = materialize(likely(pairs, reps.select("node", "sketch"), percent / 100, permutations))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    packed = materialize(packed_texts(docs, materialize(reps.select("node", "doc_id", "digest").join(ends, "node", "left_semi"))))
    links = confirmed(pairs, packed, width, percent)
    if same_ids:
        several = members.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
        links = links.unionByName(members.join(small(materialize(several)), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")))
    parts = materialize(connected_components(links))

    # what shares a bucket of several parts, but is like its least member in none
    crowded = materialize(crowds(entries.join(shared.where("n > 2").select("key"), "key"), parts, percent))
    rest = materialize(likely_across(crowded, reps.select("node", "sketch"), percent / 100, permutations))
    pairs = pairs.unionByName(rest)
    late = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(ends, "node", "left_anti")
    late = materialize(reps.select("node", "doc_id", "digest").join(late, "node", "left_semi"))
    if not late.isEmpty():
        packed = packed.unionByName(materialize(packed_texts(docs, late)))

    # groups of parts that candidate pairs connect; what the links joined is one node from here on
    of = lambda end: parts.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    contracted = lambda edges: edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    wholes = materialize(connected_components(contracted(pairs))).select(F.col("id").alias("part"), F.col("component").alias("whole"))
    groups = packed.select(F.col("node").alias("rep"), F.octet_length("packed").cast("long").alias("weight")).join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    groups = materialize(groups.select("rep", "weight", F.coalesce("component", "rep").alias("part")).join(wholes, "part"))
    joined = connected_components(contracted(links_across(groups, packed, width, percent))).select(F.col("id").alias("part"), F.col("component").alias("joined"))
    # each linked class with the least number of its component, and that one's doc_id
    linked = parts.select(F.col("id").alias("rep"), F.col("component").alias("part")).join(joined, "part", "left").select("rep", F.coalesce("joined", "part").alias("lead"))
    linked = materialize(linked.unionByName(joined.join(parts.select(F.col("id").alias("part")), "part", "left_anti").select(F.col("part").alias("rep"), F.col("joined").alias("lead"))))
    heads = materialize(classes.select(F.col("rep").alias("lead"), F.col("own").alias("head")).join(linked.where("rep = lead").select("lead"), "lead", "left_semi"))
    linked = materialize(looked_up(linked, heads, "lead", F.col("rep")))
    found = looked_up(members, linked, "rep", F.col("doc_id"))
    return found.select("doc_id", "mark", "n_shingles", "rep", "own", F.coalesce("head", "own").alias("head"), F.coalesce(F.col("rep") == F.col("lead"), F.lit(True)).alias("leads"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = 80, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text).

    Two documents are linked if their sets of ``width``-word shingles (A-Z as a-z) have a Jaccard
    similarity of at least ``percent`` / 100. component_id is the least doc_id reachable.
    """
    found = text_groups(docs, width, percent, permutations, rows, same_ids=True)
    return found.select("doc_id", "n_shingles", F.coalesce("head", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def repeats(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = 80, rows: int = 5) -> DataFrame:
    """doc_id and mark (md5 of the text) of the texts of ``docs`` that near-duplicates of a kept one repeat.

    Links are those of texts: a second text of a doc_id has a component of its own, if it isn't linked
    with the first. Of each component the class of texts with the least doc_id stays, and of that class
    the row of this doc_id with the least mark.
    """
    found = materialize(text_groups(docs, width, percent, permutations, rows, same_ids=False).where("rep is not null"))
    several = found.where("leads and doc_id = own").groupBy("rep").agg(F.min("mark").alias("least"), F.max("mark").alias("greatest")).where("least <> greatest").select("rep", "least")
    other = found.where("leads and doc_id = own").join(small(materialize(several)), "rep").where("mark <> least")
    return found.where("not leads or doc_id <> own").select("doc_id", "mark").unionByName(other.select("doc_id", "mark")).distinct()


SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
         WHEN len(w) = 1 THEN w ELSE [] END) AS g
  FROM d),
x AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.v)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = s.doc_id
"""
