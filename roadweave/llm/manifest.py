"""Operator 13: a Merkle manifest of a dataset, with a proof for each row.

A row's leaf is the sha256 of its fields, each with its length. The leaves of a ``lang``, by doc_id,
are the bottom of a tree: every two neighbours become the digest of their hex texts, the last one
alone its own digest, until one node is left. These subroots, by lang, are the bottom of the last
tree, whose top is the root.

Blocks of ``2 ** bits`` neighbours are reduced to their tops in tasks, again and again, until no more
than ``most`` nodes of all trees are left. The driver builds the small upper trees on them and sends
each block its path to the root; the tasks find the blocks' inner nodes again and finish the proofs.
Where blocks had to be reduced more than once, the paths of the lower blocks are written and meet the
blocks by key instead. No group has more rows than a block, whatever a lang holds.

Defined results: nulls of any field are ``-`` in the leaf; a null lang has a tree of its own, the first
one; null doc_ids come first in their tree; rows of one doc_id are ordered by their leaves, and equal
rows have a leaf, a place and a proof each; very long texts are digested whole; an empty table gives
an empty table; ``carried`` columns pass through, others play no part.
"""

from __future__ import annotations

import hashlib
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, materialize, numbered, set_apart

#: 2 ** BITS leaves make a block; the driver holds MOST nodes and their paths.
BITS = 11
MOST = 1 << 14
#: What stands before a sibling in a proof: on which side it is, or that there is none.
LEFT, RIGHT, ALONE = b"L", b"R", b"-"


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def climbed(nodes: list[bytes], height: int) -> list[list[bytes]]:
    """The nodes and ``height`` levels above them."""
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest(b"".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def siblings(levels: list[list[bytes]], i: int) -> list[bytes]:
    """The proof of node i at the bottom, up to the last level."""
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append(ALONE if j >= len(level) else (RIGHT if j > i else LEFT) + level[j])
        i >>= 1
    return out


def height(n: int) -> int:
    """Levels above n nodes."""
    return (n - 1).bit_length()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    other = lambda e: F.substring(e, 2, 64)
    side = lambda e: F.substring(e, 1, 1)
    return F.reduce(proof, start, lambda x, e: F.sha2(F.when(side(e) == "L", F.concat(other(e), x)).when(side(e) == "R", F.concat(x, other(e))).otherwise(x), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda e: F.substring(e, 2, 64)), ""), 256)


def _sorted(block: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    """The block's rows in order, their nodes and the levels to its top."""
    block = block.take(pc.sort_indices(block, sort_keys=[("place", "ascending")]))
    return block, block.column("node").to_pylist(), min(block.column("bits")[0].as_py(), height(block.column("n")[0].as_py()))


def _blocks(nodes: DataFrame, bits: int):
    return nodes.withColumn("block", F.shiftright("place", bits)).withColumn("bits", F.lit(bits)).groupBy("tree", "block")


def reduced(nodes: DataFrame, bits: int) -> DataFrame:
    """The tops of all blocks of ``nodes`` (tree, place, n: nodes of the tree at this level, node), in the same form."""

    def run(block: pa.Table) -> pa.Table:
        ordered, below, levels = _sorted(block)
        top = climbed(below, levels)[-1]
        n = ordered.column("n")[0].as_py()
        return pa.table({"tree": ordered.column("tree")[:1], "place": ordered.column("block")[:1], "n": [max(1, -(-n // (1 << bits)))], "node": top})

    return _blocks(nodes.select("tree", "place", "n", "node"), bits).applyInArrow(run, "tree long, place long, n long, node binary")


def upper(nodes: list[tuple[int, int, bytes]]) -> tuple[bytes, dict[tuple[int, int], tuple[bytes, list[bytes]]]]:
    """The root, and for each node (tree, place, node) of the upper trees its subroot and its path to the root."""
    trees: dict[int, list[bytes]] = {}
    for tree, _, node in sorted(nodes):
        trees.setdefault(tree, []).append(node)
    inner = {tree: climbed(below, height(len(below))) for tree, below in trees.items()}
    top = climbed([levels[-1][0] for levels in inner.values()], height(len(inner)))
    paths = {}
    for k, (tree, levels) in enumerate(inner.items()):
        rest = siblings(top, k)
        for i in range(len(levels[0])):
            paths[tree, i] = (levels[-1][0], siblings(levels, i) + rest)
    return top[-1][0], paths


def _finish(nodes: DataFrame, bits: int, paths, extra: list[str]) -> DataFrame:
    """Proof and subroot of each node, from those of its block: a broadcast of :func:`upper`'s, or a table (tree, place, subroot, proof)."""
    schema = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in extra) + ", subroot binary, proof array<binary>"

    def finished(block: pa.Table, subroot: bytes, rest: list[bytes]) -> pa.Table:
        ordered, below, levels = _sorted(block)
        inner = climbed(below, levels)
        proofs = [siblings(inner, i) + rest for i in range(len(below))]
        out = ordered.select(extra)
        return out.append_column("subroot", pa.array([subroot] * len(below), pa.binary())).append_column("proof", pa.array(proofs, pa.list_(pa.binary())))

    def sent(block: pa.Table) -> pa.Table:
        return finished(block, *paths.value[block.column("tree")[0].as_py(), block.column("block")[0].as_py()])

    def met(block: pa.Table, path: pa.Table) -> pa.Table:
        return finished(block, path.column("subroot")[0].as_py(), path.column("proof")[0].as_py())

    blocks = _blocks(nodes, bits)
    if isinstance(paths, DataFrame):
        return blocks.cogroup(paths.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(met, schema)
    return blocks.applyInArrow(sent, schema)


def proofs(leaves: DataFrame, bits: int = BITS, most: int = MOST) -> DataFrame:
    """The rows of ``leaves`` (doc_id, lang, leaf in hex, others) with subroot, root and proof (``L``, ``R`` or ``-`` and a sibling)."""
    spark = leaves.sparkSession
    leaves, named = set_apart(leaves, ["doc_id", "lang", "leaf"])
    names = leaves.columns
    rows = numbered(leaves, [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    # the row number of a tree's first leaf names the tree and orders the trees
    key = F.coalesce(F.concat(F.lit(":"), F.col("lang")), F.lit("")).alias("_key")
    trees = materialize(rows.groupBy(key).agg(F.min("row_number").alias("tree"), F.count(F.lit(1)).alias("n")))
    rows = looked_up(rows.select("*", key), trees, "_key", F.col("row_number"))
    given = rows.select(*names, "tree", (F.col("row_number") - F.col("tree")).alias("place"), "n", F.col("leaf").cast("binary").alias("node"))
    stages = [given]
    split = None
    while True:
        tops = materialize(reduced(stages[-1], bits))
        stages.append(tops)
        if tops.count() <= most:
            break
        if split is None and tops.agg(F.max("n")).first()[0] == 1:
            # as many trees as nodes: from here on their subroots are the leaves of one tree
            split = len(stages)
            order = numbered(tops.select("tree", "node"), [F.col("tree")])
            stages.append(materialize(order.select(F.lit(0).cast("long").alias("tree"), F.col("row_number").alias("place"), F.lit(tops.count()).alias("n"), "node", F.col("tree").alias("from"))))
    root, found = upper([(r.tree, r.place, bytes(r.node)) for r in stages[-1].select("tree", "place", "node").collect()]) if not stages[-1].isEmpty() else (b"", {})
    paths = spark.sparkContext.broadcast(found)
    for k in range(len(stages) - 2, 0, -1):
        if split == k + 1:  # the nodes at k are the subroots that stage k + 1 took as leaves
            continue
        at = stages[k]
        known = _finish(at, bits, paths, ["from", "node"] if split == k else ["tree", "place"])
        paths = materialize(known.select(F.col("from").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("node").alias("subroot"), "proof") if split == k else known)
    out = _finish(given, bits, paths, names)
    return out.select(*[F.col(inner).alias(outer) for outer, inner in named.items()], F.col("subroot").cast("string").alias("subroot"), F.lit(root.decode()).alias("root"), F.col("proof").cast("array<string>").alias("proof"))


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None, bits: int = BITS, most: int = MOST) -> DataFrame:
    """doc_id, lang, leaf, the ``carried`` columns, subroot, root and proof of each row of ``docs`` (doc_id, source, lang, n_chars, text)."""
    one = leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    return proofs(materialize(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), one.alias("leaf"), *[c.alias(n) for n, c in (carried or {}).items()])), bits, most)


def audited(docs: DataFrame, bits: int = BITS, most: int = MOST) -> DataFrame:
    """The manifest of ``docs`` and what becomes of its proofs if n_chars of some rows is one more.

    A fixed rule: rows of which unsigned crc32(doc_id) is divisible by 7.
    """
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [*cols[:3], cols[3].cast("decimal(20,0)") + F.lit(1), cols[4]]
    changed = F.when((F.crc32(cols[0].cast("string")) % 7 == 0) & cols[3].isNotNull(), leaf(*more))
    found = manifest(docs, {"changed": changed}, bits, most).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) AS crc FROM documents),
l AS MATERIALIZED (
  SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF.format(n="(n_chars + 1)")} END AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM l
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, level, i // 2, n),
s AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, h FROM s
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 2, n),
e AS (
  SELECT l.lang, l.i, u.level AS k, CASE WHEN v.h IS NULL THEN '-' WHEN v.i < u.i THEN 'L' || v.h ELSE 'R' || v.h END AS e
  FROM l JOIN up u ON l.lang IS NOT DISTINCT FROM u.lang AND u.n > 1 AND u.i = l.i >> u.level
  LEFT JOIN up v ON v.lang IS NOT DISTINCT FROM u.lang AND v.level = u.level AND v.i = xor(u.i, 1)
  UNION ALL
  SELECT l.lang, l.i, 100 + u.level, CASE WHEN v.h IS NULL THEN '-' WHEN v.i < u.i THEN 'L' || v.h ELSE 'R' || v.h END
  FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN top u ON u.n > 1 AND u.i = s.i >> u.level
  LEFT JOIN top v ON v.level = u.level AND v.i = xor(u.i, 1)),
p AS (SELECT lang, i, list(e ORDER BY k) AS es FROM e GROUP BY lang, i),
f AS (
  SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
    sha256(array_to_string(list_transform(coalesce(es, []), lambda x: x[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(changed, leaf), coalesce(es, [])),
      lambda x, y: sha256(CASE WHEN y[1] = 'L' THEN y[2:] || x WHEN y[1] = 'R' THEN x || y[2:] ELSE x END)) AS folded_root
  FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i)
SELECT *, folded_root = root AS verified FROM f
"""
