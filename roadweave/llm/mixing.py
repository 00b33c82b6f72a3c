"""Operator 1: mixing sources to target weights, in DataFrame functions only.

Each source gets a share of all words. Its documents are drawn by Efraimidis and Spirakis'
exponential keys: with ``u`` uniform from a digest of the document and ``w`` its quality weight,
documents are taken by ascending ``-ln(u) / w`` until their sizes fill the target. A target
larger than the source takes whole epochs first and draws only the rest.

No source is ever sorted as a whole. Keys fall into buckets of equal width in ``ln(key)``; there
one bucket of a source holds at most 0.37 / 1024 of its documents whatever their weights are (the
density of a Gumbel variable). The bucket where the target is reached is divided once more, and
only the part where it is reached is ordered: 0.37 / 1024 / 4096 of a source or so.

Defined results: a null text has size 0; a very long one counts whole; null is a source of its own
and comes last; rows that repeat a doc_id with its text share one key and are taken or left
together; equal keys go by their digests; an empty table gives an empty table; other columns pass
through whatever their names are, those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, set_apart, small, without, words

#: Buckets per unit of ln(key).
BUCKETS = 1024
#: Parts of the bucket where a target is reached.
PARTS = 4096
OUTPUTS = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]


def distinct_word_weight(word_list: Column) -> Column:
    """Quality weight: the share of different words among all, 1 without words."""
    n = F.size(word_list)
    return F.when(n > 0, F.size(F.array_distinct(word_list)) / n).otherwise(F.lit(1.0))


def keyed(docs: DataFrame, seed: str, weight: Column | None) -> DataFrame:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))
    u = (F.conv(F.substring("_mix_md5", 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    weight = distinct_word_weight(F.col("_mix_words")) if weight is None else weight
    return (
        docs.withColumns({"_mix_words": words(F.col("text")), "_mix_md5": digest})
        .withColumns({"_mix_size": F.size("_mix_words").cast("long"), "_mix_key": -F.log(u) / weight})
        .withColumn("_mix_bucket", F.floor(F.log("_mix_key") * BUCKETS))
        .drop("_mix_words")
    )


def targets(sizes: DataFrame, ratios: Sequence[int], max_epochs: int) -> DataFrame:
    """Target of each source. ``sizes``: one row (source, source_size) for each source.

    Sources by code point take ``ratios`` in turn. All words are shared by these weights; no
    target exceeds ``max_epochs`` times its source, and the excess goes to the others by weight.
    The sources are ordered by the fill level at which they reach their bound; running sums give
    the level at which the rest meets. These windows span one row a source, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("bound_level", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ratio = F.element_at(F.array(*[F.lit(float(x)) for x in ratios]), (F.pmod(F.col("rank"), F.lit(len(ratios))) + 1).cast("int"))
    return (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("ratio", ratio)
        .withColumn("bound", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("bound_level", F.col("bound") / F.col("ratio"))
        .withColumns({"left": F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)), "ratio_left": F.sum("ratio").over(everything) - F.coalesce(F.sum("ratio").over(before), F.lit(0.0))})
        .withColumn("level", F.when(F.col("bound") >= F.col("left") / F.col("ratio_left") * F.col("ratio"), F.col("left") / F.col("ratio_left")))
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("bound"), F.col("ratio") * F.coalesce(F.col("level"), F.lit(0.0))))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select("source", "source_size", "target", "epochs", "rest")
    )


def reached(sums: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, place, before and rest: where the running words of ``sums`` (source, place, words) reach ``wanted`` (source, rest)."""
    running = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    h, w = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).alias("h"), wanted.alias("w")
    found = h.join(w, F.col("h.source").eqNullSafe(F.col("w.source"))).where((F.col("before") < F.col("rest")) & (F.col("words") > 0))
    return found.groupBy("h.source").agg(F.max(F.struct("place", "before", "rest")).alias("e")).select("source", "e.*")


def cuts(keys: DataFrame, ratios: Sequence[int], max_epochs: int) -> DataFrame:
    """For each source its target, epochs and the last key that the drawn part takes."""
    histogram = materialize(keys.groupBy("source", F.col("_mix_bucket").alias("place")).agg(F.sum("_mix_size").alias("words")))
    plan = materialize(targets(histogram.groupBy("source").agg(F.sum("words").alias("source_size")), ratios, max_epochs))
    edge = materialize(reached(histogram, small(plan.select("source", "rest"))))
    k, e = keys.alias("k"), small(edge).alias("e")
    # the bucket where the target is reached, in parts, and then that part
    part = F.floor((F.log("_mix_key") * BUCKETS - F.col("place")) * PARTS)
    inside = k.join(e, F.col("k.source").eqNullSafe(F.col("e.source")) & (F.col("k._mix_bucket") == F.col("e.place")))
    inside = materialize(inside.groupBy("k.source", "_mix_key", "_mix_md5", part.alias("part")).agg(F.sum("_mix_size").alias("words"), F.max(F.col("rest") - F.col("before")).alias("rest")))
    fine = materialize(reached(inside.select("source", F.col("part").alias("place"), "words").groupBy("source", "place").agg(F.sum("words").alias("words")), inside.groupBy("source").agg(F.max("rest").alias("rest"))))
    i, f = inside.drop("rest").alias("i"), small(fine).alias("f")
    near = i.join(f, F.col("i.source").eqNullSafe(F.col("f.source"))).select("i.*", "place", "before", "rest")
    within = Window.partitionBy("source").orderBy("_mix_key", "_mix_md5").rowsBetween(Window.unboundedPreceding, -1)
    last = near.where("part = place").withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(within), F.lit(0))).where("before + words / 2 <= rest")
    last = last.unionByName(near.where("part < place")).groupBy("source").agg(F.max(F.struct("_mix_key", "_mix_md5")).alias("last"))
    e, last, p = edge.alias("e"), last.alias("l"), plan.alias("p")
    return materialize(
        p.join(e, F.col("p.source").eqNullSafe(F.col("e.source")), "left")
        .join(last, F.col("p.source").eqNullSafe(F.col("l.source")), "left")
        .select(
            F.col("p.source").alias("_cut_source"), *[F.col(c).alias(f"_cut_{c}") for c in ("source_size", "target", "epochs")], F.col("e.place").alias("_cut_edge_bucket"), F.col("last._mix_key").alias("_cut_last_key"), F.col("last._mix_md5").alias("_cut_last_md5")
        )
    )


def mix(docs: DataFrame, ratios: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", weight: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with mix_size, mix_source_size, mix_target and mix_copies.

    ``mix_copies`` is how often the mix takes the document. ``weight``: the quality weight, an
    expression over docs above 0; by default the share of different words. ``columns``: those of
    docs to return (all by default); without text the keys are written once and the texts are
    read a single time.
    """
    docs = without(docs, OUTPUTS)
    columns = list(docs.columns if columns is None else columns)
    if weight is not None:
        weighed = fresh(docs.columns, "_mix_weight")
        docs, weight = docs.withColumn(weighed, weight), weighed
    docs, names = set_apart(docs, ["doc_id", "text", "source"])
    rows = keyed(docs, seed, None if weight is None else F.col(names[weight]))
    apart = [names[c] for c in columns if c not in ("doc_id", "text", "source")]
    keys = materialize(rows.select(*apart, "doc_id", "source", "_mix_size", "_mix_key", "_mix_md5", "_mix_bucket"))
    cut = small(cuts(keys.select("source", "_mix_size", "_mix_key", "_mix_md5", "_mix_bucket"), ratios, max_epochs))
    edge = F.col("_cut_edge_bucket")
    drawn = (F.col("_mix_bucket") < edge) | ((F.col("_mix_bucket") == edge) & F.coalesce(F.struct("_mix_key", "_mix_md5") <= F.struct("_cut_last_key", "_cut_last_md5"), F.lit(False)))
    rows = (rows if "text" in columns else keys).join(cut, F.col("source").eqNullSafe(F.col("_cut_source")))
    return rows.select(
        *[F.col(names[c]).alias(c) for c in columns],
        F.col("_mix_size").alias("mix_size"),
        F.col("_cut_source_size").alias("mix_source_size"),
        F.col("_cut_target").alias("mix_target"),
        (F.col("_cut_epochs") + F.when(F.coalesce(drawn, F.lit(False)), 1).otherwise(0)).cast("int").alias("mix_copies"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, without the columns that ``mix`` added."""
    copy = fresh(mixed.columns, "_copy")
    return mixed.where("mix_copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).drop(copy, *OUTPUTS)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS m
  FROM documents),
k AS (
  SELECT doc_id, source, len(ws)::BIGINT AS size, m,
         -ln((CAST('0x' || substr(m, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
         / (CASE WHEN len(ws) > 0 THEN len(list_distinct(ws))::DOUBLE / len(ws)::DOUBLE ELSE 1.0::DOUBLE END) AS key
  FROM d),
s AS (
  SELECT source, sum(size)::DOUBLE AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS r
  FROM k GROUP BY source),
w AS (SELECT *, (CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS ratio, 3 * n AS bound FROM s),
f AS (
  SELECT *, sum(n) OVER () - coalesce(sum(bound) OVER (ORDER BY bound / ratio, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_n,
         sum(ratio) OVER () - coalesce(sum(ratio) OVER (ORDER BY bound / ratio, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
  FROM w),
g AS (SELECT *, max(CASE WHEN bound >= rest_n / rest_w * ratio THEN rest_n / rest_w END) OVER () AS level FROM f),
t AS (
  SELECT source, n, least(bound, ratio * coalesce(level, 0)) AS target,
         CASE WHEN n > 0 THEN floor(least(bound, ratio * coalesce(level, 0)) / n) ELSE 0 END AS epochs
  FROM g),
u AS (SELECT source, key, m, sum(size) AS n FROM k GROUP BY source, key, m),
o AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY key, m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM u)
SELECT k.doc_id, k.size, t.n::BIGINT AS source_size, t.target,
       (k.size * (t.epochs + CASE WHEN t.target - t.epochs * t.n > 0 AND o.before + o.n / 2.0 <= t.target - t.epochs * t.n THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
JOIN o ON k.source IS NOT DISTINCT FROM o.source AND k.key = o.key AND k.m = o.m
"""
