"""Operator 7: URL filters, given rules first, then association rules mined with FP-growth.

A URL's tokens are the parts of its host (``h:``), its path segments with digits as 0 (``p:``) and
the names in its query (``q:``), all of them. A rule is a combination of tokens that says block. It
needs ``least`` blocked URLs and the share ``support`` of all labelled ones, and the lower end of
the 95 % interval (Wilson) of the share of blocked URLs among those that have its tokens has to
reach ``confidence``. Of rules whose tokens include another rule's only the other stays.

Mining takes three steps, none of which brings URLs or rules to the driver. Tokens are counted and
those that are a rule by themselves are taken out: no larger combination adds to them. Tokens on
just the same labelled URLs become one item. Spark's FP-growth finds the combinations of these items,
of any number, among blocked URLs; a join on each combination's rarest token counts them among all
labelled URLs.

Matching is by inverted index: a rule lies under its rarest token, a URL looks up all its tokens.

Defined results: a null URL or one without ``://`` has an empty host and path, no tokens, no rule
and the verdict allow; very long URLs are taken whole; a given rule fits its host and all
subdomains where the path starts with its own; of those that fit, the longest (host and path
together) wins, block before allow at equal length. Pages without a label teach nothing; rows that
repeat a page_id each count, with block where any label of it says so. Without labelled pages
nothing is mined. An empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, small

RULE = "items array<string>, index string, confidence double, support double"


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; none without ``://``."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    marked = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    segments = F.split(F.regexp_replace(lower_ascii(path(url)), "[0-9]+", "0"), "/")
    names = F.transform(F.split(lower_ascii(query), "&"), lambda x: F.regexp_replace(x, r"(?s)=.*\z", ""))
    every = F.array_distinct(F.concat(marked("h:", F.split(host(url), r"[.-]")), marked("p:", segments), marked("q:", names)))
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), every).otherwise(F.array().cast("array<string>"))


def sure(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of Wilson's interval of the share hits / n."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mined(pages: DataFrame, labels: DataFrame, support: float = 0.0, confidence: float = 0.8, least: int = 20) -> DataFrame:
    """items, index, confidence (share of block among the URLs with the items) and support of the rules that say block.

    ``labels``: page_id, blocked.
    """
    votes = labels.where("page_id is not null and blocked is not null").groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    known = pages.select("page_id", tokens(F.col("url")).alias("tokens")).join(votes, "page_id").where(F.size("tokens") > 0)
    known = materialize(known.select("tokens", F.col("blocked").cast("int").alias("blocked"), F.expr("uuid()").alias("row")))
    n, bad = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    needed = max(least, support * n, 1)
    empty = known.sparkSession.createDataFrame([], RULE)
    if bad < needed:
        return empty
    flat = known.select("row", "blocked", F.explode("tokens").alias("token"))
    digest = lambda k: F.xxhash64(F.lit(k), "row")
    counts = flat.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("hits"), F.bit_xor(digest(1)).alias("x"), F.bit_xor(digest(2)).alias("y"))
    counts = materialize(counts.where(F.col("hits") >= needed))
    fits = sure(F.col("hits"), F.col("n")) >= confidence
    shape = lambda items, index: (items.alias("items"), index.alias("index"), (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / n).alias("support"))
    alone = counts.where(fits).groupBy("x", "y", "n", "hits").agg(F.min("token").alias("token")).select(*shape(F.array("token"), F.col("token")))
    items = materialize(counts.where(~fits).groupBy("x", "y", "n").agg(F.min("token").alias("token")).select("token", "n"))
    baskets = materialize(flat.where("blocked = 1").join(small(items.select("token")), "token").groupBy("row").agg(F.collect_list("token").alias("items")))
    if baskets.isEmpty():
        return materialize(alone)
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (needed - 0.5) / baskets.count()), minConfidence=1.0).fit(baskets).freqItemsets
    sets = materialize(sets.where(F.size("items") > 1).select(F.array_sort("items").alias("items")))
    # the rarest token of each combination, and how many labelled URLs have all its tokens
    rarest = sets.select("items", F.explode("items").alias("token")).join(small(items), "token").groupBy("items").agg(F.min(F.struct("n", "token")).alias("r")).select("items", F.col("r.token").alias("index"))
    held = known.select("blocked", "tokens", F.explode("tokens").alias("index")).join(small(materialize(rarest)), "index").where(F.size(F.array_except("items", "tokens")) == 0)
    several = held.groupBy("items", "index").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("hits")).where((F.col("hits") >= needed) & fits)
    rules = materialize(several.select(*shape(F.col("items"), F.col("index"))))
    # rules that include another one
    part = rules.select(F.col("items").alias("part"), F.col("index").alias("token"))
    wide = rules.select("items", F.explode("items").alias("token")).join(small(part), "token").where((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0)).select("items").distinct()
    return materialize(alone.unionByName(rules.join(wide, "items", "left_anti")))


class Matcher:
    """Given rules by host and path."""

    def __init__(self, given: Sequence[tuple[str, str]]):
        self.given: dict[str, dict[str, str]] = {}
        for verdict, text in given:
            name, slash, rest = text.partition("/")
            paths = self.given.setdefault(name.lower(), {})
            paths[slash + rest] = "block" if paths.get(slash + rest) == "block" else verdict
        self.lengths = {h: sorted({*map(len, paths)}, reverse=True) for h, paths in self.given.items()}

    def rule(self, name: str, way: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest given rule that fits."""
        best, parts = None, name.split(".")
        for i in range(len(parts)):
            suffix = ".".join(parts[i:])
            for n in self.lengths.get(suffix, ()):
                verdict = self.given[suffix].get(way[:n]) if n <= len(way) else None
                if verdict:
                    found = (len(suffix) + n, verdict == "block", verdict, suffix + way[:n])
                    best = found if best is None or found > best else best
                    break
        return best and best[2:]


def given_rules(pages: DataFrame, given: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, and verdict and rule of the given rules ((verdict, host and path) each), null where none fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(given)
        for b in batches:
            found = [matcher.rule(*x) or (None, None) for x in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v for v, _ in found], pa.string()), pa.array([r for _, r in found], pa.string())], names=[*b.schema.names, "verdict", "rule"])

    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host(url).alias("host"), path(url).alias("path"))
    return rows.mapInArrow(run, "page_id long, url string, host string, path string, verdict string, rule string")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls of ``urls`` that have all tokens of a rule of ``rules`` (a written table)."""
    looked = urls.select("url", tokens(F.col("url")).alias("tokens")).select("url", "tokens", F.explode("tokens").alias("index"))
    return looked.join(small(rules.select("items", "index")), "index").where(F.size(F.array_except("items", "tokens")) == 0).select("url").distinct()


def judged(pages: DataFrame, given: Sequence[tuple[str, str]], rules: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. ``rules``: of :func:`mined`."""
    rows = given_rules(pages, given)
    if rules is None or rules.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    blocked = small(materialize(matches(pages.select(F.col("url").cast("string").alias("url")), rules).withColumn("mined", F.lit("block"))))
    return rows.join(blocked, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "mined", F.lit("allow")).alias("verdict"))
