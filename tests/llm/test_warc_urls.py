"""WARC round trips and URL rules against plain Python."""

import hashlib
import math
import random
import re
import struct
import time
from itertools import combinations

import pytest
import zstandard
from pyspark.sql import functions as F

from roadweave.llm import common, urlfilter, warc
from roadweave.llm.common import scratch_dir
from roadweave.llm.queries import op7_url_filter

PAGES = "page_id long, url string, html string"


def test_round_trip(spark):
    rng = random.Random(1)
    body = "<p>" + "text ü " * 200
    rows = [(i, f"http://x/{i}", body if i % 3 == 0 else "".join(rng.choice("ab <>\r\n") for _ in range(rng.randrange(3000)))) for i in range(60)]
    rows += [(100, None, None), (101, "u r\nl", ""), (102, "http://x", "small"), (103, "http://x", "small"), (None, "n", body), (104, "l", "x" * 300_000)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    last = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 1000 and i is not None:
            last[h] = max(i, last.get(h, -1))
    for i, _, h in rows:
        h = (h or "").encode()
        r = by[i]
        revisit = len(h) >= 1000 and last.get(h) not in (None, i)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None)


def test_reading_takes_time_in_proportion():
    """A full archive of small records; reading it again and again would take minutes."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    records = [warc.record(i, f"http://x/{i}", " ".join(rng.choices(words, k=400)).encode(), "00" * 20, None) for i in range(24_000)]
    records[7] = warc.record(7, None, rng.randbytes(3 << 20), "00" * 20, None)
    data = warc.archive(records)
    began = time.process_time()
    assert list(warc.records_of(data)) == records
    assert sum(map(len, records)) > 60 << 20 and time.process_time() - began < 6
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.records_of(data[:-5]))


def test_archives_hold_dictionary_records_and_payloads(spark):
    rows = [(i, f"http://x/{i}", f"<html><body>page {i} of many that look alike</body></html>" * 3) for i in range(300)]
    folder = scratch_dir(spark) + "-w"
    files = warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), folder).collect()
    assert [(f.file, f.records) for f in files] == [("part-000000-0000.warc.zst", 300)]
    data = spark.read.format("binaryFile").load(folder).select("content").first()[0]
    magic, n = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC and n > 0
    at = 8 + n
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8:at]))).decompressobj().decompress(bytes(data[at:]))
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and one.endswith(b"\r\n\r\n")
    read = warc.read(spark, folder).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in read} == {(i, h) for i, _, h in rows}


def test_small_archives_and_empty_tables(spark):
    for records in ([b""], [b"a"], [b"abcdefgh" * 3], [bytes([i % 256]) * 50 for i in range(20)]):
        assert list(warc.records_of(warc.archive(records))) == records
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_several_archives_a_task(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    folder = scratch_dir(spark) + "-w"
    files = warc.write(spark.createDataFrame([(i, "u", "x" * 500) for i in range(20)], PAGES).coalesce(1), folder)
    assert files.count() > 3 and warc.read(spark, folder).count() == 20


def test_folder_without_a_scheme(spark, tmp_path):
    """Writer and reader resolve a plain path alike, through the session's default file system."""
    folder = str(tmp_path / "archives")
    warc.write(spark.createDataFrame([(i, "u", "x" * 500) for i in range(20)], PAGES), folder).count()
    assert warc.read(spark, folder).count() == 20 and warc.qualified(spark, folder).startswith("file:///")


def test_many_copies_meet_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "small", lambda df: df)
    rows = [(i, f"u{i}", "x" * 1000 if i % 3 else "y" * 2000) for i in range(90)] + [(None, "u", "z" * 1500)] * 2
    got = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 92 and {(r.page_id, r.refers_to) for r in got} == {(i, None if i in (87, 89) else 89 if i % 3 else 87) for i in range(90)} | {(None, None)}


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def plain_rule(host, path):
    fits = [(len(t), v == "block", v, t) for v, t in RULES for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[2:] if fits else None


def test_given_rules(spark):
    urls = ["http://A.Example.COM/en/7?x", "http://com/en/", "http://xcom/en/a", "https://shop.com/EN/a", "http://a.example.net/de/81#f", "http://net/de/8", "http://b.org/es/", "http://b.org/es", None, "no scheme", "://", "http://a?b://c/d", "x://h\nost/p\nq?r", "http://É.com/en/é", "http://com", "http://u:p@a.com:80/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    for r in urlfilter.judged(df, RULES).collect():
        host, path = parts(urls[r.page_id])
        want = plain_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want and want[1], want[0] if want else "allow"), urls[r.page_id]


def wilson(hits, n, z=1.96):
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def plain_tokens(url):
    """The tokens of a URL by hand."""
    host, path = parts(url)
    if url is None or "://" not in url:
        return set()
    rest = url.split("://", 1)[1].split("#", 1)[0]
    names = [x.split("=", 1)[0] for x in rest.split("?", 1)[1].lower().split("&")] if "?" in rest else []
    return {f"h:{x}" for x in re.split("[.-]", host) if x} | {"p:" + re.sub("[0-9]+", "0", x) for x in path.lower().split("/") if x} | {f"q:{x}" for x in names if x}


def counted(baskets, bad, least, confidence, most_items=4):
    """Rules by counting every combination; of tokens on the same pages the least stands for all."""
    on = {}
    for i, b in baskets.items():
        for t in b:
            on.setdefault(t, set()).add(i)
    items = sorted({min(t for t in on if on[t] == pages) for pages in map(frozenset, on.values()) if len(pages & bad) >= least for pages in [set(pages)]})
    found = {}
    for k in range(1, most_items + 1):
        for c in combinations(items, k):
            has = set.intersection(*(on[t] for t in c))
            hits = len(has & bad)
            if hits >= least and wilson(hits, len(has)) >= confidence and not any(set(f) <= set(c) for f in found):
                found[c] = (round(hits / len(has), 9), round(hits / len(baskets), 9))
    return found


def test_rules_of_many_tokens(spark):
    """Only all six tokens together say block: no smaller combination is sure, none is cut off."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(2000):
        on = [rng.random() < 0.75 for _ in range(6)] if i % 4 else [True] * 6
        rows.append((i, "http://h/" + "/".join(c for c, x in zip("abcdef", on, strict=True) if x)))
        labels.append((i, all(on)))
    rules = urlfilter.mined(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, blocked boolean"), confidence=0.99)
    assert [sorted(r["items"]) for r in rules.collect()] == [[f"p:{c}" for c in "abcdef"]]


def like_pages(n=900):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        host = rng.choice(["ads.shop", "news.site", "win.casino", "blog.site"])
        path = rng.choice(["a/1", "b/2", "c/33"])
        bad = host == "win.casino" or (host == "ads.shop" and path == "b/2") or rng.random() < 0.05
        rows.append((i, f"http://{host}.com/{path}?q=1&z"))
        labels.append((i, bad))
    return rows, labels


def test_mined_rules_equal_counting(spark):
    rows, labels = like_pages()
    pages, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*labels, (None, True), (1, None)], "page_id long, blocked boolean")
    baskets = {i: plain_tokens(u) for i, u in rows}
    assert {r.page_id: set(r.t) for r in pages.select("page_id", urlfilter.tokens(F.col("url")).alias("t")).collect()} == baskets
    rules = urlfilter.mined(pages, lab, confidence=0.8, least=20)
    got = {tuple(r["items"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in rules.collect()}
    want = counted(baskets, {i for i, b in labels if b}, 20, 0.8)
    assert got == want and {len(k) for k in got} == {1, 2}
    assert all(r["index"] in r["items"] for r in rules.collect())
    for small in (urlfilter.small, lambda df: df):
        urlfilter.small, before = small, urlfilter.small
        out = urlfilter.judged(pages.unionByName(pages), [("allow", "casino.com/a/")], rules).collect()
        urlfilter.small = before
        assert len(out) == 2 * len(rows)
        for r in out:
            allowed = r.host == "win.casino.com" and r.path.startswith("/a/")
            assert r.verdict == ("block" if any(set(i) <= baskets[r.page_id] for i in got) and not allowed else "allow"), r


def test_held_out_pages(spark):
    """Rules from three quarters of the labelled pages, judged by the rest."""
    rows, labels = like_pages(3000)
    pages, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, blocked boolean")
    out = F.pmod(F.crc32(F.col("page_id").cast("string")), F.lit(4)) == 2
    verdicts = urlfilter.judged(pages.where(out), [], urlfilter.mined(pages, lab.where(~out))).join(lab, "page_id").collect()
    blocked = [r for r in verdicts if r.verdict == "block"]
    assert sum(r.blocked for r in blocked) / len(blocked) > 0.95 and len(blocked) / sum(r.blocked for r in verdicts) > 0.8


def test_labels_without_relation_to_urls(spark):
    """Nothing is to be learnt, so nothing is, though single pages agree with their label."""
    rng = random.Random(8)
    rows = [(i, f"http://h{rng.randrange(300)}.com/{rng.choice('abc')}/x{rng.randrange(900)}y?p{rng.randrange(50)}=1") for i in range(800)]
    pages, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(i, rng.random() < 0.3) for i in range(800)], "page_id long, blocked boolean")
    assert urlfilter.mined(pages, lab).collect() == []


def test_rule_on_a_late_token_and_long_urls(spark):
    """Forty path segments before the token that tells, and twenty tokens that always come together."""
    deep = lambda i, last: f"http://a.com/{'/'.join(f'd{chr(97 + k)}' for k in range(20))}/{'/'.join(f's{chr(97 + k // 5)}{chr(97 + k % 5)}{chr(97 + i % 3)}' for k in range(20))}/x?{last}=1"
    rows = [(i, deep(i, "bad" if i % 2 else "good")) for i in range(400)] + [(1000, "http://a.com/" + "long/" * 40_000 + "?bad"), (1001, "http://b.com/y?bad&v")] + [(1, deep(1, "bad"))] * 3
    pages, lab = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "index": F.lit(1)}), spark.createDataFrame([(i, i % 2 == 1) for i in range(400)], "page_id long, blocked boolean")
    rules = urlfilter.mined(pages, lab)
    assert [r["items"] for r in rules.collect()] == [["q:bad"]]
    out = urlfilter.judged(pages, [], rules).collect()
    assert len(out) == len(rows) and all((r.verdict == "block") == (r.page_id in (1000, 1001) or r.page_id % 2 == 1) for r in out)


def test_query_equals_brute_force(spark, tmp_path):
    """The registered query on a small folder of tables."""
    rng = random.Random(9)
    rows, quality = [], []
    for i in range(700):
        host = rng.choice(["ads.shop", "www.site", "example", "b.example"])
        bad = host == "ads.shop" and rng.random() < 0.97
        rows.append((i, rng.choice(["http://", "HTTPS://"]) + host + rng.choice([".com/en/", ".com/en/7x", ".net/de/", ".net/de/81", ".org/es/"]) + rng.choice(["", "q", "Z?x=1#f"])))
        quality.append((i, int(not bad), 0))
    rows += [(900, None), (901, "nothing")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(quality, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rules = counted({i: plain_tokens(u) for i, u in rows if i < 900}, {i for i, q, _ in quality if not q}, 20, 0.8)
    assert rules
    out = {r.page_id: r for r in op7_url_filter(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for i, u in rows:
        host, path = parts(u)
        want = plain_rule(host, path)
        verdict = want[0] if want else "block" if any(set(r) <= plain_tokens(u) for r in rules) else "allow"
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, want and want[1], verdict)


def test_nothing_to_learn(spark):
    pages = spark.createDataFrame([(1, None), (2, "http://a.com/x")], "page_id long, url string")
    rules = urlfilter.mined(pages, spark.createDataFrame([], "page_id long, blocked boolean"))
    assert rules.collect() == [] and len(urlfilter.judged(pages, RULES, rules).collect()) == 2
    assert urlfilter.judged(pages.limit(0), RULES).collect() == []
