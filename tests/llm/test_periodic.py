"""Periodic runs against a search of every period in plain Python."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from roadweave.llm import periodic
from roadweave.llm.queries import op11_periodic_runs

DOCS = "doc_id long, text string, runs string, _text int"


def every_run(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """Each stretch that one period holds and no neighbour continues; equal stretches keep the least period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j + p - i >= least:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def expected(doc_id, text) -> tuple:
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = every_run(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{k},{p}\n" for s, k, p in sorted(runs, key=lambda r: (r[0], r[2])))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(collapsed([w.decode() for w in words], runs)))


def made(rng: random.Random, letters: str, pieces: int) -> list[str]:
    out: list[str] = []
    for _ in range(pieces):
        piece = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
        out += piece * rng.choice((1, 1, 2, 3, 7))
    return out


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefghijklmnopqrstuvwxyz"])
def test_runs_equal_those_of_every_period(letters):
    rng = random.Random(len(letters))
    texts = [" ".join(made(rng, letters, rng.randrange(12))) for _ in range(400)]
    for t, (runs, rest) in zip(texts, periodic.searched([t.encode() for t in texts]), strict=True):
        assert runs == every_run(t.split()), t
        assert rest.decode() == collapsed(t.split(), runs)


def test_z_function():
    rng = random.Random(2)
    for _ in range(500):
        s = np.array([rng.randrange(2) for _ in range(rng.randrange(1, 90))] if rng.random() < 0.5 else [ord(c) for c in "".join(made(rng, "ab", 4))])
        plain = [next((k for k in range(len(s) - i) if s[i + k] != s[k]), len(s) - i) for i in range(len(s))]
        assert periodic.z_function(s).tolist() == plain


def test_long_periodic_texts_take_near_linear_time():
    thue = "".join(str(bin(i).count("1") % 2) for i in range(1 << 16))
    for words in (["a"] * 200_000, list("abcdefghijklmnopqrst") * 10_000, [str(i % 7001) for i in range(200_000)], list(thue)):
        began = time.process_time()
        [(runs, rest)] = periodic.searched([" ".join(words).encode()])
        assert time.process_time() - began < 20
        if words[0] != "0":
            q = len(set(words))
            assert runs == [(0, len(words), q)] and len(rest.split()) == q


def test_rows_of_all_kinds(spark):
    line = "the same line of words again "
    rows = [(i, t, "x", 1) for i, t in enumerate([None, "", " \t\n", "a", "a " * 12, "a " * 11, line * 2, line * 2 + "the same", "é ü " * 9, "b\x0bc\x0c" * 8, line * 300, "a b " * 5 + "c " + "a b " * 6])]
    rows += [(5, "a " * 11, "x", 1), (5, "a " * 11, "x", 1), (None, "q w " * 6, "x", 1)]
    rows += [(100 + i, " ".join(made(random.Random(i), "abcd", 9)), "x", 1) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, periodic.digested(periodic.periodic(periodic.planted(df))).collect()), key=str)
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=str)
    kept = periodic.periodic(df)
    assert kept.columns == ["doc_id", "text", "_text", "runs", "collapsed"] and kept.count() == len(rows)
    assert periodic.periodic(df.limit(0)).count() == 0


def test_query_against_every_period(spark):
    from roadweave.llm.common import table

    sf_dir = "/root/testdata/sf0.001"
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = op11_periodic_runs(spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    assert sorted(map(tuple, got.collect())) == sorted(expected(*r) for r in rows)
