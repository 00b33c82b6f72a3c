"""Near-duplicates against all pairs of plain Python sets."""

import hashlib
import random

import numpy as np

from roadweave.llm import minhash
from roadweave.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, width):
    w = [x for x in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "").translate(UP)).split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent=80):
    sets = [(d, plain_set(t, width)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(d, len(s), find(d), find(d) == d) for d, s in sets}


def found(spark, rows, width, **options):
    return {tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=width, **options).collect()}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, doc = [], 0
    for n in (6, 12, 40, 90, 200):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(n)]
            for _ in range(rng.choice((1, 2, 7, 12))):
                t = list(base)
                for _ in range(rng.choice((0, 0, 1, 2, max(1, n // 20), max(1, n // 10)))):
                    t[rng.randrange(n)] = rng.choice(words)
                rows.append((doc, " ".join(x.upper() if rng.random() < 0.1 else x for x in t)))
                doc += 1
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [(doc + i, passage + " " + " ".join(rng.choice(words) for _ in range(40))) for i in range(25)]
    rng.shuffle(rows)
    return rows


def test_equals_all_pairs(spark):
    rows = corpus()
    for width in (2, 5):
        assert found(spark, rows, width) == brute(rows, width)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    rows = []
    for i in range(700):
        t = list(base)
        for _ in range(i % 12):
            t[rng.randrange(100)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(t)))
    assert found(spark, rows, 2) == brute(rows, 2)


def test_blocks_of_a_group(spark, monkeypatch):
    """Groups over several blocks link what one block would."""
    monkeypatch.setattr(minhash, "MEMBERS", 7)
    rows = corpus(9)
    assert found(spark, rows, 2) == brute(rows, 2)


def test_exact_copies(spark):
    rows = [(i, "The Same text  of seven words here") for i in range(5, 2000)] + [(1, "the same text\tof seven words HERE"), (2, "another text")]
    got = found(spark, rows, 2)
    assert {r[2] for r in got if r[0] != 2} == {1} and sum(r[3] for r in got) == 2


def test_odd_inputs(spark):
    assert found(spark, [], 2) == set()
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É one two"), (8, "é one two")]
    assert found(spark, rows, 2) == brute(rows, 2)
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (9, "a b c"), (9, "a b c"), (9, "other words")], SCHEMA).selectExpr("*", "1 as n_shingles", "'x' as digest"), width=2).collect()
    assert len(got) == 5 and {r.component_id for r in got} == {None, 9} and all(r.kept for r in got)


def test_very_long_text(spark):
    rng = random.Random(1)
    long = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    near = list(long)
    for _ in range(300):
        near[rng.randrange(20_000)] = "zz"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:9000]))]
    assert found(spark, rows, 2) == brute(rows, 2)


def test_shingle_digests_follow_sets():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aAbB c\n") for _ in range(rng.randrange(40))) for _ in range(400)]
    for width in (1, 2, 5):
        digests = list(shingle_sets([t.encode() for t in texts], width))
        plain = [plain_set(t, width) for t in texts]
        assert [len(d) for d in digests] == [len(p) for p in plain]
        for i in range(0, 399):
            assert len(np.intersect1d(digests[i], digests[i + 1])) == len(plain[i] & plain[i + 1])


def test_intersections_by_matrix(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint64)) for _ in range(30)]
    both = minhash.common_counts(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)


def test_copies_behind_long_quoting_documents(spark):
    """Two late near copies; the least member of every bucket they share is a longer document that quotes them."""
    passage = [f"p0x{i}" for i in range(104)]
    rows = [(i, " ".join([*passage, *(f"l{i}x{k}" for k in range(80))])) for i in range(2000)]
    rows += [(5000 + p, " ".join([*passage[:p], f"c{p}", *passage[p + 1 :]])) for p in (30, 60)]
    got = {d: c for d, _, c, _ in found(spark, rows, 5)}
    assert (got[5030], got[5060]) == (5030, 5030)
    assert all(got[i] == i for i in range(2000))


def near(rng, text, changes=1):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
    return " ".join(words)


def test_all_texts_of_an_id_are_compared(spark):
    """Ids with two and more texts, copies and near copies of each; also with blocks weighed by bytes."""
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(60))
    rows = []
    for i in range(60):
        a, b = text(), text()
        rows += [(10 * i + 3, a), (10 * i + 3, b), (10 * i + 5, near(rng, a)), (10 * i + 7, near(rng, b)), (10 * i + 1 + 3 * (i % 2), b)]
    rows += [(9, "A b c d"), (9, "B q r s t"), (12, "A b c d z y x w v u"), (13, "B q r s t z")]
    assert found(spark, rows, 2) == brute(rows, 2)
    before, minhash.MEMBER_BYTES = minhash.MEMBER_BYTES, 300
    try:
        assert found(spark, rows, 5) == brute(rows, 5)
    finally:
        minhash.MEMBER_BYTES = before


def test_repeats_are_those_of_texts(spark):
    """A second text of a repeated id stays; of one class one row stays."""
    rng = random.Random(9)
    a, b = (" ".join(f"{k}{i}" for i in range(80)) for k in "ab")
    rows = [(5, a), (9, near(rng, a)), (9, b), (12, near(rng, b)), (9, b.upper()), (9, b), (None, a), (3, None), (4, "")]
    gone = minhash.repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    mark = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert {tuple(r) for r in gone} == {(9, mark(rows[1][1])), (12, mark(rows[3][1])), (9, max(mark(b), mark(b.upper())))}
    assert len(gone) == 3
