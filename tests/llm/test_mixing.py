"""Mixing: targets against a plain water-filling, epochs, ties, odd inputs."""

import pytest
from pyspark.sql import functions as F

from roadweave.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def filled(sizes, ratios=(5, 2, 1), most=3):
    """Targets by repeated sharing: whoever is above its bound leaves, the rest share again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: ratios[i % len(ratios)] for i, s in enumerate(names)}
    target, left, total = {}, set(names), float(sum(sizes.values()))
    while left:
        level = (total - sum(target.values())) / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * w[s] for s in left}
        target |= {s: float(most * sizes[s]) for s in over}
        left -= over
    return target


def mixed(spark, rows, **options):
    return mixing.mix(spark.createDataFrame(rows, SCHEMA), **options).collect()


def test_targets_epochs_and_amounts(spark):
    counts = {"a": 40, "b": 300, "c": 5, None: 30, "é": 200}
    rows = [(i * 10 + k, "w " * (1 + (i * 7 + k) % 9), s) for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    out = mixed(spark, rows)
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
    want = filled(sizes)
    for s in counts:
        own = [r for r in out if r.source == s]
        assert {r.mix_source_size for r in own} == {sizes[s]}
        assert own[0].mix_target == pytest.approx(want[s])
        taken = sum(r.mix_copies * r.mix_size for r in own)
        assert abs(taken - want[s]) <= 9
        whole = int(want[s] // sizes[s] + 1e-12)
        assert {r.mix_copies for r in own} <= {whole, whole + 1}
        assert max(r.mix_copies for r in own) <= 3
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixed(spark, rows[::-1])), key=str)


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, ("same " * 20) if i % 2 else " ".join(f"w{j}" for j in range(20)), "a") for i in range(400)] + [(1000 + i, "x y z " * 40, "b") for i in range(10)]
    out = mixed(spark, rows, ratios=(1, 1))
    a = [r for r in out if r.source == "a"]
    good, bad = (sum(r.mix_copies for r in a if r.doc_id % 2 == k) for k in (0, 1))
    assert 0 < good + bad < 400 and good > 2 * bad


def test_odd_inputs(spark):
    assert mixed(spark, []) == []
    rows = [(None, None, None), (None, "", None), (1, "a b", "s"), (1, "a b", "s"), (2, "\t\n\x0b\x0c\r ", "s"), (3, "one" + "\u00a0" + "word", "t")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"mix_size": F.lit("clash"), "target": F.lit(1)})
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", "target", "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    got = out.collect()
    assert len(got) == 6 and {r.mix_size for r in got if r.doc_id == 1} == {2}
    assert {r.mix_size for r in got if r.doc_id in (None, 2)} == {0} and [r.mix_size for r in got if r.doc_id == 3] == [1]
    assert len({r.mix_copies for r in got if r.doc_id == 1}) == 1


def test_repeated_rows(spark):
    df = spark.createDataFrame([(i, f"w{i} x y", "a" if i < 3 else "b") for i in range(60)], SCHEMA)
    m = mixing.mix(df)
    assert mixing.repeated(m).columns == df.columns
    assert mixing.repeated(m).count() == m.agg(F.sum("mix_copies")).first()[0]


def test_very_long_text_and_hot_source(spark):
    rows = [(i, "w " * 50, "hot") for i in range(300)] + [(500, "w " * 20_000, "hot"), (501, "a", "z")]
    out = mixed(spark, rows)
    hot = [r for r in out if r.source == "hot"]
    assert abs(sum(r.mix_copies * r.mix_size for r in hot) - hot[0].mix_target) <= 20_000


def test_part_of_the_edge_bucket(spark, monkeypatch):
    """However coarse the buckets and their parts are, the same documents are taken."""
    rows = [(i, f"w{i} " * (1 + i % 5), "ab"[i % 7 == 0]) for i in range(700)]
    want = sorted(map(tuple, mixed(spark, rows)))
    for buckets, parts in ((1, 1), (1, 7), (3, 4096)):
        monkeypatch.setattr(mixing, "BUCKETS", buckets)
        monkeypatch.setattr(mixing, "PARTS", parts)
        assert sorted(map(tuple, mixed(spark, rows))) == want


def test_names_that_the_plan_uses(spark):
    df = spark.createDataFrame([(i, f"w{i} x y", "a" if i < 3 else "b") for i in range(60)], SCHEMA)
    odd = df.withColumns({c: F.lit(c) for c in ("_copy", "_mix_key", "_mix_words", "_cut_source", "mix_x", "_column_3", "place", "rest")})
    m = mixing.mix(odd, weight=F.length("place"))
    out = mixing.repeated(m)
    assert out.columns == odd.columns
    assert {tuple(r)[3:] for r in out.collect()} == {("_copy", "_mix_key", "_mix_words", "_cut_source", "mix_x", "_column_3", "place", "rest")}
