"""Snapshots in buckets: what is written follows the batch, versions are whole, readers keep theirs."""

import os

import pytest
from pyspark.sql import functions as F

from roadweave.operators import snapshot
from roadweave.operators.buckets import Change, Store


def upsert(keys):
    return lambda old, new: new.withColumn(snapshot.STAMP, F.lit(0)) if old is None else snapshot.merge_changed(old, new, keys, [c for c in new.columns if c not in keys], F.lit(1)).select(*old.columns)


def rows(spark, ids, v=0):
    return spark.range(0).select("id", F.lit(0).alias("v")) if not ids else spark.createDataFrame([(i, v) for i in ids], "id long, v int")



def test_a_batch_rewrites_what_it_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=16)
    assert store.read("t") is None and store.commit([Change("t", rows(spark, range(1000)), ["id"], upsert(["id"]))], mark="a") == 1
    before = store.manifest()["tables"]["t"]["paths"]
    assert len(before) == 16
    store.commit([Change("t", rows(spark, [3, 2000], 7), ["id"], upsert(["id"]))], mark="b")
    after = store.manifest()["tables"]["t"]["paths"]
    touched = {b for b in after if after[b] != before[b]}
    assert 1 <= len(touched) <= 2 and store.manifest()["mark"] == "b"
    assert {(r.id, r.v) for r in store.read("t").collect()} == {(i, 0) for i in range(1000) if i != 3} | {(3, 7), (2000, 7)}
    # the same rows again change nothing, nor is anything written
    store.commit([Change("t", rows(spark, [3, 2000], 7), ["id"], upsert(["id"]))])
    assert store.manifest()["tables"]["t"]["paths"] == after and len(os.listdir(tmp_path / "s" / "data" / "t")) == 2
    # rows that go empty their buckets
    store.commit([Change("t", rows(spark, [3]), ["id"], lambda old, new: old.where("id < 2"), whole=True)])
    assert {r.id for r in store.read("t").collect()} == {0, 1} and len(store.manifest()["tables"]["t"]["paths"]) <= 2
    store.commit([Change("t", rows(spark, [3]), ["id"], lambda old, new: old.limit(0), whole=True)])
    assert store.read("t").count() == 0 and store.read("t", 1).count() == 1000


def test_a_crash_between_two_tables_shows_the_old_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    both = lambda n, child: [Change("p", rows(spark, range(n)), ["id"], upsert(["id"])), Change("c", rows(spark, range(n)), ["id"], child)]
    store.commit(both(5, upsert(["id"])))

    def fails(old, new):
        return new.withColumn(snapshot.STAMP, F.raise_error(F.lit("lost")).cast("int"))

    with pytest.raises(Exception, match="lost"):
        store.commit(both(9, fails))
    assert store.numbers() == [1] and (store.read("p").count(), store.read("c").count()) == (5, 5)
    store.commit(both(9, upsert(["id"])))
    assert (store.read("p").count(), store.read("c").count()) == (9, 9)


def test_two_writers_of_one_number(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.commit([Change("t", rows(spark, range(5)), ["id"], upsert(["id"]))])

    def meanwhile(old, new):
        if len(store.numbers()) == 1:
            store.commit([Change("t", rows(spark, [7]), ["id"], upsert(["id"]))])
        return upsert(["id"])(old, new)

    with pytest.raises(RuntimeError, match="another writer"):
        store.commit([Change("t", rows(spark, [8]), ["id"], meanwhile)])
    assert {r.id for r in store.read("t").collect()} == {0, 1, 2, 3, 4, 7}


def test_readers_keep_their_version_while_others_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    for n in range(4):
        store.commit([Change("t", rows(spark, range(20), n), ["id"], upsert(["id"]))])
        if n == 1:
            held = store.hold()
            number = held.__enter__()
    assert number == 2 and store.expire(keep=1, grace_s=3600) == 0
    assert store.expire(keep=1, grace_s=0) == 2 and store.numbers() == [2, 4]
    assert {r.v for r in store.read("t", number).collect()} == {1} and {r.v for r in store.read("t").collect()} == {3}
    held.__exit__(None, None, None)
    assert store.expire(keep=1, grace_s=0) == 1 and store.numbers() == [4]
    assert store.read("t").count() == 20
