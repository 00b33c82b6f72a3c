"""Snapshots in hash buckets: a batch rewrites the buckets it changes, and one pointer publishes all tables of a feed.

    folder/manifests/000000007   JSON: of each table its schema, keys, number of buckets and the folder of
                                 every bucket that has rows; and a mark of the writer's choice
    folder/data/<table>/<version>/bucket=<n>/*.parquet
    folder/leases/000000007-*    readers that hold a version

Manifests appear by a rename and are never changed; the highest number holds. Buckets of a new version
are written beside the old ones, so that a crash at any point leaves the published version as it was, and
of two writers of one number the later fails. A bucket's number is a hash of its keys: its size is the
table's over the number of buckets, whatever keys are frequent among others than the table's own.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import fresh, materialize
from .snapshot import _fs

BUCKETS = 64


@dataclass(frozen=True)
class Change:
    """What becomes of a table: ``change(stored, batch)`` gives its new rows.

    ``stored`` are the rows of the buckets that ``touched`` (rows with the ``by`` columns, the batch by
    default) falls into, or all rows if ``whole``; it is None before the first version. ``by``: the columns that
    decide the bucket, all or some of the keys, or a child's reference to its parent.
    """

    table: str
    batch: DataFrame
    by: Sequence[str]
    change: Callable[[DataFrame | None, DataFrame], DataFrame]
    whole: bool = False
    touched: DataFrame | None = None


class Store:
    """Tables under one folder that change together."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.fs, self.path = _fs(spark, folder)

    # manifests ------------------------------------------------------------------------------

    def _list(self, name: str) -> list:
        at = self.path(f"{self.folder}/{name}")
        return list(self.fs.listStatus(at)) if self.fs.exists(at) else []

    def numbers(self) -> list[int]:
        """Published versions, oldest first."""
        return sorted(int(f.getPath().getName()) for f in self._list("manifests") if f.getPath().getName().isdigit())

    def manifest(self, number: int | None = None) -> dict:
        known = self.numbers()
        number = number or (known[-1] if known else 0)
        if not number:
            return {"number": 0, "mark": None, "tables": {}}
        text = "".join(r[0] for r in self.spark.read.text(f"{self.folder}/manifests/{number:09d}", wholetext=True).collect())
        return json.loads(text) | {"number": number}

    def read(self, table: str, number: int | None = None) -> DataFrame | None:
        """A table of the latest version or of another one; None where it has none."""
        return self._rows(self.manifest(number)["tables"].get(table))

    def _rows(self, entry: dict | None, only: set[int] | None = None) -> DataFrame | None:
        if entry is None:
            return None
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.folder}/{p}" for b, p in entry["paths"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # changes --------------------------------------------------------------------------------

    def commit(self, changes: Sequence[Change], mark: str | None = None) -> int:
        """Publish the new rows of all tables as one version; its number. Tables without a change stay as they are."""
        was = self.manifest()
        version = f"{was['number'] + 1:09d}-{uuid.uuid4().hex}"
        tables = dict(was["tables"])
        for c in changes:
            tables[c.table] = self._changed(c, was["tables"].get(c.table), version)
        self._put(was["number"] + 1, {"mark": mark, "tables": tables}, version)
        return was["number"] + 1

    def _put(self, number: int, content: dict, version: str) -> None:
        self.fs.mkdirs(self.path(f"{self.folder}/manifests"))
        draft = self.path(f"{self.folder}/.manifest-{version}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not self.fs.rename(draft, self.path(f"{self.folder}/manifests/{number:09d}")):
            raise RuntimeError(f"version {number} of {self.folder} has been published by another writer")

    def _changed(self, c: Change, entry: dict | None, version: str) -> dict:
        count = entry["buckets"] if entry else self.buckets
        bucket = lambda by: F.pmod(F.xxhash64(*by), F.lit(count)).cast("int")
        only = None
        if entry and not c.whole:
            # at most as many numbers as there are buckets
            only = {r[0] for r in (c.batch if c.touched is None else c.touched).select(bucket(c.by)).distinct().collect()}
        stored = self._rows(entry, only)
        new = materialize(c.change(stored, c.batch))
        name = fresh(new.columns, "bucket")
        new = new.withColumn(name, bucket(c.by))
        paths = dict(entry["paths"]) if entry else {}
        differ = self._differ(stored.withColumn(name, bucket(c.by)) if stored is not None else None, new, name)
        kept = sorted(b for b, rows in differ.items() if rows)
        if kept:
            at = f"data/{c.table}/{version}"
            new.where(F.col(name).isin(kept)).repartition(len(kept), name).write.partitionBy(name).parquet(f"{self.folder}/{at}")
            paths |= {str(b): f"{at}/{name}={b}" for b in kept}
        for b in differ.keys() - set(kept):
            paths.pop(str(b), None)
        return {"schema": json.loads(new.drop(name).schema.json()), "by": list(c.by), "buckets": count, "paths": paths}

    @staticmethod
    def _differ(stored: DataFrame | None, new: DataFrame, name: str) -> dict[int, int]:
        """The buckets whose rows changed, with the number of rows they have now."""
        columns = [c for c in new.columns if c != name]
        row = F.to_json(F.struct(*columns))
        marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(row)).alias("x"), F.bit_xor(F.xxhash64(row, F.lit(1))).alias("y")]
        now = {r[0]: tuple(r)[1:] for r in new.groupBy(name).agg(*marks).collect()}
        was = {r[0]: tuple(r)[1:] for r in stored.select(*new.columns).groupBy(name).agg(*marks).collect()} if stored is not None else {}
        return {b: now.get(b, (0,))[0] for b in now.keys() | was.keys() if now.get(b) != was.get(b)}

    # readers and expiry ---------------------------------------------------------------------

    @contextlib.contextmanager
    def hold(self) -> Iterator[int]:
        """The number of the latest version, which :meth:`expire` leaves alone meanwhile."""
        number = self.numbers()[-1]
        lease = self.path(f"{self.folder}/leases/{number:09d}-{uuid.uuid4().hex}")
        self.fs.create(lease, True).close()
        try:
            yield number
        finally:
            self.fs.delete(lease, False)

    def expire(self, keep: int = 2, lease_s: float = 86_400, grace_s: float = 3_600) -> int:
        """Delete versions before the last ``keep`` that no reader holds, and bucket folders that no version is left to name.

        Leases older than ``lease_s`` are those of readers that died. Folders younger than ``grace_s`` may be a
        writer's that hasn't published yet. Returns how many version folders went.
        """
        now = time.time()
        known = self.numbers()
        held = {int(f.getPath().getName().split("-")[0]) for f in self._list("leases") if now - f.getModificationTime() / 1000 <= lease_s}
        left = [n for n in known if n in known[-keep:] or n in held]
        named = {p.rsplit("/", 1)[0] for n in left for t in self.manifest(n)["tables"].values() for p in t["paths"].values()}
        for n in set(known) - set(left):
            self.fs.delete(self.path(f"{self.folder}/manifests/{n:09d}"), False)
        gone = 0
        for table in self._list("data"):
            name = table.getPath().getName()
            for version in self._list(f"data/{name}"):
                at = f"data/{name}/{version.getPath().getName()}"
                if at not in named and now - version.getModificationTime() / 1000 >= grace_s:
                    gone += bool(self.fs.delete(self.path(f"{self.folder}/{at}"), True))
        return gone
