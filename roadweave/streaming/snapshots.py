"""The incremental path: landed feed files as micro-batches against a published snapshot.

``foreachBatch`` runs the batch operators of :mod:`roadweave.operators.snapshot`, so stream and
batch give the same table. :func:`latest_values` keeps the last row of each key in Spark's state
store instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.buckets import Change, Store

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def feed_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Files as they land in ``folder``, one a trigger: a feed file is a whole snapshot."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", 1).options(**options).load(folder)


#: The table that :func:`maintain` keeps in its store.
ROWS = "rows"


def maintain(stream: DataFrame, folder: str, checkpoint: str, merge: Merge, empty: DataFrame, keys: Sequence[str], whole: bool = False) -> StreamingQuery:
    """Start a query that merges each batch into the snapshot ``rows`` of the store under ``folder``.

    ``merge`` sees the stored rows of the buckets that the batch's ``keys`` fall into, or all rows if
    ``whole``. A batch that was published before (a restart repeats the last one) is left out by its
    number, which the version is marked with.
    """

    def batch(df: DataFrame, number: int) -> None:
        store = Store(df.sparkSession, folder)
        done = store.manifest()["mark"]
        if done is None or number > int(done):
            store.commit([Change(ROWS, df, keys, lambda old, new: merge(empty if old is None else old, new), whole)], mark=str(number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_values(stream: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], event_time_guard: bool = False) -> DataFrame:
    """The last row of each key as it changes (update mode), held in keyed state.

    As a feed does, the last row to arrive wins; with ``event_time_guard`` an older ``order`` value
    never replaces a newer one.
    """
    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    columns = [*keys, order, *values]
    schema = ", ".join(f"`{c}` {fields[c]}" for c in columns)
    state_schema = ", ".join(f"`{c}` {fields[c]}" for c in (order, *values))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        changed = False
        for b in batches:
            if b.empty:
                continue
            rows = b.sort_values(order, kind="stable") if event_time_guard else b
            last = next(rows[[order, *values]].iloc[[-1]].itertuples(index=False, name=None))
            if held is None or not event_time_guard or last[0] >= held[0]:
                held, changed = last, True
        if changed:
            state.update(held)
            yield pd.DataFrame([(*key, *held)], columns=columns)

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "update", "NoTimeout")


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and means a key and window, final once the watermark passes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
