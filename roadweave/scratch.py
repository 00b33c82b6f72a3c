"""Tables written between the steps of a plan, in the folder all executors share, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and most bytes (as written, compressed) of a table that is sent to every executor. Beyond them joins shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 24 << 20


def _base(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that the session's default file system gives it."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    # file:/x is file:///x to readers outside Hadoop
    return f"{found.getScheme()}://{found.getAuthority() or ''}{found.getPath()}"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder, with its scheme, under ``spark.checkpoint.dir``, which all executors share.

    Where that setting is absent, a local master gets a temporary folder of its machine; on a
    cluster that would scatter the rows over machines, so there it raises.
    """
    sc = spark.sparkContext
    base = _base(spark)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-roadweave-", dir="/tmp"))
        base = sc.getCheckpointDir()
    return qualified(spark, f"{base.rstrip('/')}/roadweave/{sc.applicationId}/{uuid.uuid4().hex}")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: later jobs read files that outlive any executor. The file sizes also let
    Spark choose its joins by what is really there.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table that this application has written with :func:`materialize`."""
    sc = spark.sparkContext
    if base := _base(spark):
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/roadweave/{sc.applicationId}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it is no larger than ``rows`` and ``size``, else as it is."""
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > size:
        return df
    return F.broadcast(df) if df.count() <= rows else df


def fresh(taken: list[str], name: str) -> str:
    """``name``, with as many leading underscores as make it differ from all columns ``taken``."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name
