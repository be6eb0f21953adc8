"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where none is set (tests on one machine) a temporary one is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='llm-shared-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for tables in _SCOPES:
        tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


_SCOPES: list[list[str]] = []


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder that no plan reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Tables that are written within are deleted at the end, but for those in ``keep`` by then."""
    _SCOPES.append(tables := [])
    try:
        yield
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not tables]
        left = {getattr(df, "written_to", None) for df in keep}
        delete(spark, [path for path in tables if path not in left])


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def broadcast_if_small(df: DataFrame, row_bytes: int, limit_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast hint behind a check of the size of a written table; beyond it Spark shuffles."""
    most = limit_bytes // max(1, row_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], row_bytes: int, how: str = "inner", limit_bytes: int = 32 << 20) -> DataFrame:
    """Join (inner or left) of ``rows`` to the written ``table``, which has each key once.

    A small table is broadcast. Beyond that, keys with a large share of the rows (there are at most four times as many of them as
    partitions) are broadcast, so that no task has all rows of one, and the others are shuffled.
    """
    if table.limit((most := limit_bytes // max(1, row_bytes)) + 1).count() <= most:
        return rows.join(F.broadcast(table), keys, how)
    least = rows.count() // (4 * width(rows.sparkSession)) + 1
    hot = written(rows.groupBy(*keys).count().where(F.col("count") >= least).drop("count"), "hot")
    own = rows.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    return own.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how))


def fresh(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def levels(n: int) -> int:
    """Halvings after which ``n`` items are one."""
    return max(0, math.ceil(math.log2(n))) if n > 1 else 0


def text_slices(batch, text_col: str, limit: int = 4 << 20):
    """``batch`` in slices of about ``limit`` bytes of text (a longer single text is a slice of its own)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
