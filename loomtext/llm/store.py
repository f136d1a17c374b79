"""Tables in the folder that the whole cluster shares.

Lineage is cut with written tables, never with executor-local copies, so that a
lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most so many (narrow) rows.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset and one machine runs all, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("loomtext.shared.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set("loomtext.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's program ends."""
    path = f"{shared_dir(spark)}/loomtext/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's own file system layer; a session that has ended is no error."""
    try:
        jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del jvm
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        pass


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished work; it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside; the session's own setting holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a narrow written table, broadcast only if its counted rows stay within ``limit``.

    Beyond the limit Spark joins by shuffle, and adaptive execution splits keys
    that hold a large share of the rows.
    """
    return big.join(F.broadcast(small) if small.count() <= limit else small, on, how)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_blocks(df: DataFrame, order: list, name: str) -> DataFrame:
    """Range-partition ``df`` by ``order`` and store it with its block number ``blk``.

    Blocks follow the order: every row of a block comes before those of the
    next. Windows over ``blk`` and sums over blocks then give global ranks,
    running sums or neighbours without one task seeing all rows.
    """
    n = partitions(df.sparkSession)
    return table(df.repartitionByRange(n, *order).withColumn("blk", F.spark_partition_id()), name)
