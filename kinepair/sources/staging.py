"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SHARED_DIR = "spark.checkpoint.dir"
#: Measured size up to which a side of a join is sent to all tasks. Compressed: the rows take several times that on the driver, for every join of a query.
MEASURED_BROADCAST = "64k"
#: Measured size up to which the pieces of a shuffle are read by one task; also compressed.
TASK_BYTES = "8m"
#: Size up to which written files are read by one task.
READ_BYTES = "16m"
#: Pieces into which a shuffle is dealt at least, before adaptive execution puts small ones together.
PIECES = 1000


def measured_joins(spark: SparkSession) -> SparkSession:
    """Lets a side of a join be sent to all tasks by its measured size only; see `tune`."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", MEASURED_BROADCAST)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Keeps generated methods small enough for the JIT; wide pair aggregates depend on it.

    Joins are planned without broadcasts, and adaptive execution sends a side only once its shuffled size is measured: before that,
    exploded rows count as many bytes as the rows they come from, and a whole map passes for a small table. A side that grows with the
    input is soon above that size, so what the driver holds does not grow. Tasks are kept small for the same reason: ids and tokens compress well,
    and a task sorts them uncompressed. Shuffles are dealt into many pieces, as only those can be divided among tasks later.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    measured_joins(spark)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", READ_BYTES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(PIECES, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark


@contextlib.contextmanager
def by_scenario(spark: SparkSession) -> Iterator[None]:
    """Within it, rows that lie together by a part of a join's keys, their scenario, are joined where they are instead of being shuffled by all of its keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the session; a fresh temporary one only where none is set and everything runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get(SHARED_DIR, None) or spark.conf.get(SHARED_DIR, None)
    if named:
        return named
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set {SHARED_DIR} to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Lets the driver drop what finished jobs left behind.

    Every stage and scan is sent to the tasks in blocks of 4 MB, and plans and metrics come on top: garbage that the driver's heap grows to its bound for, though
    little of it is in use. Broadcasts and shuffle files of finished jobs are deleted only after such a collection, too.
    """
    spark._jvm.System.gc()


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes `df` once to the shared folder, in folders by the value of a column if one is named, and returns the written table.

    Survives lost executors, prunes columns on reading, and gives the planner
    real sizes, so it decides itself whether a side may be broadcast. What the jobs before left on the driver is released.
    """
    path = f"{shared_dir(df.sparkSession)}/kinepair/{name}-{uuid.uuid4().hex}"
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    release(df.sparkSession)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def staged_with(df: DataFrame, name: str, *measures: Column, by: str | None = None) -> tuple[DataFrame, dict]:
    """`staged`, and aggregates over the rows taken while they are written."""
    seen = Observation()
    table = staged(df.observe(seen, *measures), name, by)
    return table, seen.get


def discard(table: DataFrame) -> None:
    """Deletes the folder of a `staged` table that nothing will read again."""
    session = table.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(table._staged_path)
    path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
