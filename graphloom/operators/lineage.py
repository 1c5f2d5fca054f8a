"""Tables in the shared folder that cut lineage, and row numbers without a one-task sort."""

from __future__ import annotations

import contextlib
import math
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this session in the shared one that spark.checkpoint.dir names; it goes when the JVM ends.

    Without that setting there is no folder that all executors see, so only a local master may do without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    root = f"{sc.getCheckpointDir()}/tables"
    if root not in _ROOTS:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS.add(root)
    return root


_ROOTS: set[str] = set()
_LOCK, _USERS, _FINE_USERS = threading.Lock(), [], []
#: Shuffle files go as soon as the statement that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Shuffles in many parts, of which the engine joins small ones: a task's share follows no fixed number of parts. As
#: parts are small, the engine hashes the smaller side of a join where it would sort both.
FINE = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32m"}


def cut(df: DataFrame, *gone: DataFrame, fine: bool = False) -> DataFrame:
    """`df` as a table in the shared folder, so that lost executors cost no earlier work and the planner knows its
    size. The tables behind `gone`, results of cut() that nothing reads any more, are deleted.

    With `fine`, no task of it is handed more than some 32 MB of a shuffle, so its memory does not grow with the input.
    Each partition is one file, whatever the session says."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    with shuffle_files_go(spark), _held(spark, FINE if fine else {}, _FINE_USERS):
        df.write.option("maxRecordsPerFile", 0).parquet(path)
    drop(*gone)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def cut_fine(df: DataFrame, *gone: DataFrame) -> DataFrame:
    """cut() with fine shuffles."""
    return cut(df, *gone, fine=True)


@contextlib.contextmanager
def _held(spark: SparkSession, settings: dict[str, str], users: list) -> Iterator[None]:
    """Within, the session has `settings`. Threads may overlap: the first of `users` sets them, the last restores what
    was set before."""
    if not settings:
        yield
        return
    with _LOCK:
        if not users:
            users.append({name: spark.conf.get(name, None) for name in settings})
            for name, value in settings.items():
                spark.conf.set(name, value)
        users.append(None)
    try:
        yield
    finally:
        with _LOCK:
            users.pop()
            if len(users) == 1:
                for name, before in users.pop().items():
                    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffle_files_go(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within, statements of the session delete their shuffle files."""
    return _held(spark, {CLEANUP: "true"}, _USERS)


def drop(*gone: DataFrame) -> None:
    """Delete the tables behind results of cut()."""
    for df in gone:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut_into(df: DataFrame, rows: int, *gone: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """cut() of a `df` of at most `rows` narrow rows, in as many files as they need."""
    return cut(df.coalesce(max(1, math.ceil(rows / rows_per_task))), *gone)


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """`df` with `name`: the position of each row in `order`, gapless.

    Rows are dealt by range and sorted in their partitions, and a row's place is that in its part's file, so no number
    is stored; only the partitions' sizes are summed up in one place. `df` is worked out twice, for the ranges and for
    the table. `order` has to be unique for the numbers to be the same each time."""
    placed = cut(df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).sortWithinPartitions(*order).withColumn("part__", F.spark_partition_id()), fine=True)
    sizes = placed.groupBy("part__").count()
    first = sizes.select("part__", F.coalesce(F.sum("count").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first__"))
    return placed.withColumn("row__", F.col("_metadata.row_index")).join(F.broadcast(first), "part__").withColumn(name, (F.col("first__") + F.col("row__") + start).cast("bigint")).select(*df.columns, name)
