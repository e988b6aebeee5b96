"""Session helpers: a local session for tests and the bench, and the shared folder for cut lineage."""

from __future__ import annotations

import itertools
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

BUCKET_ROWS = 100_000  # rows that make a bucket of their own


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "quadrat") -> SparkSession:
    """Session for tests and the bench. On a cluster the submitting job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one disk, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="quadrat-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def side_by_side(spark: SparkSession, tasks: Iterable[Callable[[], T]]) -> list[T]:
    """Results of tasks whose jobs do not wait for each other, each in a thread of its own, so small jobs fill the cores together."""
    tasks, inherit = list(tasks), inheritable_thread_target(spark)
    if len(tasks) < 2:
        return [task() for task in tasks]
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [done.result() for done in [pool.submit(inherit(task)) for task in tasks]]


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor costs a re-read and not a re-run."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written below the shared folder between the rounds of a loop.

    A table that was written and read back starts a new plan: unlike a checkpoint it does not carry the
    partitionings of all earlier joins along, which multiply from round to round.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count, self.tables = spark, scratch_path(spark, name), itertools.count(), []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{next(self.count)}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_bucketed(self, df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
        """The same as a table bucketed and sorted by keys: joins and aggregates on them read it where it lies.

        ``rows`` is what the table holds at most, if that is known: a small one has few buckets, as each is a task in every pass over it.
        """
        number = next(self.count)
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if rows is not None:
            width = min(width, math.ceil(rows / BUCKET_ROWS) or 1)
        name = f"scratch_{uuid.uuid4().hex}"
        laid_out = df.repartition(width, *keys)
        laid_out.write.bucketBy(width, *keys).sortBy(*keys).option("path", f"{self.path}/{number}").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def clear(self) -> None:
        """Delete the tables of this loop."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
