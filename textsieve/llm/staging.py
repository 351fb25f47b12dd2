"""Tables written in the folder that all executors share, and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textsieve.llm.textbytes import slices
from textsieve.shipping import ensure, shared_folder


_roots: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes what operators have written so far; results that haven't been written elsewhere can't be read any more."""
    while _roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(_roots.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Staged:
    """Writes intermediate tables and drops those no longer needed.

    Lineage ends at each table, so a lost executor costs the tasks that it ran and no more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", {}
        _roots.append(self.root)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = f"{self.root}/{name}-{len(self.paths)}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets the driver notice that earlier jobs' shuffle files aren't needed any more, so that they leave the disks."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(work: Callable) -> Callable:
    """The same function of batches; when it ends, memory that it has left free goes back to the system.

    Workers live on between tasks, and what each of them held at its largest task would add up.
    """

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return run


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over runs of rows of a few MB of text."""
    ensure(df.sparkSession)

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                yield fn(part)

    return df.mapInArrow(trimmed(work), schema)


def partitions(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
