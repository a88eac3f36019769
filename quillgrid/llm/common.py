"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, is ``rest``.  A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(mod) == F.lit(rest), F.lit(False))


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (``__`` for a dot) for the jobs inside; then as they were."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def no_shuffles_left(spark: SparkSession):
    """Shuffle files of the jobs inside go as soon as a job is done, not when the driver collects garbage."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    return Scratch(df.sparkSession).table(df, name)


class Scratch:
    """Tables in the shared folder for as long as a computation needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        with no_shuffles_left(self.spark):
            df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, or all."""
        for name in names or list(self.paths):
            for path in self.paths.pop(name, []):
                drop_path(self.spark, path)


_KEPT: dict[str, Callable[[], None]] = {}


def kept_by(name: str, clear: Callable[[], None]) -> None:
    """``clear`` empties what the operator ``name`` keeps in a worker process from task to task."""
    _KEPT[name] = clear


def claim_worker(name: str) -> None:
    """A worker keeps the caches of one operator at a time: free those of the others, and give free memory back."""
    import pyarrow

    for other, clear in _KEPT.items():
        if other != name:
            clear()
    pyarrow.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches cut into smaller ones, so that few texts at once are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path that ``fresh_path`` gave, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
