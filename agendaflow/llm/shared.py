"""Shared storage, cut lineage, free column names and joins on skewed keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a folder of our own in local mode and an
    error on a cluster, whose executors would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to storage that the driver and all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables of one computation, deleted together when its result no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str, **options) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        df.write.options(**options).parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self, keep: int = 0) -> None:
        """Deletes all tables but the last ``keep``."""
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for path in gone:
            delete_path(self.spark, path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lost executors then cost
    a reread, not a recomputation, and non-deterministic column values (partition ids) are fixed. For
    tables that a result still reads; others go through a ``Scratch``."""
    return Scratch(df.sparkSession).cut(df, name)


#: Rows that an Arrow batch hands to Python at most while texts are encoded or sketched.
BATCH_ROWS = 1000


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """A smaller Arrow batch for the jobs that run inside, so a worker holds few texts at once; the
    session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, "10000")
    if not 0 < int(old) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a partition's batches; the memory that they took goes back when it ends, not when the
    reused worker needs it again."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from all ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with over one row in so many is heavy; there are at most as many such keys.
HEAVY_SHARE = 1000


def join_by_key(rows: DataFrame, table: DataFrame, key: list[str], counts: DataFrame, few: bool, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and is broadcast if its counted rows are
    ``few``. ``counts`` (the key's columns, n) tells how many ``rows`` each key has.

    Otherwise the rows of heavy keys, of which there are at most HEAVY_SHARE, are joined by broadcast and
    the rest by a shuffle, so that no key gathers a large part of ``rows`` in one task.
    """
    if few:
        return rows.join(F.broadcast(table), key, how)
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(table.join(F.broadcast(counts.where(F.col("n") > total / HEAVY_SHARE).select(*key)), key))
    keys = F.broadcast(heavy.select(*key))
    light = rows.join(keys, key, "left_anti").join(table.join(keys, key, "left_anti"), key, how)
    return rows.join(heavy, key).unionByName(light)
