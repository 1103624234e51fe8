"""Tables written once in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OPEN: ContextVar[list[str] | None] = ContextVar("_OPEN", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one of our own in local mode, an error on a
    cluster, whose executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to storage that the driver and all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _OPEN.get()) is not None and not keep:
        paths.append(path)
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written and read back: it is computed once, however often it is used, a lost executor costs a
    reread, and joins are planned with its real size. ``keep``: it outlasts a ``temporary`` around it."""
    path = _new_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """How many parts tables are dealt into: as many as a shuffle of the session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, name: str, *keys: str, there: bool = False) -> DataFrame:
    """As ``written``, in buckets of the keys: tables dealt by the same keys are joined, grouped and numbered by them,
    or by them and more columns, where they lie. ``there``: the rows of each task are of one bucket already.

    The catalog knows the table only until it is read back, since buckets are asked for by a table's name. Its columns are
    named anew: with that name in them a union forgets the buckets."""
    spark = df.sparkSession
    path, table, n = _new_path(spark, name), f"agendaflow_{uuid.uuid4().hex}", parts(spark)
    (df if there else df.repartition(n, *keys)).write.bucketBy(n, *keys).option("path", path).saveAsTable(table)
    try:
        return spark.table(table).toDF(*df.columns)
    finally:
        spark.sql(f"DROP TABLE {table}")


@contextmanager
def temporary(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Tables written inside are deleted when it ends; the settings (dots as ``__``) hold for the jobs that run inside."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    paths: list[str] = []
    token = _OPEN.set(paths)
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        _OPEN.reset(token)
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
