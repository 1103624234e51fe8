"""Incremental ingestion of page files: each address once, later versions replace earlier ones."""

from __future__ import annotations

import datetime as dt
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SCHEMA = "url string, html string, fetched timestamp"


def page_stream(spark: SparkSession, folder: str, schema: str = SCHEMA, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def new_links(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Pages whose address has not come within the watermark."""
    return stream.withWatermark("fetched", late).dropDuplicatesWithinWatermark(["url"])


def pages_per_window(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("fetched", late).groupBy(F.window("fetched", window)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def _stored(path: str) -> tuple[str, str]:
    """Pages below the folder itself, by key, scrape and batch, and the manifest of their batches."""
    return path, f"{path.rstrip('/')}/_manifest"


def write_batch(batch: DataFrame, batch_id: int, path: str, key: str = "day", scrape: str = "", source: str = "") -> None:
    """One batch of a scrape. Its files lie in folders of its own, so batches add up, and the same batch again
    overwrites its own files only. The manifest tells afterwards which keys the batch brought, so a batch
    that failed half way is not read."""
    data, manifest = _stored(path)
    part = f"{zlib.crc32(source.encode()):08x}-{batch_id}"
    rows = batch if key in batch.columns else batch.withColumn(key, F.to_date("fetched"))
    rows = rows.withColumns({"scrape": F.lit(f"s{scrape}"), "part": F.lit(part)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key, "scrape", "part").parquet(data)
    brought = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("pages"))
    brought.withColumns({"scrape": F.lit(f"s{scrape}"), "part": F.lit(part)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scrape", "part").parquet(manifest)


def replace_pages(stream: DataFrame, path: str, checkpoint: str, key: str = "day", scrape: str = "") -> StreamingQuery:
    """Stores the pages of a scrape; those that an earlier scrape stored for the same keys are replaced.

    A key is a day, or a venue if ``key`` is that column. ``scrape`` names the scrape; later ones have names
    that sort later (a date, say). All batches of one scrape add up, however many files a key comes in, and
    a batch that runs again changes nothing. ``current_pages`` reads the latest scrape of each key from its
    first finished batch on; ``drop_replaced`` deletes the files of the others.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, path, key, scrape, checkpoint)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(spark: SparkSession, path: str) -> DataFrame:
    """key, scrape and part of the batches that the latest scrape of each key has finished."""
    manifest = spark.read.schema("key string, pages long, scrape string, part string").parquet(_stored(path)[1])
    latest = manifest.groupBy("key").agg(F.max("scrape").alias("latest"))
    both = manifest.alias("m").join(latest.alias("l"), F.col("m.key").eqNullSafe(F.col("l.key")) & (F.col("scrape") == F.col("latest")))
    return both.select(F.col("m.key").alias("key"), "scrape", "part")


def current_pages(spark: SparkSession, path: str, key: str = "day") -> DataFrame:
    """The pages of each key's latest scrape. Folders of other scrapes are not read: the manifest, a row for
    each key and batch, joins on the columns by which files are laid out."""
    pages, latest = spark.read.parquet(_stored(path)[0]), _latest(spark, path)
    same = pages[key].cast("string").eqNullSafe(latest["key"]) & (pages["scrape"] == latest["scrape"]) & (pages["part"] == latest["part"])
    return pages.join(latest, same, "left_semi").drop("scrape", "part")


def drop_replaced(spark: SparkSession, path: str, key: str = "day") -> int:
    """Deletes the folders of scrapes that a later one has replaced; returns how many. Run it when no reader
    is left that began before. The folders of one key and scrape pass the driver, never pages."""
    data, manifest = _stored(path)
    known = spark.read.schema("key string, pages long, scrape string, part string").parquet(manifest)
    latest = known.groupBy("key").agg(F.max("scrape").alias("latest"))
    old = known.alias("m").join(latest.alias("l"), F.col("m.key").eqNullSafe(F.col("l.key")) & (F.col("scrape") < F.col("latest"))).select(F.col("m.key").alias("key"), "scrape").distinct()
    n, base = 0, spark._jvm.org.apache.hadoop.fs.Path(data)
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for r in old.toLocalIterator():
        name = "__HIVE_DEFAULT_PARTITION__" if r["key"] is None else escape(r["key"])
        n += files.delete(spark._jvm.org.apache.hadoop.fs.Path(base, f"{key}={name}/scrape={escape(r['scrape'])}"), True)
    return n


class LinkLife(StatefulProcessor):
    """One address of one venue: told when it is first listed and when it no longer is.

    The state is the last time at which it was listed and whether its page is stored; a timer stands at the
    time from which it counts as gone.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "listed long, stored boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        told = lambda change, ms: Row(venue=key[0], url=key[1], change=change, at=dt.datetime.fromtimestamp(ms / 1000))
        listed, stored = self.last.get() if self.last.exists() else (None, False)
        timer = listed
        for ms, own in sorted((int(r["listed"].timestamp() * 1000), bool(r["stored"])) for r in rows):
            # rows of a batch come before its timers
            if listed is not None and ms >= listed + self.keep_ms:
                yield told("gone", listed + self.keep_ms)
                listed, stored = None, False
            stored = stored or own
            if listed is None and not stored:
                yield told("new", ms)
            listed = ms if listed is None else max(listed, ms)
        if timer is not None and timer != listed:
            self.handle.deleteTimer(timer + self.keep_ms)
        if timer != listed:
            self.handle.registerTimer(listed + self.keep_ms)
        self.last.update((listed, stored))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.last.exists() and self.last.get()[0] + self.keep_ms <= at:
            self.last.clear()
            yield Row(venue=key[0], url=key[1], change="gone", at=dt.datetime.fromtimestamp(at / 1000))

    def close(self) -> None:
        pass


def link_changes(listed: DataFrame, keep: str = "7 days", late: str = "0 seconds") -> DataFrame:
    """venue, url, change and at: ``new`` when a venue first lists an address whose page isn't stored, ``gone``
    when it has not listed it for ``keep`` of event time; listed again after that, it is new again.

    ``listed`` is a stream of (venue, url, listed timestamp, stored boolean). State is kept by venue and
    address, so a venue of any number of links is spread over all tasks, and an address that has gone leaves
    no state. Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``.
    """
    interval = listed.sparkSession.range(1).select(F.expr(f"cast((unix_micros(timestamp'1970-01-01' + interval {keep}) - unix_micros(timestamp'1970-01-01')) / 1000 as long)")).first()[0]
    rows = listed.select("venue", "url", "listed", "stored").withWatermark("listed", late)
    return rows.groupBy("venue", "url").transformWithState(LinkLife(interval), "venue string, url string, change string, at timestamp", "Append", "EventTime")
