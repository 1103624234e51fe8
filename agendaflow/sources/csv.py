"""Place and event files: lines of fields without quoting rules of their own."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maps import choose
from ..functions.text import parse_number

#: Icons of place genres (fixed values).
ICONS = {"music": "music", "theatre": "theatre", "institut": "museum", "art": "art-gallery"}


def read_places(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Places of ``<country>/<city>_place.csv`` files: name, latitude, longitude, address and maybe a
    genre, comma separated. The header and blank lines are skipped; a number may be followed by more."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    f = F.transform(F.split("value", ","), lambda x: F.trim(x))
    at = lambda k: F.get(f, F.lit(k))
    rows = lines.where((F.trim("value") != "") & ~F.col("value").startswith("PLACE,")).select(
        at(0).alias("title"), parse_number(at(1)).alias("latitude"), parse_number(at(2)).alias("longitude"), F.nullif(at(3), F.lit("")).alias("url"), F.nullif(at(4), F.lit("")).alias("genre"),
        F.regexp_extract("path", "([^/]+)_place\\.csv$", 1).alias("city"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("country"),
    )
    return rows.withColumn("icon", choose(F.coalesce("genre", F.lit("")), ICONS, "dot-11"))


def event_line() -> Column:
    """An event as one line: place, name, time, size 100, style, detailed style, address, time of day and
    text of the date. Fields are not quoted, so a semicolon inside one moves those after it; a null
    field is empty."""
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws(";", field("place"), field("eventName"), field("unixDate"), F.lit("100"), field("style"), field("detailedStyle"), field("eventURL"), field("eventTime"), field("eventDate"))


def parse_event_line(line: Column) -> Column:
    """The fields of such a line; the eighth is shown as the time, the ninth is kept as well."""
    f = F.split(line, ";")
    at = lambda k: F.get(f, F.lit(k))
    return F.struct(
        at(0).alias("place"), at(1).alias("title"), F.nullif(F.regexp_extract(at(2), "^\\s*(-?\\d+)", 1), F.lit("")).cast("long").alias("time"), F.nullif(F.regexp_extract(at(3), "^\\s*(-?\\d+)", 1), F.lit("")).cast("int").alias("size"),
        at(4).alias("style"), F.nullif(at(5), F.lit("")).alias("detailedStyle"), at(6).alias("url"), at(7).alias("time_string"), at(8).alias("date_text"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a file of such lines; blank lines are skipped. A file that is not there gives no events and
    a warning, as a city need not have one."""
    if not _exists(spark, path):
        warnings.warn(f"no events at {path}", stacklevel=2)
        return spark.range(0).select(parse_event_line(F.lit("")).alias("e")).select("e.*")
    return spark.read.text(path).where(F.trim("value") != "").select(parse_event_line(F.col("value")).alias("e")).select("e.*")


def write_events(events: DataFrame, path: str) -> None:
    more = {c: F.lit(None).cast("string") for c in ("eventTime", "eventDate") if c not in events.columns}
    events.withColumns(more).select(event_line().alias("value")).write.text(path)


def parse_legacy_line(line: Column, city: str) -> Column:
    """An older list's line: name, latitude, longitude, site, genre; the name is its own alias."""
    f = F.split(line, ",")
    at = lambda k: F.trim(F.get(f, F.lit(k)))
    return F.struct(
        at(0).alias("name"), parse_number(at(1)).alias("latitude"), parse_number(at(2)).alias("longitude"), at(3).alias("url"), at(4).alias("genre"), F.lit(city).alias("city"), F.array(at(0)).alias("aliases")
    )


def legacy_places(spark: SparkSession, path: str, city: str = "Lyon") -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(parse_legacy_line(F.col("value"), city).alias("p")).select("p.*")


def write_legacy_places(spark: SparkSession, path: str, out: str, city: str = "Lyon") -> None:
    """Older lists as JSON lines."""
    legacy_places(spark, path, city).write.json(out)
