"""GeoJSON collections of places and events."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maps import event_id, place_feature
from .json_files import write_document


def place_features(places: DataFrame) -> DataFrame:
    feature = place_feature(F.col("title"), F.col("longitude"), F.col("latitude"), F.col("icon"), F.col("url"), F.col("city"))
    return places.select("country", "city", feature.alias("feature"))


#: A FeatureCollection around its features.
COLLECTION = {"head": '{"type":"FeatureCollection","features":[', "separator": ",", "tail": "]}"}


def write_collections(features: DataFrame, path: str, *by: str, head: str | None = None) -> None:
    """The features, by id, as one FeatureCollection in ``<path>/document.json``, or one below
    ``<path>/<column>=<value>/`` for each value of the columns ``by``; of any size."""
    rows = features.select(*by, F.col("feature.id").alias("id"), F.to_json("feature").alias("value"))
    write_document(rows, path, "id", by=by, **(COLLECTION | ({"head": head} if head else {})))


def merge_template(template: str) -> str:
    """The head of a collection that goes on after the features of a template (JSON text)."""
    held = json.loads(template)
    rest = {k: v for k, v in held.items() if k != "features"}
    own = ",".join(json.dumps(f, ensure_ascii=False, separators=(",", ":")) for f in held.get("features") or [])
    return json.dumps(rest, ensure_ascii=False, separators=(",", ":"))[:-1] + ("," if rest else "") + '"features":[' + own


def collections(features: DataFrame, *by: str) -> DataFrame:
    """One FeatureCollection as JSON text for each group, features by id: for groups that fit a row, such as
    the collection of one small city. ``write_collections`` writes groups of any size."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("feature.id").alias("id"), F.to_json("feature").alias("j"))))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(listed, lambda x: x["j"]), ","), F.lit("]}"))
    return features.groupBy(*by).agg(text.alias("value"), F.count("*").alias("n"))


def write_place_files(places: DataFrame, path: str) -> None:
    """``<path>/country=.../city=...`` with one collection each."""
    write_collections(place_features(places), path, "country", "city")


def event_features(events: DataFrame, *by: str) -> DataFrame:
    """Features of events (place, title, time, size, style, detailedStyle, url, longitude, latitude)."""
    properties = F.struct("title", "size", F.lit("dot-11").alias("icon"), "place", "style", "detailedStyle", "time", F.col("url").alias("description"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    return events.select(*by, F.struct(F.lit("Feature").alias("type"), event_id(F.col("place"), F.col("title"), F.col("time")).alias("id"), geometry.alias("geometry"), properties.alias("properties")).alias("feature"))


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The features of collection files: id, longitude, latitude and the named properties (DDL)."""
    schema = f"features array<struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<{properties}>>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return found.select("f.id", F.col("f.geometry.coordinates")[0].alias("longitude"), F.col("f.geometry.coordinates")[1].alias("latitude"), "f.properties.*")


def rendered_log(fields: list[str], log: str) -> Column:
    """An event as text, field by field, its log last."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in [*fields, log]], F.lit(""))


def write_logs(events: DataFrame, log: str, path: str) -> None:
    """Rows that have the log, as text."""
    events.where(F.col(log).isNotNull()).select(rendered_log([c for c in events.columns if c != log], log).alias("value")).write.text(path)


def write_world_file(places: DataFrame, path: str) -> None:
    """All places as one collection."""
    write_collections(place_features(places), path)


def write_event_files(events: DataFrame, path: str) -> None:
    """``<path>/city=...`` with one collection of the events of each city."""
    write_collections(event_features(events.where("city IS NOT NULL"), "city"), path, "city")
