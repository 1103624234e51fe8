"""Registries of venues, hints, countries and languages, and what a run writes: events, pages, copies.

A registry is written to a new path; the old one stays until the caller points to the new one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charsets import decoded_or_null
from ..functions.text import extract_body, minimalize_basic, remove_blanks
from .json_files import write_document
from .pages import fetch_pages, read_map

COUNTRY = "struct<languages:array<string>,cities:array<string>>"


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """country, languages and cities of a registry file."""
    return read_map(spark, path, COUNTRY).select(F.col("key").alias("country"), "value.languages", "value.cities")


def read_dictionary(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """language, entry and value (JSON text) of a dictionary file; of one language if given, letter case
    aside."""
    rows = read_map(spark, path, "map<string,string>").select(F.lower("key").alias("language"), F.explode("value").alias("entry", "value"))
    return rows if language is None else rows.where(F.col("language") == language.lower())


def styles_of(dictionary: DataFrame) -> DataFrame:
    """language, style, ord and word of the dictionary's styles, in their order."""
    listed = dictionary.where("entry = 'styles'").select("language", F.from_json("value", "map<string,array<string>>").alias("m"))
    return listed.select("language", F.posexplode(F.map_entries("m")).alias("ord", "e")).select("language", F.col("e.key").alias("style"), "ord", F.explode_outer("e.value").alias("word"))


def keywords_of(dictionary: DataFrame, entry: str = "cancellationKeywords") -> DataFrame:
    """language and word of a list entry."""
    return dictionary.where(F.col("entry") == entry).select("language", F.explode(F.from_json("value", "array<string>")).alias("word"))


def date_words(dictionary: DataFrame) -> dict[str, dict]:
    """The words of dates of each language that has months and weekdays, as ``functions.date_text`` reads
    them. A dictionary has some dozens of entries, so it comes to the driver."""
    import json

    out: dict[str, dict] = {}
    entries: dict[str, dict] = {}
    for r in dictionary.where("entry <> 'styles'").collect():
        entries.setdefault(r["language"], {})[r["entry"]] = json.loads(r["value"]) if r["value"][:1] in '[{"' else r["value"]
    for language, e in entries.items():
        if "monthsDict" in e and "dayDict" in e:
            special = e.get("specialMarkers", {})
            right = e.get("rightRangeDelimiters", [])
            # a weekday's first entry may be its short form; the whole name is the longest without a plural's end
            out[language] = {
                "weekdays": [sorted(v, key=lambda w: (len(w) < 4, len(w))) for v in e["dayDict"].values()],
                "months": [[k, *v] for k, v in e["monthsDict"].items()],
                "to": list(dict.fromkeys([b for _, b in e.get("rangeDelimiters", [])] + right)),
                "until": right,
                "today": special.get("today", []),
                "tomorrow": special.get("tomorrow", []),
                "except": special.get("exception", []),
                "midnight": list(e.get("timeMarkers", {})),
            }
    return out


def write_registry(rows: DataFrame, path: str) -> None:
    """A registry as JSON lines at a new path."""
    rows.write.json(path)


def write_map(rows: DataFrame, key: str, value: str, path: str) -> None:
    """``read_map`` reads it back: objects of one key each, one a line."""
    rows.select(F.to_json(F.create_map(F.col(key), F.col(value))).alias("value")).write.text(path)


def read_map_lines(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    return spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,{value}>")))


def pretty_json(columns: list[str]) -> Column:
    """A row as an indented JSON object."""
    return F.to_json(F.struct(*columns), {"pretty": "true"})


def write_events(events: DataFrame, path: str, error: str = "errorLog", *order: str) -> None:
    """All events in ``<path>/all/document.json``, and those with an error below ``<path>/errors``: each one
    JSON array of indented objects, in the order of the columns ``order``, else of ``events``' own first ones."""
    order = order or tuple(c for c, kind in events.dtypes if not kind.startswith("map"))
    shown = events.select(*events.columns, pretty_json(events.columns).alias("value"))
    write_document(shown, f"{path}/all", *order)
    write_document(shown.where(F.col(error).isNotNull()), f"{path}/errors", *order)


def read_error_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of a log of JSON arrays, objects or lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (country, city, venue, page_no, html, ...) below a folder for each venue. The folders of the
    venues at hand are replaced, all others stay."""
    spread = pages.repartition("country", "city", "venue")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country", "city", "venue").parquet(path)


def write_linked_pages(pages: DataFrame, path: str) -> None:
    """Linked pages (venue_id, url, html) below a folder for each venue, replaced as above."""
    pages.repartition("venue_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("venue_id").parquet(path)


def write_minimal_copies(pages: DataFrame, path: str, shorter: Callable[[Column], Column] = minimalize_basic) -> None:
    """The pages' shorter copies, below the same folders."""
    write_pages(pages.withColumn("html", shorter(F.col("html"))), path)


def decoded(body: Column, content_type: Column) -> Column:
    """The text of downloaded bytes by the charset that their content type names, UTF-8 where it names none;
    null where it names one that is not known (``charsets.charset_error`` says which)."""
    return decoded_or_null(body, content_type)


def fetch_linked_pages(urls: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """url and html of linked pages: fetched with retries, cleaned, their blanks removed, their body taken.
    A page that fails or has no body is null with an error."""
    from ..functions.html import clean_page

    got = fetch_pages(urls, fetch)
    html = extract_body(remove_blanks(clean_page(F.col("html"))))
    return got.select("url", html.alias("html"), F.coalesce("error", F.when(html.isNull(), "no body")).alias("error"))
