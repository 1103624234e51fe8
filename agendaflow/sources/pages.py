"""Stored pages, linked pages and registries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract_body

#: Attempts of a download and the wait between them in seconds (fixed values).
ATTEMPTS, WAIT = 2, 2.0


def read_pages(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Pages below ``<root>/<country>/<city>/<venue>/<name>[n].html``: country, city, venue, page_no,
    html (the body) and modified. ``most`` limits the page numbers."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(root)
    path = F.regexp_replace(F.replace(F.col("_metadata.file_path"), F.lit("%20"), F.lit(" ")), "[?#].*$", "")
    part = lambda k: F.element_at(F.split(path, "/"), -k)
    number = F.coalesce(F.nullif(F.regexp_extract(path, "(\\d+)\\.html$", 1), F.lit("")).cast("int"), F.lit(0))
    pages = raw.select(part(4).alias("country"), part(3).alias("city"), part(2).alias("venue"), number.alias("page_no"), F.coalesce(extract_body(F.col("value")), "value").alias("html"), F.col("_metadata.file_modification_time").alias("modified"))
    return pages if most is None else pages.where(F.col("page_no") < most)


def join_pages(pages: DataFrame) -> DataFrame:
    """One row for each venue: its pages in order, joined by line breaks, their number and date."""
    listed = F.array_sort(F.collect_list(F.struct("page_no", "html")))
    return pages.groupBy("country", "city", "venue").agg(F.array_join(F.transform(listed, lambda x: x["html"]), "\n").alias("html"), F.count("*").alias("n_pages"), F.min("modified").alias("modified"))


def read_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """A JSON object file as rows of key and value (linked pages, registries, hints)."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """(country, city, tz): a country has one zone, or one for each city."""
    raw = read_map(spark, path)
    cities = raw.where(F.col("value").startswith("{")).select(F.col("key").alias("country"), F.explode(F.from_json("value", "map<string,string>")).alias("city", "tz"))
    return cities.unionByName(raw.where(~F.col("value").startswith("{")).select(F.col("key").alias("country"), F.lit(None).cast("string").alias("city"), F.col("value").alias("tz")))


def fetch_pages(urls: DataFrame, fetch: Callable[[str], str], attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """url, html and error for a column ``url``; ``fetch`` is the caller's, tried ``attempts`` times.
    Spread the addresses first with ``repartition`` to bound how many are asked at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                html, error = None, None
                for k in range(attempts):
                    try:
                        html, error = fetch(url), None
                        break
                    except Exception as e:  # the caller's function may raise anything; it becomes a value
                        error = str(e)
                        time.sleep(wait if k + 1 < attempts else 0)
                rows.append((url, html, error))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, error string")
