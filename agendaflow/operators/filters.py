"""Selections of venues and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import simplify

ANY = ("*", "?", None)


def select_venues(venues: DataFrame, name: str | None = None, city: str | None = None, country: str | None = None) -> DataFrame:
    """Venues of a name, city and country, compared as simplified keys; ``*``, ``?`` or None is any."""
    for column, value in (("name", name), ("city", city), ("country", country)):
        if value not in ANY:
            venues = venues.where(simplify(F.col(column)) == simplify(F.lit(value)))
    return venues


def find_venue(venues: DataFrame, venue_id: str) -> DataFrame:
    return venues.where(simplify(F.col("id")) == simplify(F.lit(venue_id)))


def is_active(url: Column, main_page: Column) -> Column:
    return url.isNotNull() & main_page.isNotNull()


def reject_reason(venue: DataFrame, has_files: Column) -> DataFrame:
    """Venues with ``reject_reason``: the first thing that scraping lacks, null if nothing."""
    keys = F.concat(F.coalesce(F.map_keys("mainPage"), F.array()), F.coalesce(F.map_keys("linkedPage"), F.array()))
    has = lambda kind: F.exists(keys, lambda k: k.like(f"%{kind}%"))
    reason = (
        F.when(F.col("url").isNull(), "no url")
        .when(~has_files, "no files")
        .when(F.col("eventsDelimiterTag").isNull(), "no delimiter")
        .when(F.col("mainPage").isNull(), "no main page")
        .when(~has("Name"), "no name key")
        .when(~has("Date"), "no date key")
    )
    return venue.withColumn("reject_reason", reason)


def is_valid_event(name: Column, date: Column, scrapes_name: Column, scrapes_date: Column) -> Column:
    """Name and date are not blank, as far as the recipe takes them from the main page."""
    return (~scrapes_name | (F.trim(F.coalesce(name, F.lit(""))) != "")) & (~scrapes_date | (F.trim(F.coalesce(date, F.lit(""))) != ""))


def is_empty_event(name: Column, date: Column, url: Column) -> Column:
    """Empty name and date, and no address; null is not empty."""
    return F.coalesce((name == "") & (date == ""), F.lit(False)) & (F.coalesce(url, F.lit("")) == "")


def is_cancelled(text: Column, keywords: Sequence[str]) -> Column:
    """The simplified text holds a simplified keyword."""
    plain = simplify(text)
    out = F.lit(False)
    for k in keywords:
        out = out | plain.contains(simplify(F.lit(k)))
    return F.coalesce(out, F.lit(False))


def day_window(events: DataFrame, time: str, start, styles: Sequence[str] | None = None, style: str = "style", whole: bool = False) -> DataFrame:
    """Events of the day that begins at ``start`` (half open), or from then on if ``whole``; of any of
    the ``styles`` if given, and of none if that list is empty."""
    t = F.col(time)
    inside = (t >= start) if whole else (t >= start) & (t < start + F.expr("INTERVAL 1 DAY"))
    if styles is not None:
        inside = inside & (F.col(style).isin(list(styles)) if styles else F.lit(False))
    return events.where(inside)


def last_title_per_place(events: DataFrame, start, place: str, title: str, time: str, seq: Sequence[str]) -> DataFrame:
    """For each place the last title strictly inside the day."""
    t = F.col(time)
    today = events.where((t > start) & (t < start + F.expr("INTERVAL 1 DAY")))
    return today.groupBy(place).agg(F.max_by(title, F.struct(*seq)).alias(title))


def similar_name(a: Column, b: Column) -> Column:
    """Simplified names of which one contains the other."""
    x, y = simplify(a), simplify(b)
    return x.contains(y) | y.contains(x)


def same_place(a: Column, b: Column) -> Column:
    """Two structs of name, city and country are one place: simplified names, exact cities and countries."""
    return (simplify(a["name"]) == simplify(b["name"])) & (a["city"] == b["city"]) & (a["country"] == b["country"])


def same_places(a: DataFrame, b: DataFrame, key: str, other: str) -> DataFrame:
    """For each place of ``a`` (its ``key``, name, city, country) the first of the places of ``b`` that are the same,
    and how many are: ``key``, ``other`` and n, 0 where there is none. Places meet by their simplified name,
    city and country, after ``b`` is one row for each, so no two lists are ever paired."""
    same = ["__name", "city", "country"]
    known = b.withColumn("__name", simplify(F.col("name"))).groupBy(*same).agg(F.min(other).alias(other), F.count("*").alias("__count"))
    return a.withColumn("__name", simplify(F.col("name"))).join(known, same, "left").select(key, other, F.coalesce("__count", F.lit(0)).alias("n"))


def same_day(a_ms: Column, b_ms: Column, zone: str) -> Column:
    day = lambda c: F.to_date(F.from_utc_timestamp(F.timestamp_millis(c), zone))
    return day(a_ms) == day(b_ms)


def drop_style(events: DataFrame, style: Column, name: str = "Theatre") -> DataFrame:
    """Without one style; rows without a style stay."""
    return events.where(~style.eqNullSafe(F.lit(name)))


def is_local(place: Column, source: Column) -> Column:
    """The site lists an event at its own place."""
    return F.coalesce(place == source, F.lit(False))


def by_id_prefix(venues: DataFrame, prefix: str) -> DataFrame:
    """Venues whose id begins so: id, n (how many there are), unique. A prefix that several share names
    none of them."""
    found = venues.where(F.col("id").startswith(prefix))
    return found.agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 0").withColumn("unique", F.col("n") == 1)
