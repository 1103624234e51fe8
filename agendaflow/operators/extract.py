"""Pages and recipes to event rows: blocks, fields, sub-fields, linked pages, dates, logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import end_after_start, to_instant
from ..functions.html import event_blocks, extract_fields, recipe_links
from ..functions.text import base_url, make_url
from .date_tokens import first_readings
from .filters import is_cancelled, is_empty_event

_RECIPE = "map<string,array<string>>"
FORMAT = "struct<order:array<string>,month:string,year:string>"


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def blocks_of(pages: DataFrame, venues: DataFrame) -> DataFrame:
    """A row for each event block of each venue's pages, with its fields. ``pages``: venue_id, page_no,
    html; ``venues``: id, url, delimiter, mainPage, linkedPage and maybe alternates. A page is parsed
    once. The venue table is small and broadcast by the optimiser where its size allows."""
    joined = pages.join(venues, pages["venue_id"] == venues["id"])
    found = joined.withColumn("b", F.explode(event_blocks(F.col("html"), F.col("delimiter"), F.col("mainPage"), _optional(venues, "alternates", _RECIPE))))
    return found.select("venue_id", "page_no", "b.block_no", F.col("b.html").alias("block"), "b.href", "b.text", "b.fields", "b.subs", "url", "mainPage", "linkedPage", _optional(venues, "alternates", _RECIPE).alias("alternates"))


def events_of(blocks: DataFrame, linked: DataFrame, cancelled: list[str] = ()) -> DataFrame:
    """Event fields of each block, completed from its linked page (``linked``: url, html), whose fields
    overwrite what is there where they aren't blank. A block with sub-events is an event for each of
    them: URL and place overwrite, other fields follow the block's after a blank. Empty events go; a
    linked page that is missing is an error and the row stays."""
    subs = F.when(F.size("subs") > 0, F.col("subs")).otherwise(F.array(F.lit(None).cast("map<string,string>")))
    events = blocks.select("*", F.posexplode(subs).alias("sub_no", "s"))
    joined = lambda key: F.trim(F.concat_ws(" ", F.col("fields")[key], F.col("s")[key]))
    over = lambda key: F.coalesce(F.nullif(F.col("s")[key], F.lit("")), F.col("fields")[key])
    keys = F.array_distinct(F.concat(F.map_keys("fields"), F.coalesce(F.map_keys("s"), F.array().cast("array<string>"))))
    merged = F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(k.isin("eventURL", "eventPlace"), over(k)).when(F.col("s").isNull(), F.col("fields")[k]).otherwise(joined(k))))
    events = events.withColumn("f", merged)
    link = make_url(F.coalesce(F.nullif(F.col("f")["eventURL"], F.lit("")), F.col("href")), base_url(F.col("url")))
    events = events.withColumn("eventURL", link).withColumn("isCancelled", is_cancelled(F.col("text"), list(cancelled)))
    empty = is_empty_event(F.coalesce(F.col("f")["eventName"], F.lit("")), F.coalesce(F.col("f")["eventDate"], F.lit("")), F.col("eventURL"))
    events = events.where(~empty)
    pages = linked.select(F.col("url").alias("eventURL"), F.col("html").alias("linked_html"))
    events = events.join(pages, "eventURL", "left")
    wants = F.col("linkedPage").isNotNull() & F.col("eventURL").isNotNull()
    more = extract_fields(F.coalesce("linked_html", F.lit("")), F.col("linkedPage"), F.col("alternates"), F.col("f"), linked=True)
    events = events.withColumn("g", F.when(wants & F.col("linked_html").isNotNull(), more).otherwise(F.col("f")))
    field = lambda key: F.col("g")[key].alias(key)
    return events.select(
        "venue_id", "page_no", "block_no", "sub_no", *map(field, ("eventName", "eventDate", "altEventDate", "eventPlace", "eventStyle")),
        "eventURL", "isCancelled", F.when(wants & F.col("linked_html").isNull(), F.concat(F.lit("no linked page: "), "eventURL")).alias("errorLog"),
    )


def links_to_download(pages: DataFrame, venues: DataFrame) -> DataFrame:
    """venue_id and the distinct absolute addresses that its pages' blocks lead to by its recipe."""
    joined = pages.join(venues, pages["venue_id"] == venues["id"])
    found = joined.select("venue_id", "url", F.explode(recipe_links(F.col("html"), F.col("delimiter"), F.col("mainPage"))).alias("href"))
    return found.select("venue_id", make_url(F.col("href"), base_url(F.col("url"))).alias("link")).where("link IS NOT NULL").distinct()


def dated_by(events: DataFrame, formats: Column, as_of: Column, zone: Column, language: Column, alternates: Column | None = None, dictionaries: dict[str, dict] | None = None) -> DataFrame:
    """A row for each date of each event, with unixDate and unixEndDate in milliseconds, hasStartTime and
    n_possibilities. Formats, day, zone and language are those of the row, so venues of all kinds are
    one job.

    The formats (an array of FORMAT: that of the linked page, then of the main page) are tried in turn up
    to one that reads the text in one way; of the last that reads it, the first reading is taken. If none
    does, ``alternates`` are tried on altEventDate. A date that can't be read keeps its row with 0 and an
    error, a blank one with -1; a language without a dictionary reads nothing, a null zone is an error.
    Each distinct text is read once for each format, by tables of its tokens.
    """
    names = events.columns
    found = first_readings(events, "eventDate", formats, as_of, language, dictionaries, "__a")
    if alternates is not None and "altEventDate" in names:
        found = found.withColumn("__other", F.when(F.col("__a.n") == 0, F.col("altEventDate")))
        found = first_readings(found, "__other", alternates, as_of, language, dictionaries, "__b")
        found = found.withColumn("__a", F.when(F.col("__b.n") > 0, F.col("__b")).otherwise(F.col("__a"))).drop("__b", "__other")
    found = found.withColumn("__zone", zone).withColumn("n_possibilities", F.coalesce(F.col("__a.n"), F.lit(0)))
    rows = found.select(*names, "n_possibilities", "__zone", F.posexplode_outer(F.filter("__a.dates", lambda d: d["start_date"].isNotNull())).alias("date_no", "d"))

    def instant(day, time):
        d = F.to_date(F.col(day))
        return to_instant(F.year(d), F.month(d), F.dayofmonth(d), F.col(time), F.col("__zone"))

    blank = F.trim(F.coalesce("eventDate", F.lit(""))) == ""
    blank = blank & F.col("d").isNull()
    start = instant("d.start_date", "d.start_time")
    failed = F.when(F.col("d").isNull() & ~blank, "unreadable date").when(F.col("d").isNotNull() & F.col("__zone").isNull(), "no time zone")
    out = rows.withColumns({
        "unixDate": F.when(blank, F.lit(-1)).otherwise(F.coalesce(start, F.lit(0))),
        "unixEndDate": F.when(F.col("d.end_date").isNotNull(), end_after_start(start, instant("d.end_date", "d.end_time"))),
        "hasStartTime": F.col("d.start_time").isNotNull(),
        "errorLog": F.when(failed.isNotNull(), F.concat_ws(" | ", "errorLog", failed)).otherwise(F.col("errorLog")),
    })
    return out.drop("d", "__zone")


def dated(events: DataFrame, order: list[str], months: str, years: str | None, as_of: dt.date, zone: str, language: str = "french") -> DataFrame:
    """``dated_by`` with one format, day, zone and language for all rows."""
    one = F.struct(F.array(*map(F.lit, order)).alias("order"), F.lit(months).alias("month"), F.lit(years).cast("string").alias("year"))
    return dated_by(events, F.array(one), F.lit(as_of), F.lit(zone), F.lit(language))


def infer_date_format(texts: DataFrame, group: str, text: str, words: dict) -> DataFrame:
    """Month and year style of each group's date strings by the share of strings that match (over one
    half): month long, short or numeric; year long, short or none."""
    plain = F.lower(F.translate(text, "éèêàûôîçÉÈÊÀÛÔÎÇ", "eeeauoiceeeauoic"))
    share = lambda pattern: F.avg(plain.rlike(pattern).cast("int"))
    long = "|".join(names[0] for names in words["months"])
    short = "|".join(n for names in words["months"] for n in names[1:] or names)
    s = texts.groupBy(group).agg(
        share(f"\\b({long})\\b").alias("long"), share(f"\\b({short})\\b").alias("short"), share("\\b(19|20)\\d{2}\\b").alias("year4"), share("\\b\\d{1,2}[./ ]\\d{1,2}[./ ]\\d{2}\\b").alias("year2")
    )
    month = F.when(F.col("long") > 0.5, "long").when(F.col("short") > 0.5, "short").otherwise("numeric")
    year = F.when(F.col("year4") > 0.5, "long").when(F.col("year2") > 0.5, "short")
    return s.select(group, month.alias("month"), year.alias("year"))
