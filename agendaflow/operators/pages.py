"""Links, blocks and lists of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_valid_url
from .stats import prefix_sums


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each href of each page: the other columns, position and href."""
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.posexplode(F.regexp_extract_all(html, F.lit("href=\"([^\"]*)\""), 1)).alias("pos", "href")).where(is_valid_url(F.col("href")))


def missing_links(links: DataFrame, stored: DataFrame, url: str) -> DataFrame:
    """Addresses that are not stored yet, each once."""
    return links.select(url).where(F.col(url).isNotNull()).distinct().join(stored.select(url), url, "left_anti")


def existing_links(links: DataFrame, stored: DataFrame, url: str) -> DataFrame:
    return stored.join(links.select(url), url, "left_semi")


def with_linked_page(events: DataFrame, linked: DataFrame, url: str) -> DataFrame:
    """Events with the linked page of their address; a miss keeps the row with an error."""
    pages = linked.select(F.col(url), F.col("html").alias("linked_html"))
    out = events.join(pages, url, "left")
    missed = F.col(url).isNotNull() & F.col("linked_html").isNull()
    return out.withColumn("error", F.when(missed, F.concat(F.lit("no linked page: "), F.col(url))))


def blocks(pages: DataFrame, tag: str, html: str = "html") -> DataFrame:
    """The inner markup of each element of a flat tag, numbered from 0."""
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.posexplode(F.regexp_extract_all(html, F.lit(f"<{tag}>([\\s\\S]*?)</{tag}>"), 1)).alias("block_no", "block"))


def with_block_links(blocks: DataFrame, links: DataFrame, *page: str) -> DataFrame:
    """Blocks with the address found for them, by page and block_no."""
    found = links.groupBy(*page, "block_no").agg(F.min("link").alias("link"))
    return blocks.join(found, [*page, "block_no"], "left")


def events_map(events: DataFrame, venue: str, url: str, empty: Column) -> DataFrame:
    """The numbers of a venue's events: event_no counts blocks that are not empty, sub_no the sub-events of
    one, ``key`` is ``event_no`` or ``event_no.sub_no``, and linked_no counts rows with an address, all
    from 0 in the order of page_no, block_no and sub_no. ``events`` has a row for each sub-event; a venue of
    any number of events takes many tasks."""
    order = ["page_no", "block_no", "sub_no"]
    rows = events.where(~empty).withColumn("__subs", F.count("*").over(Window.partitionBy(venue, "page_no", "block_no")))
    first = F.row_number().over(Window.partitionBy(venue, "page_no", "block_no").orderBy("sub_no"))
    rows = rows.withColumn("__sub", first - 1)
    rows = prefix_sums(rows, [venue], order, {"event_no": F.col("__sub") == 0, "linked_no": F.col(url).isNotNull()})
    rows = rows.withColumns({"event_no": F.col("event_no") - 1, "linked_no": F.when(F.col(url).isNotNull(), F.col("linked_no") - 1)})
    key = F.when(F.col("__subs") > 1, F.concat_ws(".", "event_no", "__sub")).otherwise(F.col("event_no").cast("string"))
    return rows.select(venue, *order, "event_no", F.when(F.col("__subs") > 1, F.col("__sub")).alias("sub_index"), key.alias("key"), url, "linked_no")


def changed_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of two events maps that only one of them has, with ``change``: gone or new."""
    gone = before.exceptAll(after).withColumn("change", F.lit("gone"))
    return gone.unionByName(after.exceptAll(before).withColumn("change", F.lit("new")))


def page_list(url: Column, start: Column, increment: Column, pages: Column) -> Column:
    """Addresses of a site's pages: ``{index}`` filled, or the index appended."""
    numbers = F.transform(F.sequence(F.lit(0), pages - 1), lambda i: start + i * increment)
    fill = lambda n: F.when(url.contains("{index}"), F.replace(url, F.lit("{index}"), n.cast("string"))).otherwise(F.concat(url, n.cast("string")))
    return F.when(pages > 0, F.transform(numbers, fill)).otherwise(F.array(url))


def common_prefix(paths: Column) -> Column:
    """The longest common ``>``-prefix of an array of paths."""
    parts = F.transform(paths, lambda p: F.split(p, ">"))
    shortest = F.array_min(F.transform(parts, lambda p: F.size(p)))
    first = F.element_at(parts, 1)
    same = lambda n: F.forall(parts, lambda p: F.slice(p, 1, n) == F.slice(first, 1, n))
    length = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), shortest), same)), F.lit(0))
    return F.array_join(F.slice(first, 1, length), ">")


def sub_events(events: DataFrame, subs: Column, replace: tuple[str, ...], append: tuple[str, ...]) -> DataFrame:
    """A row for each sub-event (an array of structs): ``replace`` fields take its value where it has
    one, ``append`` fields are joined to the event's by a blank; without sub-events the row stays."""
    out = events.withColumn("__sub", F.explode_outer(subs))
    for c in replace:
        out = out.withColumn(c, F.coalesce(F.nullif(F.col("__sub")[c], F.lit("")), F.col(c)))
    for c in append:
        out = out.withColumn(c, F.trim(F.concat_ws(" ", F.col(c), F.col("__sub")[c])))
    return out.drop("__sub")


def detected(selected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """``selected`` elements (iframes by id, name and source, say) with ``detected``: whether the page still has them;
    keys compare as values, nulls as equal."""
    key = F.struct(*keys)
    have = found.select(key.alias("__key")).distinct().withColumn("__found", F.lit(True))
    return selected.withColumn("__key", key).join(have, "__key", "left").select(*selected.columns, F.coalesce("__found", F.lit(False)).alias("detected"))


def repairs_by_source(errors: DataFrame, venues: DataFrame, venue: str, source: str) -> DataFrame:
    """For each source how many of its venues with linked pages have an event in error, and so are scraped again."""
    return venues.join(errors.select(venue).distinct(), venue, "left_semi").groupBy(source).agg(F.count("*").alias("n"))
