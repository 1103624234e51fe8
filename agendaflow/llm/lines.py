"""Line removal by how common a line is on its own site; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, free_names, join_by_key

RATIO = 0.3
#: Pages that must have a line of their site before it counts as the site's: one page alone repeats nothing.
LEAST_WITH = 2
#: Documents that a source must have before its lines count as the site's.
LEAST_PAGES = 5
#: Distinct texts that must have a line before it counts as the site's, where copies are still present.
LEAST_TEXTS = 5
#: Common lines (8 bytes each) that are broadcast at most.
MOST_BROADCAST = 1_000_000


def _keys(lines: Column) -> Column:
    """The distinct non-blank lines as 64-bit hashes; no two lines of one site are expected to share one
    below some billions of lines, and the site is part of the key."""
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x))))


def drop_boilerplate_lines(df: DataFrame, host: Column, text: Column, out: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, least_texts: int = 0, least_with: int = 1) -> DataFrame:
    """``df`` with column ``out``: ``text`` without the lines that over ``ratio`` of the host's pages, and at
    least ``least_with`` of them, have.

    A line is compared without blanks at its ends; blank lines stay. A page counts once for a line it
    repeats. Hosts of fewer than ``least_pages`` pages keep all lines, and so do rows of null host;
    null text stays null; all rows, repeats and columns stay; an empty table stays empty.

    With ``least_texts``, pages of the same distinct lines count as one page, so that copies don't make
    a line common, and a line of fewer than ``least_texts`` such pages stays.

    Counts are combined before they are shuffled. A host can have at most (mean lines a page / ratio)
    common lines, so they come back to the pages as one short array a host: by broadcast while they are
    few in all, else by a shuffle on the host, from which hosts of very many pages are kept out.
    """
    name, own = free_names([*df.columns, out], "host", "own")
    pages = df.withColumns({name: host, own: text})
    known = pages.where(F.col(name).isNotNull()).select(F.col(name).alias("host"), _keys(F.split(own, "\n")).alias("keys"))
    distinct = known.distinct() if least_texts else known
    totals = distinct.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    counts = distinct.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    found = (
        counts.where((F.col("n") > ratio * least_pages) & (F.col("n") >= max(least_texts, least_with)))
        .join(totals, "host")
        .where(F.col("n") > ratio * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_set("key").alias("common"), F.max("pages").alias("n"))
    )
    found = cut(found, "site-lines")  # so that its size is known where the join is planned
    total = found.agg(F.sum(F.size("common") + 2).alias("n")).first()["n"] or 0
    common, bad = free_names([*df.columns, out, name, own], "common", "bad")
    table = found.select(F.col("host").alias(name), F.col("common").alias(common))
    joined = join_by_key(pages, table, [name], found.select(F.col("host").alias(name), "n"), total <= MOST_BROADCAST)
    # a page's own common lines are few, and are found by one hashed intersection
    joined = joined.withColumn(bad, F.array_intersect(_keys(F.split(own, "\n")), F.col(common)))
    kept = F.filter(F.split(own, "\n"), lambda x: (F.trim(x) == "") | ~F.array_contains(bad, F.xxhash64(F.trim(x))))
    cleaned = F.when(F.coalesce(F.size(bad), F.lit(0)) <= 0, F.col(own)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(out, cleaned).drop(name, own, common, bad)


def page_host(url: Column) -> Column:
    """The host of an http(s) address, lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/:?#]+)", 1)), F.lit(""))


def page_lines(html: Column) -> Column:
    """The visible text of a page, one line for each run between tags."""
    bare = F.regexp_replace(html, "(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "\n")
    return F.regexp_replace(bare, "<[^>]+>", "\n")


def clean_pages(pages: DataFrame, ratio: float = RATIO, least_pages: int = 1, least_with: int = LEAST_WITH) -> DataFrame:
    """page_id, host, text (distinct site lines only, blank lines squeezed) and n_lines of every page.

    Sites of any size count; a line goes if over ``ratio`` of the site's pages, and at least
    ``least_with``, have it. A page without an address keeps its lines; null markup gives null text and
    a null count; repeated pages count each; other columns don't matter; an empty table gives no rows.
    """
    cleaned = drop_boilerplate_lines(pages.select("page_id", "url", "html"), page_host(F.col("url")), page_lines(F.col("html")), "clean", ratio, least_pages, 0, least_with)
    lines = F.filter(F.transform(F.split("clean", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return cleaned.select("page_id", page_host(F.col("url")).alias("host"), lines.alias("lines")).select(
        "page_id", "host", F.array_join("lines", "\n").alias("text"), F.size("lines").cast("long").alias("n_lines")
    )


def clean_documents(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, least_texts: int = 0) -> DataFrame:
    """Documents, taking ``source`` as the site; n_chars follows the text where that column exists."""
    out = drop_boilerplate_lines(docs, F.col("source"), F.col("text"), "text", ratio, least_pages, least_texts)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_oracle(ratio: float = RATIO, least_with: int = LEAST_WITH) -> str:
    return f"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '') AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(html,
           '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', chr(10), 'g'), '<[^>]+>', chr(10), 'g'), chr(10)),
           lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS n FROM p WHERE host IS NOT NULL GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
b AS (SELECT c.host, list(c.line) AS common FROM c JOIN t USING (host) WHERE c.n > {ratio} * t.n AND c.n >= {least_with} GROUP BY c.host),
k AS (SELECT page_id, p.host, list_filter(lines, lambda x: NOT list_contains(coalesce(b.common, []), x)) AS lines FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, array_to_string(lines, chr(10)) AS text, CAST(len(lines) AS BIGINT) AS n_lines FROM k
"""
