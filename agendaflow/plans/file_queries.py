"""Files and values: documents written and read in parts, scrapes in versions, charsets, JSON values, dictionaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import charsets, json_values
from ..functions.text import simplify
from ..storage import shared_folder
from .registry import query, sql_simplify, table


@query("SELECT event_id, event_type, value, props FROM events")
def json_document_round_trip(spark, sf_dir):
    """All events as one JSON array, in order, written by many tasks and read in many chunks."""
    from ..sources.json_files import read_large_array, write_document

    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "value", "props")).alias("value"))
    write_document(rows, path, "event_id")
    return read_large_array(spark, path, "event_id long, event_type string, value double, props string")


@query("SELECT url, max(html) AS html FROM pages GROUP BY url")
def large_map_round_trip(spark, sf_dir):
    """All pages as one JSON object from addresses to markup, read in many chunks."""
    from ..sources.json_files import read_large_map, write_document

    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").groupBy("url").agg(F.max("html").alias("html"))
    entry = F.regexp_replace(F.to_json(F.array(F.create_map("url", "html"))), "^\\[\\{|\\}\\]$", "")
    write_document(pages.select("url", entry.alias("value")), path, "url", head="{", separator=",", tail="}")
    return read_large_map(spark, path, 1 << 20).select(F.col("key").alias("url"), F.col("value").alias("html"))


_KEY = "regexp_extract(url, '^https?://[^/]+/([^/?]*)', 1)"


@query(f"WITH p AS (SELECT page_id, {_KEY} AS section FROM pages), again AS (SELECT * FROM p WHERE page_id % 5 = 0 AND section IN ('fr', 'de')) SELECT * FROM again UNION ALL SELECT * FROM p WHERE section NOT IN (SELECT section FROM again)")
def replaced_pages(spark, sf_dir):
    """A scrape of all pages in three batches, one of which runs twice, then one of two sections that finds fewer."""
    from ..streaming.pages import current_pages, write_batch

    path = f"{shared_folder(spark)}/scrapes-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_KEY).alias("section"))
    for batch in (0, 1, 1, 2):
        write_batch(pages.where(F.col("page_id") % 3 == batch), batch, path, "section", "1")
    write_batch(pages.where("page_id % 5 = 0 AND section IN ('fr', 'de')"), 0, path, "section", "2")
    return current_pages(spark, path, "section")


_BYTES = "regexp_replace(text, '[^\\x00-\\x7F\\xA0-\\xFF]', '?', 'g')"


@query(
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {_BYTES} || '€' WHEN 1 THEN translate({_BYTES}, '¤¦¨´¸¼½¾', '€ŠšŽžŒœŸ') || chr(128) WHEN 2 THEN text END AS decoded,
    CASE WHEN doc_id % 4 = 3 THEN 'unknown charset: klingon' END AS error FROM documents"""
)
def decoded_documents(spark, sf_dir):
    """Texts as bytes of two single-byte charsets, of UTF-8 without a name, and of a charset that nobody knows."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    single = F.encode(F.concat(F.regexp_replace("text", "[^\\x00-\\x7F\\xA0-\\xFF]", "?"), F.lit("\x80")), "ISO-8859-1")
    body = F.when(k < 2, single).otherwise(F.encode("text", "UTF-8"))
    kind = F.when(k == 0, "text/html; charset=Windows-1252").when(k == 1, "text/html;charset='iso-8859-15'").when(k == 2, "text/html").otherwise("text/html; charset=klingon; q=1")
    return docs.select("doc_id", charsets.decoded_or_null(body, kind).alias("decoded"), charsets.charset_error(kind).alias("error"))


_PROPS = """CASE WHEN event_id % 2 = 0 THEN '{"t": "' || event_type || '", ' || substr(props, 2) ELSE substr(props, 1, length(props) - 1) || ',"t":"' || event_type || '"}' END"""


@query(f"SELECT min(event_id) AS event_id, arg_min({_PROPS}, event_id) AS props FROM events GROUP BY event_type, props")
def distinct_json_values(spark, sf_dir):
    """Events' properties in two orders and spacings: one row for each value."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_PROPS.replace('"', '\\"').replace("'", '"')).alias("props"))
    return json_values.distinct_json(rows, "props", "event_id")


_SENTENCE = "regexp_extract(text, '^[^.]+', 0)"


@query(
    f"""WITH d AS (SELECT doc_id, text, {sql_simplify("text")} AS plain FROM documents), w AS (SELECT item_id, {sql_simplify(_SENTENCE)} AS word FROM benchmark),
    f AS (SELECT doc_id, max(item_id) AS item_id FROM d JOIN w ON contains(plain, word) GROUP BY doc_id)
    SELECT doc_id, coalesce('item ' || item_id, text) AS found_style FROM d LEFT JOIN f USING (doc_id)"""
)
def styles_by_large_dictionary(spark, sf_dir):
    """Each document's last benchmark sentence, all sentences being one dictionary."""
    from ..operators.places import styles_by_dictionary

    words = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), "item_id").alias("style"), F.expr(_SENTENCE).alias("word"), F.col("item_id").alias("ord"))
    return styles_by_dictionary(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", words).select("doc_id", "found_style")
