"""Filters, counts and choices over the ``events`` table: event_type is the style, user_id the place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, stats
from .registry import query, table

START = "2024-01-10"
_T = f"TIMESTAMP '{START} 00:00:00'"


def _start():
    return F.expr(f"timestamp_ntz'{START} 00:00:00'")


@query(
    f"""
WITH n AS (SELECT user_id AS place, count(*) AS n FROM events WHERE ts > {_T} GROUP BY 1),
p AS (SELECT DISTINCT c_custkey AS place FROM customer)
SELECT coalesce(p.place, n.place) AS place, coalesce(n.n, 0) AS n FROM p FULL JOIN n ON p.place = n.place
"""
)
def upcoming_per_place_zero_filled(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("place"), "ts")
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"))
    return stats.upcoming_per_place(events, places, _start(), "place", "ts")


@query(f"SELECT event_id, user_id, event_type FROM events WHERE ts >= {_T} AND ts < {_T} + INTERVAL 1 DAY")
def events_day_window(spark, sf_dir):
    return filters.day_window(table(spark, sf_dir, "events"), "ts", _start()).select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, user_id, event_type FROM events WHERE ts >= {_T}")
def events_from_day(spark, sf_dir):
    return filters.day_window(table(spark, sf_dir, "events"), "ts", _start(), whole=True).select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, event_type FROM events WHERE ts >= {_T} AND ts < {_T} + INTERVAL 1 DAY AND event_type IN ('view', 'click')")
def events_style_day_window(spark, sf_dir):
    return filters.day_window(table(spark, sf_dir, "events"), "ts", _start(), ["view", "click"], "event_type").select("event_id", "event_type")


@query(f"SELECT 'none' AS styles, count(*) FILTER (false) AS n FROM events UNION ALL SELECT 'view', count(*) FROM events WHERE ts >= {_T} AND ts < {_T} + INTERVAL 1 DAY AND event_type = 'view'")
def events_no_active_style(spark, sf_dir):
    """No active style shows nothing, one shows its events."""
    shown = lambda name, styles: filters.day_window(table(spark, sf_dir, "events"), "ts", _start(), styles, "event_type").agg(F.lit(name).alias("styles"), F.count("*").alias("n"))
    return shown("none", []).unionByName(shown("view", ["view"]))


@query(f"SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts > {_T} AND ts < {_T} + INTERVAL 1 DAY GROUP BY user_id")
def todays_last_title_per_place(spark, sf_dir):
    return filters.last_title_per_place(table(spark, sf_dir, "events"), _start(), "user_id", "event_type", "ts", ["ts", "event_id"])


@query(f"SELECT event_type, count(*) AS n FROM events WHERE ts > {_T} GROUP BY 1")
def upcoming_per_style(spark, sf_dir):
    return stats.upcoming_per_style(table(spark, sf_dir, "events"), _start(), "event_type", "ts")


@query(f"SELECT user_id, count(*) AS n FROM events WHERE ts > {_T} GROUP BY 1 HAVING count(*) >= 2")
def places_with_two_or_more(spark, sf_dir):
    return stats.upcoming_per_style(table(spark, sf_dir, "events"), _start(), "user_id", "ts", 2)


@query(f"SELECT event_type, count(*) AS n FROM events WHERE ts > {_T} GROUP BY 1 HAVING count(*) >= 2")
def styles_with_two_or_more(spark, sf_dir):
    return stats.upcoming_per_style(table(spark, sf_dir, "events"), _start(), "event_type", "ts", 2)


@query(f"SELECT count(*) AS n FROM events WHERE ts > {_T}")
def active_events_total(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("ts") > _start()).agg(F.count("*").alias("n"))


@query(
    """
SELECT CAST(d AS DATE) AS day, n.n FROM generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY) t(d)
LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) n ON n.day = CAST(d AS DATE)
"""
)
def events_per_day_densified(spark, sf_dir):
    return stats.per_day(table(spark, sf_dir, "events"), F.to_date("ts"), "2024-01-01", "2024-12-31")


@query(
    """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM c QUALIFY rank() OVER (PARTITION BY user_id ORDER BY n DESC) = 1
"""
)
def most_frequent_ties(spark, sf_dir):
    return stats.most_frequent(table(spark, sf_dir, "events"), "user_id", "event_type")


@query(
    """
SELECT p_brand, arg_min(p_name, (-length(p_name), -length(regexp_replace(lower(p_name), '[^éèêëàâäïîöôûüøæå]', '', 'g')),
  abs(1 + length(regexp_replace(p_name, '[^A-Z]', '', 'g')) - length(regexp_replace(p_name, '[^a-z]', '', 'g'))), p_partkey)) AS p_name
FROM part GROUP BY 1
"""
)
def best_name_per_group(spark, sf_dir):
    return stats.best_name(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey")


@query(
    """
SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (event_type IN ('purchase', 'signup')),
  arg_min(event_type, (-length(event_type), event_id))) AS event_type FROM events GROUP BY 1
"""
)
def best_style_per_group(spark, sf_dir):
    return stats.best_style(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", ["purchase", "signup"])


@query("SELECT user_id, arg_min(event_type, (-length(event_type), event_id)) AS event_type FROM events GROUP BY 1")
def longest_detailed_style(spark, sf_dir):
    return stats.best_style(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", [])


@query(
    """
WITH p AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders),
d AS (SELECT o_custkey, count(DISTINCT day) AS k FROM p GROUP BY 1),
s AS (SELECT o_custkey, o_orderpriority FROM p GROUP BY 1, 2 HAVING count(*) > 1)
SELECT DISTINCT p.o_custkey, p.day FROM p JOIN d USING (o_custkey)
WHERE d.k = 1 OR (p.o_custkey, p.o_orderpriority) IN (SELECT o_custkey, o_orderpriority FROM s)
"""
)
def confirmed_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    return stats.confirmed_dates(orders, "o_custkey", "day", "o_orderpriority")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY 1, 2")
def dedup_keep_first(spark, sf_dir):
    return stats.keep_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@query(
    """
SELECT event_id, user_id, event_type FROM events WHERE event_type IS DISTINCT FROM 'error'
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
"""
)
def union_handmade(spark, sf_dir):
    scraped = filters.drop_style(table(spark, sf_dir, "events"), F.col("event_type"), "error").select("event_id", "user_id", "event_type")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("event_type"))
    return scraped.unionByName(own)


@query("SELECT user_id, event_id, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS event_no FROM events")
def event_numbering(spark, sf_dir):
    numbered = stats.running_number(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error", "event_no")
    return numbered.select("user_id", "event_id", "event_no")


@query("SELECT l_orderkey, l_linenumber, coalesce(l_shipdate >= lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate), true) AS ordered FROM lineitem")
def chronology_check(spark, sf_dir):
    return stats.in_order(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_shipdate").select("l_orderkey", "l_linenumber", "ordered")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error'")
def error_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "event_type", "user_id")


@query(
    """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'no date | user ' || user_id ELSE 'user ' || user_id END AS log FROM events
"""
)
def log_append(spark, sf_dir):
    from ..functions.text import append_log

    log = F.when(F.col("event_type") == "error", "no date")
    return table(spark, sf_dir, "events").select("event_id", append_log(log, F.concat(F.lit("\x1b[31muser "), "user_id", F.lit("\x1b[0m"))).alias("log"))


@query("SELECT user_id, string_agg(event_type, ', ' ORDER BY ts, event_id) AS log FROM events GROUP BY 1")
def log_per_place(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(listed, lambda x: x["event_type"]), ", ").alias("log"))


@query("SELECT count_if(event_type = 'error') AS failed, count_if(event_type <> 'error') AS loaded FROM events")
def download_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") != "error").alias("loaded"))


@query("SELECT user_id, bool_or(event_type = 'purchase') AS found FROM events GROUP BY 1")
def any_page_has_delimiter(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("found"))


@query(
    """
SELECT event_id, 'place' || user_id || ';' || event_type || ';' || (epoch_us(ts) // 1000) || ';100;' || event_type || ';;http://x/' || event_id || ';' || strftime(ts, '%H:%M') || ';' || strftime(ts, '%d; %m') AS line FROM events
"""
)
def csv_line(spark, sf_dir):
    from ..sources.csv import event_line

    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("place"), "user_id").alias("place"), F.col("event_type").alias("eventName"), F.unix_millis(F.col("ts").cast("timestamp")).alias("unixDate"),
        F.col("event_type").alias("style"), F.lit("").alias("detailedStyle"), F.concat(F.lit("http://x/"), "event_id").alias("eventURL"),
        F.date_format("ts", "HH:mm").alias("eventTime"), F.date_format("ts", "dd; MM").alias("eventDate"),
    )
    return rows.select("event_id", event_line().alias("line"))


@query("SELECT event_id, 'place' || user_id AS place, event_type AS title, epoch_us(ts) // 1000 AS time, event_type AS style, strftime(ts, '%H:%M') AS time_string, strftime(ts, '%d') AS date_text FROM events")
def csv_line_roundtrip(spark, sf_dir):
    from ..sources.csv import parse_event_line

    lines = csv_line(spark, sf_dir)
    return lines.select("event_id", parse_event_line(F.col("line")).alias("e")).select("event_id", "e.place", "e.title", "e.time", "e.style", "e.time_string", "e.date_text")


@query(
    """
SELECT event_id, CASE event_type WHEN 'click' THEN 'music' WHEN 'view' THEN 'theatre' ELSE 'dot-11' END AS icon,
  CASE event_type WHEN 'click' THEN '#e55e5e' WHEN 'view' THEN '#3bb2d0' ELSE '#999' END AS colour FROM events
"""
)
def icons_and_colours(spark, sf_dir):
    from ..functions.maps import choose

    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", choose(kind, {"click": "music", "view": "theatre"}, "dot-11").alias("icon"), choose(kind, {"click": "#e55e5e", "view": "#3bb2d0"}, "#999").alias("colour")
    )


@query("SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10')) / 86400000000.0) AS BIGINT) AS offset_days FROM events")
def day_offset(spark, sf_dir):
    from ..functions import dates

    today = F.unix_millis(F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", dates.day_offset(F.unix_millis(F.col("ts").cast("timestamp")), today).alias("offset_days"))


@query("SELECT event_id, dayname(ts) || ' ' || day(ts) || '/' || month(ts) || '/' || year(ts) AS label FROM events")
def slider_label(spark, sf_dir):
    from ..functions import dates

    return table(spark, sf_dir, "events").select("event_id", dates.slider_label(F.col("ts")).alias("label"))


@query(
    """
WITH v AS (SELECT event_id, value FROM events), s AS (SELECT event_id, least(greatest(value, 100), 5000) AS x FROM v)
SELECT event_id, 100 + (x - 100) * (10 - 100) / (5000 - 100) AS size FROM (SELECT event_id, x FROM s)
"""
)
def interpolated_size(spark, sf_dir):
    from ..functions.maps import interpolate

    return table(spark, sf_dir, "events").select("event_id", interpolate(F.col("value"), 100.0, 100.0, 5000.0, 10.0).alias("size"))


_MERGED = """
WITH e AS (SELECT event_id AS seq, event_type AS name, 'place ' || user_id % 97 AS place, 'place ' || user_id % 13 AS source, 'http://x/' || event_id AS url,
    epoch_ms(date_trunc('hour', ts)) AS t, CAST(date_trunc('hour', ts) AS DATE) AS day FROM events),
g AS (SELECT place, day, name, count(*) AS n, min(seq) AS seq, arg_min(url, seq) AS url, bool_or(place = source) AS has_local, arg_min(url, seq) FILTER (place = source) AS local_url FROM e GROUP BY ALL),
u AS (SELECT e.* FROM e JOIN g USING (place, day, name) WHERE NOT has_local OR e.place = e.source),
d AS (SELECT place, day, name, t, count(*) AS n, arg_min(url, seq) AS url, list(url ORDER BY seq) AS urls FROM u GROUP BY ALL),
k AS (SELECT place, day, name, count(*) AS dates, max(n) AS most FROM d GROUP BY ALL),
s AS (SELECT place, day, name, source FROM u GROUP BY ALL HAVING count(DISTINCT t) > 1),
c AS (SELECT DISTINCT u.place, u.day, u.name, u.t FROM u JOIN s USING (place, day, name, source)),
x AS (SELECT d.*, k.dates, k.most, g.has_local OR k.dates = 1 OR c.t IS NOT NULL AS sure FROM d JOIN k USING (place, day, name) JOIN g USING (place, day, name) LEFT JOIN c USING (place, day, name, t)),
m AS (SELECT place, day, name, bool_or(sure) AS any_sure,
    CASE WHEN count(*) FILTER (n = most) > 1 THEN coalesce(min(t) FILTER (n = most AND t % 86400000 <> 0), min(t) FILTER (n = most)) ELSE min(t) FILTER (n = most) END AS guess FROM x GROUP BY ALL)
SELECT g.seq, g.name AS "eventName", g.place, 'Lyon' AS city, 'France' AS country, g.name AS style, CAST(NULL AS VARCHAR) AS "detailedStyle",
  CASE WHEN g.n = 1 OR NOT any_sure THEN g.url WHEN x.dates = 1 THEN coalesce(g.local_url, g.url) ELSE x.url END AS "eventURL",
  CASE WHEN g.n = 1 OR NOT any_sure THEN NULL WHEN x.dates = 1 THEN array_to_string(x.urls, ' ') ELSE nullif(array_to_string(x.urls[2:], ' '), '') END AS "altURLs",
  x.t AS "unixDate", g.n AS n_members, CASE WHEN NOT any_sure THEN 'no date confirmed' END AS warning
FROM x JOIN g USING (place, day, name) JOIN m USING (place, day, name) WHERE CASE WHEN any_sure THEN x.sure ELSE x.t = m.guess END
"""


@query(_MERGED)
def merge_duplicate_events(spark, sf_dir):
    """No event type holds another one's name, so here the groups are the names of a place and day; the
    greedy grouping itself has no SQL and is compared with a naive version in the tests."""
    from ..operators.merge import merge_events

    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("eventName"), F.concat(F.lit("place "), F.col("user_id") % 97).alias("place"), F.lit("Lyon").alias("city"), F.lit("France").alias("country"),
        F.concat(F.lit("place "), F.col("user_id") % 13).alias("source"), F.col("event_type").alias("style"), F.lit(None).cast("string").alias("detailedStyle"), F.concat(F.lit("http://x/"), "event_id").alias("eventURL"),
        F.unix_millis(F.date_trunc("hour", "ts").cast("timestamp")).alias("unixDate"),
    )
    return merge_events(rows).withColumn("altURLs", F.array_join("altURLs", " "))


@query("SELECT event_id, event_type, user_id % 97 = user_id % 13 AS local FROM events")
def local_sources(spark, sf_dir):
    """Which events a place lists itself."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("place "), F.col("user_id") % 97).alias("place"), F.concat(F.lit("place "), F.col("user_id") % 13).alias("source"))
    local = filters.is_local(F.col("place"), F.col("source"))
    return rows.select("event_id", "event_type", local.alias("local"))


@query("SELECT event_id, (CASE WHEN event_type = 'error' THEN '' ELSE event_type END = '' AND event_id % 3 = 0 AND event_id % 4 = 0) AS empty FROM events")
def empty_events(spark, sf_dir):
    name = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    date = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.lit("12/01"))
    url = F.when(F.col("event_id") % 4 == 1, "http://x").when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 2, "#")
    return table(spark, sf_dir, "events").select("event_id", filters.is_empty_event(name, date, F.coalesce(url, F.lit("u"))).alias("empty"))


@query("SELECT event_id, 'Received ' || event_type || ' from ' || user_id || ' at %s' AS message FROM events")
def filled_messages(spark, sf_dir):
    from ..functions.text import fill_message

    template = F.lit("\x1b[31mReceived \x1b[0m%s from %s at %s")
    return table(spark, sf_dir, "events").select("event_id", fill_message(template, F.col("event_type"), F.col("user_id")).alias("message"))


@query(f"WITH n AS (SELECT user_id, count(*) AS n FROM events WHERE ts > {_T} GROUP BY 1) SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id) AS rank FROM n ORDER BY n DESC, user_id LIMIT 10")
def chart_of_places(spark, sf_dir):
    """The ten places of most upcoming events, in the order of a chart's bars; a top-k report."""
    from pyspark.sql.window import Window

    counts = stats.upcoming_per_style(table(spark, sf_dir, "events"), _start(), "user_id", "ts")
    top = stats.sorted_counts(counts, "n", "user_id").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")).cast("long"))


@query("SELECT event_id, 'event_id: ' || event_id || chr(10) || 'event_type: ' || event_type || chr(10) || 'errorLog: no date' || chr(10) AS text FROM events WHERE event_type = 'error'")
def rendered_logs(spark, sf_dir):
    from ..sources.geojson import rendered_log

    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_type") == "error", "no date").alias("errorLog"))
    return rows.where("errorLog IS NOT NULL").select("event_id", rendered_log(["event_id", "event_type"], "errorLog").alias("text"))


@query("SELECT event_id, event_type IS NOT DISTINCT FROM CASE WHEN event_id % 2 = 0 THEN event_type END AND user_id % 3 = user_id % 6 AS equal FROM events")
def equal_records(spark, sf_dir):
    from ..operators.recipes import same_record

    a = F.struct(F.col("event_type").alias("style"), (F.col("user_id") % 3).alias("place"))
    b = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("style"), (F.col("user_id") % 6).alias("place"))
    return table(spark, sf_dir, "events").select("event_id", same_record(a, b).alias("equal"))
