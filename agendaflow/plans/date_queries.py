"""Date rules over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from .registry import query, table

_D = "CAST(o_orderdate AS DATE)"


@query(
    f"""
SELECT o_orderkey, epoch_ms(timezone('UTC', timezone('Asia/Ho_Chi_Minh', CAST({_D} AS TIMESTAMP) + to_minutes(CAST(CASE WHEN o_orderkey % 25 = 24 THEN 1440 ELSE (o_orderkey % 25) * 60 + o_orderkey % 60 END AS BIGINT))))) AS instant FROM orders
"""
)
def dates_to_instants(spark, sf_dir):
    hour = F.col("o_orderkey") % 25
    clock = F.when(hour == 24, F.lit("24:00")).otherwise(F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")))
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.to_instant(F.year(day), F.month(day), F.dayofmonth(day), clock, F.lit("Asia/Ho_Chi_Minh")).alias("instant"))


@query(f"SELECT o_orderkey, CAST(CASE WHEN (month({_D}), day({_D})) < (6, 15) THEN 2026 ELSE 2025 END AS INTEGER) AS year FROM orders")
def missing_year_completion(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.complete_year(F.month(day), F.dayofmonth(day), F.lit("2025-06-15").cast("date")).alias("year"))


_RANGE = f"SELECT o_orderkey, unnest(generate_series({_D}, {_D} + CAST(o_orderkey % 9 AS INTEGER), INTERVAL 1 DAY))::DATE AS day FROM orders"


def _expanded(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(dates.date_range(day, F.date_add(day, (F.col("o_orderkey") % 9).cast("int")))).alias("day"))


@query(_RANGE)
def date_range_expansion(spark, sf_dir):
    return _expanded(spark, sf_dir)


@query(f"SELECT o_orderkey, day FROM ({_RANGE}) WHERE lower(dayname(day)) IN ('saturday', 'sunday', 'monday')")
def weekday_filter_range(spark, sf_dir):
    wanted = dates.weekday_range(F.lit(5), F.lit(0))
    return _expanded(spark, sf_dir).where(F.array_contains(wanted, F.weekday("day")))


@query(f"SELECT o_orderkey, day, CASE WHEN lower(dayname(day)) = 'saturday' THEN '18:00' ELSE '20:00' END AS time FROM ({_RANGE}) WHERE lower(dayname(day)) <> 'sunday'")
def weekday_exception(spark, sf_dir):
    name = dates.weekday(F.col("day"))
    return _expanded(spark, sf_dir).where(name != "sunday").select("o_orderkey", "day", F.when(name == "saturday", "18:00").otherwise("20:00").alias("time"))


@query(
    """
WITH m AS (SELECT s_suppkey, unnest(generate_series(0, s_suppkey % 15)) AS i FROM supplier), d AS (SELECT s_suppkey, 2025 + (10 + i) // 12 AS y, (10 + i) % 12 + 1 AS m FROM m)
SELECT s_suppkey, CASE s_suppkey % 3
  WHEN 0 THEN 'http://site/' || y || '/' || lpad(CAST(m AS VARCHAR), 2, '0') || '/list'
  WHEN 1 THEN 'http://site/?from=' || '30-' || m || '-' || (y % 100)
  ELSE 'http://site/30.' || lpad(CAST(m AS VARCHAR), 2, '0') || '.' || y || '?M=1' END AS url FROM d
"""
)
def pattern_url_list(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    url = F.when(k == 0, "http://site/{index}/list").when(k == 1, "http://site/?from=").otherwise("http://site/{index}?M=1")
    pattern = F.when(k == 0, "yyyy/MM").when(k == 1, "d-M-yy").otherwise("DD.mm.yyyy")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", url.alias("u"), pattern.alias("p"), F.explode(F.sequence(F.lit(0), (F.col("s_suppkey") % 15).cast("int"))).alias("i"))
    return rows.select("s_suppkey", dates.pattern_url(F.col("u"), F.col("p"), F.lit("2025-11-30").cast("date"), F.col("i")).alias("url"))


@query(f"SELECT o_orderkey, strftime({_D}, '%d/%m/%Y') || CASE WHEN o_orderkey % 2 = 0 THEN ' (time: 20:00)' ELSE '' END AS shown, CAST(week({_D}) AS INTEGER) AS week FROM orders")
def shown_dates(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.show_date(day, F.when(F.col("o_orderkey") % 2 == 0, F.lit("20:00"))).alias("shown"), F.weekofyear(day).alias("week"))


@query("SELECT event_id, CAST(timezone('Europe/Paris', timezone('UTC', ts)) AS DATE) AS day FROM events")
def local_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.local_day(F.unix_millis(F.col("ts").cast("timestamp")), "Europe/Paris").alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 3 THEN o_orderkey + 86400000 - 10 ELSE o_orderkey + 10 END AS end_ms FROM orders")
def end_next_day(spark, sf_dir):
    end = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 7 < 3, -10).otherwise(10)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.end_after_start(F.col("o_orderkey"), end).alias("end_ms"))


_MONTHS = "['janvier', 'fevrier', 'mars', 'avril', 'mai', 'juin', 'juillet', 'aout', 'septembre', 'octobre', 'novembre', 'decembre']"


def _written(day):
    from ..functions.date_text import FRENCH_MONTH_NAMES

    month = F.element_at(F.array(*[F.lit(m) for m in FRENCH_MONTH_NAMES]), F.month(day))
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), month, F.year(day).cast("string"))


@query(f"SELECT o_orderkey, CAST(0 AS INTEGER) AS possibility, strftime(d, '%Y-%m-%d') AS start_date, '20:00' AS start_time FROM (SELECT o_orderkey, unnest(generate_series({_D}, {_D} + 2, INTERVAL 1 DAY)) AS d FROM orders)")
def extracted_dates(spark, sf_dir):
    from ..operators.date_tokens import readings

    day = F.to_date("o_orderdate")
    shown = F.concat(F.lit("du "), _written(day), F.lit(" au "), _written(F.date_add(day, 2)), F.lit(" à 20h"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"))
    texts = rows.select(F.col("shown").alias("text")).distinct()
    texts = texts.select("text", F.array(*map(F.lit, ("day", "month", "year"))).alias("order"), F.lit("long").alias("month"), F.lit("long").alias("year"), F.lit("2025-12-01").cast("date").alias("day"), F.lit("french").alias("language"))
    found = readings(texts).select(F.col("text").alias("shown"), F.posexplode("readings").alias("possibility", "r")).select("shown", "possibility", F.explode("r").alias("d"))
    return rows.join(found, "shown").select("o_orderkey", "possibility", "d.start_date", "d.start_time")


@query(
    f"""
WITH o AS (SELECT o_orderkey, {_D} AS d, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 4 THEN 0 WHEN k = 3 THEN -1 ELSE
  epoch_ms(timezone('UTC', timezone(CASE k WHEN 0 THEN 'Europe/Paris' ELSE 'Asia/Ho_Chi_Minh' END, CAST(d AS TIMESTAMP) + INTERVAL 20 HOUR))) END AS "unixDate",
  CAST(CASE WHEN k < 3 THEN 1 ELSE 0 END AS INTEGER) AS n_possibilities, k < 3 AS "hasStartTime", CASE WHEN k = 4 THEN 'unreadable date' ELSE '' END AS error FROM o
"""
)
def dates_by_venue_format(spark, sf_dir):
    """Each order's date in the format of its venue, of its linked page or else of its main page."""
    from ..operators.extract import FORMAT, dated_by

    k, day = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    number = F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit(" 20:00"))
    text = F.when(k == 0, F.concat(_written(day), F.lit(" à 20h"))).when(k < 3, number).when(k == 3, "  ").otherwise("to be announced")
    form = lambda month: F.struct(F.array(*map(F.lit, ("day", "month", "year"))).alias("order"), F.lit(month).alias("month"), F.lit("long").alias("year"))
    formats = F.when(k == 1, F.array(form("numeric"))).otherwise(F.array(form("long"), form("numeric"))).cast(f"array<{FORMAT}>")
    events = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", text.alias("eventDate"), F.lit("").alias("errorLog"), F.when(k == 0, "Europe/Paris").otherwise("Asia/Ho_Chi_Minh").alias("zone"))
    out = dated_by(events, formats, F.lit("2025-12-01").cast("date"), F.col("zone"), F.lit("french"))
    return out.select("o_orderkey", "unixDate", "n_possibilities", "hasStartTime", F.regexp_replace("errorLog", "^ \\| ", "").alias("error"))


@query(f"SELECT o_orderkey, {_D} = CAST(o_orderdate + to_minutes(CAST(o_orderkey % 2000 AS BIGINT)) AS DATE) AS same FROM orders")
def same_local_day(spark, sf_dir):
    from ..operators.filters import same_day

    start = F.unix_millis(F.to_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "Asia/Ho_Chi_Minh"))
    return table(spark, sf_dir, "orders").select("o_orderkey", same_day(start, start + (F.col("o_orderkey") % 2000) * 60_000, "Asia/Ho_Chi_Minh").alias("same"))


@query("SELECT event_id, epoch_ms(timezone('UTC', timezone('Asia/Ho_Chi_Minh', date_trunc('day', timezone('Asia/Ho_Chi_Minh', timezone('UTC', ts)))))) AS midnight FROM events")
def local_midnights(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(dates.local_midnight(F.col("ts").cast("timestamp"), "Asia/Ho_Chi_Minh")).alias("midnight"))


@query(f"SELECT o_orderkey, strftime({_D}, '%d/%m/') || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') AS padded FROM orders")
def two_digit_numbers(spark, sf_dir):
    day = F.to_date("o_orderdate")
    shown = F.concat_ws("/", F.dayofmonth(day).cast("string"), F.month(day).cast("string"), (F.col("o_orderkey") % 40).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.two_digits(shown).alias("padded"))


@query(
    f"""
SELECT event_id, 'Le ' || ['lundi', 'mardi', 'mercredi', 'jeudi', 'vendredi', 'samedi', 'dimanche'][isodow(t)] || ' ' || day(t) || ' ' || {_MONTHS.replace("fevrier", "février").replace("aout", "août").replace("decembre", "décembre")}[month(t)]
  || ' ' || year(t) || ' à ' || strftime(t, '%H:%M') AS shown FROM (SELECT event_id, timezone('Europe/Paris', timezone('UTC', ts)) AS t FROM events)
"""
)
def french_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.french_date(F.col("ts").cast("timestamp"), "Europe/Paris").alias("shown"))


@query("SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'long' WHEN '2-HIGH' THEN 'short' ELSE 'numeric' END AS month, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'long' ELSE 'short' END AS year FROM orders GROUP BY 1")
def infer_date_format(spark, sf_dir):
    from ..functions.date_text import FRENCH
    from ..operators.extract import infer_date_format as infer

    day = F.to_date("o_orderdate")
    name = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(" décembre ")).otherwise(F.lit(" déc "))
    long = F.concat(F.dayofmonth(day).cast("string"), name, F.year(day).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), long).otherwise(F.date_format(day, "dd.MM.yy")).alias("shown"))
    return infer(rows, "o_orderpriority", "shown", FRENCH)


@query("SELECT event_id, CASE WHEN hour(ts) = 0 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS day, CASE WHEN hour(ts) = 0 THEN '23:59' ELSE strftime(ts, '%H:%M') END AS time FROM events")
def midnight_rule(spark, sf_dir):
    from ..functions.dates import before_midnight

    rows = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("d"), F.when(F.hour("ts") == 0, F.lit("00:00")).otherwise(F.date_format("ts", "HH:mm")).alias("t"))
    moved = before_midnight(F.col("d"), F.col("t"))
    return rows.select("event_id", moved["day"].alias("day"), moved["time"].alias("time"))
