"""Date and time functions as Spark columns. ``as_of`` is always an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: French names (fixed values).
FRENCH_DAYS = ["lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche"]
FRENCH_MONTHS = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]


def two_digits(c: Column) -> Column:
    """Digits that stand alone get a leading zero."""
    return F.regexp_replace(c, "(?<!\\d)(\\d)(?!\\d)", "0$1")


def to_instant(year: Column, month: Column, day: Column, time: Column, zone: Column) -> Column:
    """Epoch milliseconds of a wall-clock time ``HH:MM`` in a zone; ``24:00`` is the next midnight; a
    null time is midnight; hours over 24 or a null zone give null."""
    clock = F.coalesce(time, F.lit("00:00"))
    hour = F.split(clock, ":")[0].cast("int")
    minute = F.coalesce(F.get(F.split(clock, ":"), F.lit(1)).cast("int"), F.lit(0))
    base = F.to_timestamp(F.make_date(year, month, day)) + F.make_dt_interval(F.when(hour == 24, 1).otherwise(0), F.when(hour == 24, 0).otherwise(hour), minute)
    return F.when((hour < 24) | ((hour == 24) & (minute == 0)), F.unix_millis(F.to_utc_timestamp(base, zone)))


def end_after_start(start_ms: Column, end_ms: Column) -> Column:
    """An end before its start is meant for the next day."""
    return F.when(end_ms < start_ms, end_ms + DAY_MS).otherwise(end_ms)


def complete_year(month: Column, day: Column, as_of: Column) -> Column:
    """The year of a date without one: this year, or the next where the day is past."""
    this = F.year(as_of)
    past = (month < F.month(as_of)) | ((month == F.month(as_of)) & (day < F.dayofmonth(as_of)))
    return F.when(past, this + 1).otherwise(this)


def local_day(ms: Column, zone: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def local_midnight(ts: Column, zone: Column | str) -> Column:
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def weekday(d: Column) -> Column:
    """The English name, lower case."""
    return F.lower(F.date_format(d, "EEEE"))


def weekday_range(first: Column, last: Column, wrap: bool = True) -> Column:
    """Numbers (0 Monday to 6 Sunday) from first to last. A range over the week's end goes on from
    Monday if ``wrap``, else it stops at Sunday."""
    days = F.transform(F.sequence(first, F.when(last < first, last + 7).otherwise(last)), lambda d: F.pmod(d, F.lit(7)))
    return days if wrap else F.when(last < first, F.sequence(first, F.lit(6))).otherwise(F.sequence(first, F.greatest(first, last)))


def date_range(start: Column, end: Column) -> Column:
    """All days, both ends included; none where the end is before the start."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def show_date(d: Column, time: Column) -> Column:
    return F.concat(F.date_format(d, "dd/MM/yyyy"), F.coalesce(F.concat(F.lit(" (time: "), time, F.lit(")")), F.lit("")))


def french_date(ts: Column, zone: Column | str, end: Column | None = None) -> Column:
    """``Le lundi 1 décembre 2025 à 20:00``, and the end, where there is one, after an arrow."""
    if end is not None:
        return F.concat(french_date(ts, zone), F.coalesce(F.concat(F.lit(" → "), french_date(end, zone)), F.lit("")))
    local = F.from_utc_timestamp(ts, zone)
    names = lambda values: F.array(*[F.lit(v) for v in values])
    return F.concat(
        F.lit("Le "), F.element_at(names(FRENCH_DAYS), F.weekday(local) + 1), F.lit(" "), F.dayofmonth(local).cast("string"), F.lit(" "),
        F.element_at(names(FRENCH_MONTHS), F.month(local)), F.lit(" "), F.year(local).cast("string"), F.lit(" à "), F.date_format(local, "HH:mm"),
    )


def pattern_url(url: Column, pattern: Column, as_of: Column, months: Column) -> Column:
    """The address of the page some months on: the pattern with its first MM or mm, M or m, yyyy, yy, DD or
    dd, D or d filled, in this order, takes the place of ``{index}`` or else follows the address. The day is
    that of ``as_of`` in every month."""
    month = F.month(as_of) - 1 + months
    year = F.year(as_of) + F.floor(month / 12).cast("int")
    number = F.pmod(month, F.lit(12)) + 1
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.dayofmonth(as_of)
    for token, value in (("MM|mm", two(number)), ("M|m", number), ("yyyy", year), ("yy", year % 100), ("(?i:dd)", two(day)), ("(?i:d)", day)):
        pattern = F.call_function("regexp_replace", pattern, F.lit(f"^([\\s\\S]*?)(?:{token})"), F.concat(F.lit("$1"), value.cast("string")))
    return F.when(url.contains("{index}"), F.replace(url, F.lit("{index}"), pattern)).otherwise(F.concat(url, pattern))


def day_offset(ms: Column, today_ms: Column) -> Column:
    return F.floor((ms - today_ms) / DAY_MS)


def chart_label(d: Column) -> Column:
    return F.date_format(d, "d/M")


def address_offset(address: Column, today_ms: Column) -> Column:
    """The day that an address of the map asks for, in days from today: its date (yyyymmdd), else its time
    (milliseconds), else its day; today where it has none that can be read."""
    given = lambda key: F.call_function("parse_url", address, F.lit("QUERY"), F.lit(key))
    date = F.call_function("try_to_date", F.left(given("date"), F.lit(8)), F.lit("yyyyMMdd"))
    time = F.call_function("try_to_number", given("time"), F.lit("9999999999999999")).cast("long")
    day = F.nullif(F.regexp_extract(given("day"), "^\\s*([-+]?\\d{1,9})", 1), F.lit("")).cast("long")
    midnight = F.unix_millis(date.cast("timestamp"))
    return F.coalesce(day_offset(midnight, today_ms), day_offset(time, today_ms), day, F.lit(0).cast("long"))


def before_midnight(day: Column, time: Column) -> Column:
    """(day, time) with 00:00 as 23:59 of the day before."""
    zero = F.coalesce(time == "00:00", F.lit(False))
    return F.struct(F.when(zero, F.date_sub(day, 1)).otherwise(day).alias("day"), F.when(zero, F.lit("23:59")).otherwise(time).alias("time"))


def slider_label(ts: Column) -> Column:
    """``Weekday d/m/yyyy``, as under the slider of days."""
    return F.date_format(ts, "EEEE d/M/yyyy")


def chart_label(ts: Column) -> Column:
    """``d/m``, as below a bar of the chart of days."""
    return F.date_format(ts, "d/M")
