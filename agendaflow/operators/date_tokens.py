"""Dates of texts as tables: texts are split into tokens, tokens meet dictionaries, and each distinct text is read once.

Scanning, clocks, numbers and words are columns and joins. What is left to Python is a small step for each distinct
text: its tokens' choices, put together in the ways that make dates.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.date_text import DICTIONARIES, MOST_YEARS, Token, read_choices
from ..functions.text import strip_accents

#: The tokens of a cleaned text: clocks, numbers joined by points or strokes, numbers, dashes and words.
CLOCK = "\\d{1,2}:\\d{2}(?:\\s?[ap]m)?\\b|\\d{1,2}\\s?[ap]m\\b|\\d{1,2}\\s?h(?:\\d{2})?(?![a-z0-9])"
SCAN = f"(?:{CLOCK})|\\d{{1,4}}(?:[./]\\d{{1,4}})+|\\d+|-+>?|>|[a-z]+(?:'[a-z]+)*"
RUNS = "array<array<struct<kind:string,value:string>>>"
READING = "array<struct<start_date:string,start_time:string,end_date:string,end_time:string>>"
KEYS = ["text", "order", "month", "year", "day", "language"]


def cleaned(text: Column) -> Column:
    """Lower case without accents; arrows and long dashes as plain ones, nothing beyond ASCII."""
    plain = F.translate(F.lower(text), "’→–—", "'---")
    return F.regexp_replace(strip_accents(plain), "[^\\x00-\\x7F]", "")


def word_table(spark: SparkSession, dictionaries: dict[str, dict]) -> DataFrame:
    """(language, word, kind, value, named, ord): what each word of each language may mean, in order. A word with a
    meaning of its own as a phrase has no other. A language without words is absent."""
    rows = []
    for language, words in dictionaries.items():
        phrases = {p: k for k in ("today", "tomorrow", "except", "midnight", "until", "to") for p in reversed(words[k])}
        phrases |= dict.fromkeys(words["until"], "until") | {p.replace(" ", "'"): "today" for p in words["today"]}
        rows += [(language, p, k, p, True, 0) for p, k in phrases.items()]
        for kind, lists, first in (("weekday", words["weekdays"], 0), ("month", words["months"], 1)):
            rows += [(language, w, kind, str(k + first), kind == "weekday" or w == names[0], 1 + k + 7 * first) for k, names in enumerate(lists) for w in dict.fromkeys(names) if w not in phrases]
    return spark.createDataFrame(rows or [(None, None, None, None, None, None)], "language string, word string, kind string, value string, named boolean, ord int")


def _one(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))


def clock(s: Column) -> Column:
    """HH:MM of 18h, 18h30, 8am or 07:30 pm; null for an hour or minute that there is not."""
    part = lambda k: F.regexp_extract(s, "^(\\d{1,2})\\s?[h:]?\\s?(\\d{2})?\\s?([ap]m)?", k)
    hour, minute = part(1).cast("int"), F.coalesce(F.nullif(part(2), F.lit("")).cast("int"), F.lit(0))
    hour = F.when(part(3) == "", hour).otherwise(hour % 12 + F.when(part(3) == "pm", 12).otherwise(0))
    return F.when((hour < 25) & (minute < 60), F.format_string("%02d:%02d", hour, minute))


def number_choices(s: Column, month: Column, year: Column, first_year: Column) -> Column:
    """What a number may be: a day, a numeric month, a short year or, of four digits, a year."""
    n = F.when(F.length(s) < 10, s.cast("int"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    own = F.array(
        F.when(yes((F.length(s) == 4) & n.between(1, first_year + MOST_YEARS - 1)), _one("year", n)),
        F.when(yes((F.length(s) != 4) & n.between(1, 31)), _one("day", n)),
        F.when(yes((F.length(s) != 4) & (month == "numeric") & n.between(1, 12)), _one("month", n)),
        F.when(yes((year == "short") & (F.length(s) == 2) & (n + 2000).between(first_year, first_year + 2)), _one("year", n + 2000)),
    )
    return F.filter(own, lambda x: x.isNotNull())


def token_rows(texts: DataFrame) -> DataFrame:
    """(id, place, token) of each text: ``texts`` has id, text, language and ``today``, the language's phrases for
    today, whose blanks become part of one word."""
    joined = F.aggregate("today", cleaned(F.col("text")), lambda t, p: F.replace(t, p, F.replace(p, F.lit(" "), F.lit("'"))))
    return texts.select("id", F.posexplode(F.regexp_extract_all(joined, F.lit(SCAN), 0)).alias("place", "token"))


def choices(texts: DataFrame, dictionaries: dict[str, dict]) -> DataFrame:
    """(id, choices): for each text its tokens in order, for each token the runs that it may be. ``texts``: id and KEYS.

    Words meet the dictionaries by a join; a text's tokens are gathered again, and one text is all that a group holds.
    """
    spark = texts.sparkSession
    today = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for language, w in dictionaries.items() for x in (language, w["today"])]) if dictionaries else F.lit(None).cast("map<string,array<string>>")
    rows = token_rows(texts.withColumn("today", F.coalesce(F.try_element_at(today, "language"), F.array().cast("array<string>"))))
    rows = rows.join(texts.select("id", "order", "month", "year", "day", "language"), "id")
    short, first_year = F.col("month") == "short", F.year("day")
    meant = word_table(spark, dictionaries)
    words = rows.where(F.col("token").rlike("^[a-z]")).join(F.broadcast(meant), ["language"]).where(F.col("token") == F.col("word"))
    of_word = F.array_sort(F.collect_list(F.struct("ord", "kind", "value", "named")))
    words = words.groupBy("id", "place").agg(of_word.alias("m"), F.first("order").alias("order"), F.first("day").alias("day"), F.first(short).alias("short"))
    weekdays = F.filter("m", lambda x: x["kind"] == "weekday")
    months = F.filter("m", lambda x: (x["kind"] == "month") & (x["named"] | F.coalesce(F.col("short"), F.lit(False)) | (F.size(weekdays) == 0)))
    alone = lambda xs: F.transform(xs, lambda x: F.array(F.struct(x["kind"].alias("kind"), x["value"].alias("value"))))
    kind, day = F.col("m")[0]["kind"], F.when(F.col("m")[0]["kind"] == "tomorrow", F.date_add("day", 1)).otherwise(F.col("day"))
    parts = F.create_map(F.lit("day"), F.dayofmonth(day), F.lit("month"), F.month(day), F.lit("year"), F.year(day))
    whole = F.transform("order", lambda k: F.struct(k.alias("kind"), F.try_element_at(parts, k).cast("string").alias("value")))
    run = F.when(kind.isin("today", "tomorrow"), F.array(whole)).when(kind == "midnight", F.array(F.array(_one("time", F.lit("24:00")))))
    run = run.when(kind.isin("except", "until", "to"), alone(F.slice("m", 1, 1))).otherwise(F.concat(alone(weekdays), alone(months)))
    s = F.col("token")
    numbers = F.transform(F.split(s, "[./]"), lambda n: number_choices(n, F.col("month"), F.col("year"), first_year))
    k = F.size(numbers)
    window = lambda a: F.transform(F.slice("order", a, k), lambda kind, i: F.filter(F.get(numbers, i), lambda x: x["kind"] == kind))
    fits = F.filter(F.transform(F.when(F.size("order") >= k, F.sequence(F.lit(1), F.size("order") - k + 1)).otherwise(F.array().cast("array<int>")), window), lambda w: F.forall(w, lambda x: F.size(x) > 0))
    plain = rows.where(~s.rlike("^[a-z]")).select(
        "id", "place",
        F.when(s.rlike("^\\d+$"), F.transform(number_choices(s, F.col("month"), F.col("year"), first_year), lambda x: F.array(x)))
        .when(s.rlike("^\\d{1,4}([./]\\d{1,4})+$"), F.transform(fits, lambda w: F.flatten(w)))
        .when(s.rlike("^[->]"), F.array(F.array(_one("to", F.lit("-")))))
        .when(clock(s).isNotNull(), F.array(F.array(_one("time", clock(s))))).alias("runs"),
    )
    found = plain.unionByName(words.select("id", "place", run.alias("runs"))).where(F.size("runs") > 0)
    told = F.transform(F.array_sort(F.collect_list(F.struct("place", "runs"))), lambda x: x["runs"])
    return found.groupBy("id").agg(told.alias("choices"))


def readings(texts: DataFrame, dictionaries: dict[str, dict] | None = None) -> DataFrame:
    """``texts``, rows of KEYS, each once, with ``readings``: the possible readings of the text, each an array of
    dates, in order; empty where it has none, for null texts or days and for languages without a dictionary."""
    dictionaries = DICTIONARIES if dictionaries is None else dictionaries
    numbered = texts.select(*KEYS).withColumn("id", F.xxhash64(F.struct(*KEYS), F.lit("a"))).withColumn("id", F.struct("id", F.xxhash64(F.struct(*KEYS), F.lit("b")).alias("other")))
    known = numbered.where(F.col("text").isNotNull() & F.col("day").isNotNull() & F.col("language").isin(list(dictionaries)))
    found = choices(known, dictionaries).join(known.select("id", *KEYS), "id")

    @F.pandas_udf("string")
    def read(given: pd.Series, orders: pd.Series, years: pd.Series, days: pd.Series) -> pd.Series:
        value = {"time": lambda v: (v, None), **dict.fromkeys(("day", "month", "year", "weekday"), int)}
        token = lambda x: Token(x["kind"], value.get(x["kind"], str)(x["value"]))
        iso = lambda d: d.isoformat() if d else None
        out = []
        for c, order, year, day in zip(given, orders, years, days):
            got = read_choices([[[token(x) for x in run] for run in runs] for runs in json.loads(c)], order.split(","), year, day)
            out.append(json.dumps([[{"start_date": iso(a), "start_time": b, "end_date": iso(e), "end_time": f} for a, b, e, f in dates] for dates in got]))
        return pd.Series(out)

    told = found.select("id", F.from_json(read(F.to_json("choices"), F.array_join("order", ","), "year", "day"), f"array<{READING}>").alias("readings"))
    none = F.array().cast(f"array<{READING}>")
    return numbered.join(told, "id", "left").select(*KEYS, F.coalesce("readings", none).alias("readings"))


def first_readings(rows: DataFrame, text: str, formats: Column, day: Column, language: Column, dictionaries: dict[str, dict] | None = None, name: str = "reading") -> DataFrame:
    """``rows`` with ``name``, a struct of n and dates: how many readings the last format that reads the text gives, and the first
    of them. Formats (an array of order, month, year) are tried up to one that reads the text in one way.

    Each distinct text is read once for each distinct format, day and language, however often rows repeat it.
    """
    key = F.struct(F.col(text).alias("text"), formats.alias("formats"), day.alias("day"), language.alias("language"))
    marked = rows.withColumn("__key", key)
    keys = marked.select("__key").distinct()
    tried = keys.select("__key", F.posexplode("__key.formats").alias("at", "f"))
    tried = tried.select("__key", "at", F.struct(F.col("__key.text").alias("text"), F.col("f.order").alias("order"), F.col("f.month").alias("month"), F.col("f.year").alias("year"), F.col("__key.day").alias("day"), F.col("__key.language").alias("language")).alias("__one"))
    read = readings(tried.select("__one.*").distinct(), dictionaries).select(F.struct(*KEYS).alias("__one"), F.size("readings").alias("n"), F.get("readings", F.lit(0)).alias("dates"))
    by_format = tried.join(read, "__one").groupBy("__key").agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("at", "n", "dates")))).alias("r"))
    ends = F.array_min(F.transform(F.filter("r", lambda x: x["n"] == 1), lambda x: x["at"]))
    last = F.try_element_at(F.filter("r", lambda x: ends.isNull() | (x["at"] <= ends)), F.lit(-1))
    chosen = by_format.select("__key", F.coalesce(last["n"], F.lit(0)).alias("n"), last["dates"].alias("dates"))
    chosen = chosen.select("__key", F.struct("n", F.coalesce("dates", F.array().cast(READING)).alias("dates")).alias("__first"))
    none = F.struct(F.lit(0).alias("n"), F.array().cast(READING).alias("dates"))
    return marked.join(chosen, "__key", "left").select(*rows.columns, F.coalesce("__first", none).alias(name))
