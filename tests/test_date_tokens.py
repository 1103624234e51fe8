"""Dates of tables of texts against the plain reading of each text."""

import datetime as dt
import random

from pyspark.sql import functions as F

from agendaflow.functions.date_text import DICTIONARIES, extract_dates, first_reading
from agendaflow.operators import date_tokens

from test_dates import GOLDEN

SCHEMA = "text string, order array<string>, month string, year string, day date, language string"
PARTS = ["du", "au", "jusqu'au", "à", "le", "les", "lundi", "mar", "mardis", "sam.", "mars", "déc", "Décembre", "août", "mai", "demain", "aujourd'hui", "ce soir", "minuit", "sauf", "et", "-", "→", "–", "18h", "18h30", "25h", "7:30 PM", "8am", "12.05.26", "5/6", "05/06/2026", "31.12", "2026", "26", "3", "14", "31", "32", "1er", "9999", "0", "12345678901", "l’été", "ﬁn", "漢字"]


def plain(r, words=DICTIONARIES):
    if r["text"] is None or r["day"] is None or r["language"] not in words:
        return []
    got = extract_dates(r["text"], list(r["order"]), r["month"], r["year"], r["day"], words[r["language"]])
    return [[(a.isoformat(), b, c and c.isoformat(), d) for a, b, c, d in p] for p in got]


def test_tables_read_as_plain_texts(spark):
    rng, day = random.Random(3), dt.date(2025, 12, 1)
    rows = [(text, order.split(","), month, year if "year" in order else None, day, "french") for _, text, order, month, year, _, _ in GOLDEN]
    for k in range(500):
        order = rng.choice([["day", "month", "year"], ["month", "day"], ["day", "month"], ["year", "month", "day"], ["month", "year", "day"]])
        text = " ".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
        rows.append((text, order, rng.choice(["long", "short", "numeric"]), rng.choice(["long", "short", None]), dt.date(2025, rng.randint(1, 12), 15), rng.choice(["french", "french", "french", "klingon"])))
    rows += [(None, ["day", "month"], "long", None, day, "french"), ("5 mai", ["day", "month"], "long", None, None, "french"), ("5 mai", ["day", "month"], "long", None, day, None)]
    table = spark.createDataFrame(rows, SCHEMA).distinct()
    got = date_tokens.readings(table).collect()
    assert len(got) == table.count()
    for r in got:
        assert [[tuple(d) for d in p] for p in r.readings] == plain(r), r
    assert sum(bool(r.readings) for r in got) > 40


def test_first_readings_of_rows(spark):
    rng, day = random.Random(5), dt.date(2025, 12, 1)
    forms = [(["day", "month", "year"], "numeric", "short"), (["day", "month"], "long", None), (["month", "day"], "numeric", None)]
    texts = ["5 mai", "05.06.26", "11 12", "5 mai", "nothing", "", None, "23 nov 26, 27 dec 26, 19h, 21h"]
    rows = [(k, rng.choice(texts), [forms[i] for i in rng.sample(range(3), rng.randint(0, 3))] if k % 20 else None) for k in range(200)]
    table = spark.createDataFrame(rows, "k int, shown string, forms array<struct<order:array<string>,month:string,year:string>>")
    got = date_tokens.first_readings(table, "shown", F.col("forms"), F.lit(day), F.lit("french")).collect()
    assert len(got) == 200
    for r in got:
        n, dates = first_reading(r.shown, [tuple(f) for f in r.forms or []], day, DICTIONARIES["french"])
        assert (r.reading.n, [tuple(d) for d in r.reading.dates]) == (n, [(a.isoformat(), b, c and c.isoformat(), d) for a, b, c, d in dates]), r


def test_own_dictionaries_and_none(spark):
    own = {"english": {"weekdays": [["monday", "mon"], *([f"d{k}"] for k in range(6))], "months": [["january", "jan"], *([f"m{k}"] for k in range(11))], "to": ["to"], "until": [], "today": ["this evening"], "tomorrow": ["tomorrow"], "except": [], "midnight": ["midnight"]}}
    day = dt.date(2025, 12, 1)
    rows = [("monday 5 January at 8pm", "english"), ("this evening at 20h", "english"), ("5 janvier", "french"), ("tomorrow, midnight", "english")]
    table = spark.createDataFrame([(t, ["day", "month"], "long", None, day, x) for t, x in rows], SCHEMA)
    got = {r["text"]: [[tuple(d) for d in p] for p in r.readings] for r in date_tokens.readings(table, own).collect()}
    assert got == {r["text"]: plain(r, own) for r in table.collect()} and got["5 janvier"] == [] and got["this evening at 20h"]
    assert all(r.readings == [] for r in date_tokens.readings(table, {}).collect())
    assert date_tokens.readings(table.limit(0)).count() == 0
