"""Free-text dates: texts, formats, number of dates and the first (fixed values), on 1 December 2025."""

import datetime as dt
import itertools
import random
import time

import pytest

from agendaflow.functions import date_text
from agendaflow.functions.date_text import FRENCH, extract_dates

TODAY = dt.date(2025, 12, 1)
#: id, text, order, month, year, number of dates, first date and times
GOLDEN = [
    (0, "jusqu'au mardi 9 décembre 2025 à 18h-20h", "day,month,year", "long", "long", 9, "2025-12-01 18:00 20:00"),
    (1, "aujourd'hi 23.09.26 à partir de 18h", "day,month,year", "numeric", "short", 1, "2026-09-23 18:00"),
    (2, "du 17.02.26 à 20h au 18.02.26 à 4h", "day,month,year", "numeric", "short", 1, "2026-02-17 20:00 04:00"),
    (3, "mar. 20 Jan, 2026, 07:30 PM-08:00 PM", "day,month,year", "short", "long", 1, "2026-01-20 19:30 20:00"),
    (4, "à 21h15 les 14, 15 & 16 novembre 2025", "day,month,year", "long", "long", 3, "2025-11-14 21:15"),
    (5, "05 déc. 2025 20:00, 06 déc. 2025 20:00, 07 déc. 2025 15:00", "day,month,year", "short", "long", 3, "2025-12-05 20:00"),
    (6, "5 janvier à 8am", "day,month", "long", None, 1, "2026-01-05 08:00"),
    (8, "23 nov 25, 02 dec 25, de 17h à 18h, et de 19h à 20h", "day,month,year", "short", "short", 4, "2025-11-23 17:00 18:00"),
    (9, "09 07.25", "month,day,year", "numeric", "short", 1, "2025-09-07"),
    (10, "23 09 25, 02 12 25", "day,month,year", "numeric", "short", 2, "2025-09-23"),
    (11, "03.06.26-14.06.26 à 17h et 20h", "day,month,year", "numeric", "short", 24, "2026-06-03 17:00"),
    (12, "27, 28 nov, 3 déc, 2025", "day,month,year", "short", "short", 3, "2025-11-27"),
    (13, "nov, 27, 28, déc, 03, 2025, de 17h à 22h", "month,day,year", "short", "short", 3, "2025-11-27 17:00 22:00"),
    (14, "Du jeudi 13 jusqu'au samedi 15 novembre 2025, jeudi à 20h, samedi à 18h", "day,month,year", "long", None, 2, "2025-11-13 20:00"),
    (15, "Samedi 15 novembre 2025 à 20h - dimanche 16 novembre 2025 à 4h", "day,month,year", "long", None, 1, "2025-11-15 20:00 04:00"),
    (16, "Les lundis et mardis de 18h à 19h et de 20h à 21h, du 14 au 27 septembre 2025", "day,month,year", "long", None, 8, "2025-09-15 18:00 19:00"),
    (17, "du lundi au mercredi, à 18h,  14 - 27 septembre 2025. Du samedi au lundi, à 18h, du 01 au 10 octobre 2025.", "day,month,year", "long", "long", 8, "2025-09-15 18:00"),
    (18, "septembre 2026: le 03 à 18h, le 04 à 22h", "month,year,day", "long", "long", 2, "2026-09-03 18:00"),
    (19, "du 07 juin à 19h au 21 juin", "day,month", "long", None, 15, "2026-06-07 19:00"),
    (20, "mercredi, Nov 11, 07:30 PM → samedi, Nov 14", "month,day", "short", None, 4, "2026-11-11 19:30"),
    (21, "septembre 2026: le 03 à 18h, le 04 à 22h, octobre 2026: le 06 à 18h", "month,year,day", "long", "long", 3, "2026-09-03 18:00"),
    (22, "2026 septembre 03, 04, octobre 02", "year,month,day", "long", "long", 3, "2026-09-03"),
    (23, "2025: sept: 2 et 3 à 18h, le 4 à 20h, oct 4 et 5 à 19h", "year,month,day", "short", "long", 5, "2025-09-02 18:00"),
    (24, "à 14h le 03, 04 et 16h le 05 septembre 2025.", "day,month,year", "long", "long", 3, "2025-09-03 14:00"),
    (25, "2025: 2 et 3 sept à 18h, 4 et 5 oct à 19h", "year,day,month", "short", "long", 4, "2025-09-02 18:00"),
    (26, "2025: sept 2 et 3 à 18h, oct 4 et 5 à 19h", "year,month,day", "short", "long", 4, "2025-09-02 18:00"),
    (27, "du 12 au 20 octobre, de 15h à 16h, le mardi, de 16h à 17h le mercredi et jeudi", "day,month", "long", "long", 4, "2026-10-13 15:00 16:00"),
    (28, "2025: 18h les 16 et 17 sept, 21h le 18 sept", "year,day,month", "short", "long", 3, "2025-09-16 18:00"),
    (29, "2025: 18h sept 16 et 17 21h oct 04", "year,month,day", "short", "long", 3, "2025-09-16 18:00"),
    (30, "lundi et mardi, 18/10/25 - 31/10/25", "day,month,year", "numeric", "short", 4, "2025-10-20"),
    (31, "lundi 18/10/25 - dimanche 31/10/25", "day,month,year", "numeric", "short", 14, "2025-10-18"),
    (32, "Du 4 au 6 décembre 2025, à 20h sauf samedi à 18h", "day,month,year", "long", "long", 3, "2025-12-04 20:00"),
    (33, "Du 4 au 8 décembre 2025, à 20h sauf samedi et dimanche à 18h et 21h", "day,month,year", "long", "long", 7, "2025-12-04 20:00"),
    (34, "20h, décembre 2025: du 4 au 8, sauf samedi et dimanche à 18h et 21h", "month,year,day", "long", "long", 7, "2025-12-04 20:00"),
    (35, "Du 8 au 12 décembre 2025, du lundi au mercredi sauf le mardi", "day,month,year", "long", "long", 2, "2025-12-08"),
    (36, "Ce soir à 20h", "day,month,year", "short", "long", 1, "2025-12-01 20:00"),
    (37, "jusqu'à demain, 20h", "day,month,year", "short", "long", 2, "2025-12-01 20:00"),
]


def shown(e):
    d, start, end_date, end = e
    return " ".join(x for x in (d.isoformat(), start, end) if x)


@pytest.mark.parametrize("case", GOLDEN, ids=lambda c: str(c[0]))
def test_golden(case):
    _, text, order, month, year, n, first = case
    # two-digit years of the cases lie in 2025 to 2027; a format asks for a year only where its order has one
    asked = year if "year" in order else None
    got = extract_dates(text, order.split(","), month, asked, TODAY, FRENCH, range(2025, 2028))
    assert len(got) == 1, [list(map(shown, p)) for p in got]
    assert len(got[0]) == n and shown(got[0][0]) == first, list(map(shown, got[0]))


def days(first, last, *times):
    """Every day of a range, at each of the times."""
    a, b = (dt.date.fromisoformat(x) for x in (first, last))
    return [" ".join([(a + dt.timedelta(days=k)).isoformat(), t]).strip() for k in range((b - a).days + 1) for t in times or [""]]


#: The whole result of the cases with several dates, and of case 7, which has two readings (fixed values).
WHOLE = {
    0: days("2025-12-01", "2025-12-09", "18:00 20:00"),
    4: days("2025-11-14", "2025-11-16", "21:15"),
    5: ["2025-12-05 20:00", "2025-12-06 20:00", "2025-12-07 15:00"],
    7: days("2026-11-23", "2026-11-23", "19:00", "21:00") + days("2026-12-26", "2026-12-27", "19:00", "21:00"),
    8: days("2025-11-23", "2025-11-23", "17:00 18:00", "19:00 20:00") + days("2025-12-02", "2025-12-02", "17:00 18:00", "19:00 20:00"),
    10: ["2025-09-23", "2025-12-02"],
    11: days("2026-06-03", "2026-06-14", "17:00", "20:00"),
    12: ["2025-11-27", "2025-11-28", "2025-12-03"],
    13: ["2025-11-27 17:00 22:00", "2025-11-28 17:00 22:00", "2025-12-03 17:00 22:00"],
    14: ["2025-11-13 20:00", "2025-11-15 18:00"],
    16: [x for a, b in (("2025-09-15", "2025-09-16"), ("2025-09-22", "2025-09-23")) for x in days(a, b, "18:00 19:00", "20:00 21:00")],
    17: days("2025-09-15", "2025-09-17", "18:00") + days("2025-09-22", "2025-09-24", "18:00") + days("2025-10-04", "2025-10-05", "18:00"),
    18: ["2026-09-03 18:00", "2026-09-04 22:00"],
    19: ["2026-06-07 19:00", *days("2026-06-08", "2026-06-21")],
    20: ["2026-11-11 19:30", *days("2026-11-12", "2026-11-14")],
    21: ["2026-09-03 18:00", "2026-09-04 22:00", "2026-10-06 18:00"],
    22: ["2026-09-03", "2026-09-04", "2026-10-02"],
    23: days("2025-09-02", "2025-09-03", "18:00") + ["2025-09-04 20:00"] + days("2025-10-04", "2025-10-05", "19:00"),
    24: ["2025-09-03 14:00", "2025-09-04 14:00", "2025-09-05 16:00"],
    25: days("2025-09-02", "2025-09-03", "18:00") + days("2025-10-04", "2025-10-05", "19:00"),
    26: days("2025-09-02", "2025-09-03", "18:00") + days("2025-10-04", "2025-10-05", "19:00"),
    27: ["2026-10-13 15:00 16:00", "2026-10-14 16:00 17:00", "2026-10-15 16:00 17:00", "2026-10-20 15:00 16:00"],
    28: ["2025-09-16 18:00", "2025-09-17 18:00", "2025-09-18 21:00"],
    29: ["2025-09-16 18:00", "2025-09-17 18:00", "2025-10-04 21:00"],
    30: ["2025-10-20", "2025-10-21", "2025-10-27", "2025-10-28"],
    31: days("2025-10-18", "2025-10-31"),
    32: ["2025-12-04 20:00", "2025-12-05 20:00", "2025-12-06 18:00"],
    33: ["2025-12-04 20:00", "2025-12-05 20:00", *days("2025-12-06", "2025-12-07", "18:00", "21:00"), "2025-12-08 20:00"],
    34: ["2025-12-04 20:00", "2025-12-05 20:00", *days("2025-12-06", "2025-12-07", "18:00", "21:00"), "2025-12-08 20:00"],
    35: ["2025-12-08", "2025-12-10"],
    37: ["2025-12-01 20:00", "2025-12-02 20:00"],
}
#: Ends on another day than the start.
OVERNIGHT = {2: ("2026-02-18", "04:00"), 15: ("2025-11-16", "04:00")}


@pytest.mark.parametrize("case", [*GOLDEN, (7, "23 nov 26, 27 dec 26, 19h, 21h", "day,month,year", "short", "short", 6, "2026-11-23 19:00")], ids=lambda c: str(c[0]))
def test_whole_golden(case):
    k, text, order, month, year, n, first = case
    got = extract_dates(text, order.split(","), month, year if "year" in order else None, TODAY, FRENCH, range(2025, 2028))
    assert sorted(map(shown, got[0])) == sorted(WHOLE.get(k, [first])) and len(got[0]) == n and len(got) == (2 if k == 7 else 1)
    for d, start, end_date, end in got[0]:
        if k in OVERNIGHT:
            assert (end_date.isoformat(), end) == OVERNIGHT[k]
        else:
            assert (end_date, bool(end)) == (d if end else None, end is not None)


def test_ambiguous_or_none():
    assert extract_dates("23 nov 26, 27 dec 26, 19h, 21h", ["day", "month", "year"], "short", "short", TODAY, FRENCH, range(2025, 2028))
    for text in ("", None, "bientôt", "99 brumaire"):
        assert extract_dates(text, ["day", "month"], "long", None, TODAY) == []


def test_every_reading_is_tried():
    """Eight numbers that may be day, month or short year; with the year first no early combination reads."""
    order = ["year", "month", "day"]
    window, today = range(2010, 2013), dt.date(2010, 1, 1)
    got = extract_dates("10 10 10 11 11 12 12 12", order, "numeric", "short", today, FRENCH, window)
    want = []
    choices = date_text.tokenize("10 10 10 11 11 12 12 12", FRENCH, order, "numeric", "short", today, window)
    for c in itertools.product(*choices):
        tokens, exceptions = date_text.mark([t for run in c for t in run])
        found = date_text.paths(tokens, order)
        if found and "year" in found[0] and (dates := date_text.dates_of(found, exceptions, today)) and dates not in want:
            want.append(dates)
    assert len(list(itertools.product(*choices))) == 6561 and got == want and len(got) > 0


def test_later_days_have_no_time():
    (got,) = extract_dates("du 07 juin à 19h au 21 juin", ["day", "month"], "long", None, TODAY)
    assert [e[1] for e in got] == ["19:00"] + [None] * 14


def test_column(spark):
    from pyspark.sql import functions as F

    from agendaflow.functions.date_text import parse_dates

    rows = spark.createDataFrame([(1, "5 janvier à 8am"), (2, None), (3, "rien")], "id long, t string")
    got = {r.id: r.d for r in rows.select("id", parse_dates(F.col("t"), ["day", "month"], "long", None, TODAY).alias("d")).collect()}
    assert [(x.start_date, x.start_time) for x in got[1]] == [("2026-01-05", "08:00")] and got[2] is None and got[3] == []
    assert rows.select(parse_dates(F.col("t"), ["day", "month"], "long", None, TODAY, "english").alias("d")).where("d IS NOT NULL").count() == 0


def test_query_reads_every_order(spark):
    """Each range of three days, over the ends of months and years too."""
    from agendaflow.plans import date_queries

    sf = "/root/testdata/sf0.001"
    orders = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey", "to_date(o_orderdate)").collect()}
    got = {(r.o_orderkey, r.start_date) for r in date_queries.extracted_dates(spark, sf).where("possibility = 0").collect()}
    assert got == {(k, (d + dt.timedelta(days=n)).isoformat()) for k, d in orders.items() for n in range(3)}


def every_reading(text, order, months, years, today, window):
    """The readings of the plain walk over all combinations."""
    out = []
    for c in date_text.combinations(date_text.tokenize(text, FRENCH, order, months, years, today, window), order, today, prune=False):
        marked = date_text.mark(c)
        found = date_text.paths(marked[0], order) if marked else None
        if found is None or years and "year" not in found[0]:
            continue
        got = date_text.dates_of(found, marked[1], today)
        if got and got not in out:
            out.append(got)
    return out


FORMATS = [(["day", "month"], None), (["month", "day"], None), (["day", "month", "year"], "short"), (["month", "day", "year"], "short"), (["year", "month", "day"], "short"), (["month", "year", "day"], "short"), (["day", "month", "year"], None)]


@pytest.mark.parametrize("seed", range(12))
def test_pruned_readings_are_all_readings(seed):
    """In the order of the walk, on lists of numbers with words, times, ranges and exceptions among them."""
    rng = random.Random(seed)
    parts = ["à 18h", "de 18h à 20h", "lundi", "au", "-", "sauf mardi", "mars", "mai", "2026", "du", "demain", ","]
    for k in range(60):
        order, years = FORMATS[k % len(FORMATS)]
        pool = rng.sample(range(1, 28), rng.randint(1, 6)) + [25, 26]
        words = [str(rng.choice(pool)) if rng.random() < rng.choice([0.75, 1.0]) else rng.choice(parts) for _ in range(rng.randint(2, 9 if years else 12))]
        words = sorted(words, key=lambda w: int(w) if w.isdigit() else 0) if rng.random() < 0.3 else words
        today = dt.date(2025, rng.randint(1, 12), rng.randint(1, 28))
        text, window = " ".join(words), range(2025, 2028)
        assert extract_dates(text, order, "numeric", years, today, FRENCH, window) == every_reading(text, order, "numeric", years, today, window), (text, order, years, today)


def test_long_lists_take_little_time():
    began = time.perf_counter()
    for order in (["day", "month"], ["month", "day"]):
        assert len(extract_dates(" ".join(["10"] * 60), order, "numeric", None, TODAY)) == 1
        assert extract_dates(" ".join(str(1 + k * 7 % 12) for k in range(60)), order, "numeric", None, TODAY) == []
        extract_dates(" ".join(["11 12"] * 30), order, "numeric", None, TODAY)
    extract_dates(" ".join(["10 11 25"] * 20), ["day", "month", "year"], "numeric", "short", TODAY)
    extract_dates(" ".join(str(k) for k in range(1, 32)), ["month", "day"], "numeric", None, TODAY)
    assert extract_dates(" ".join(str(k) for k in [*range(1, 32), *range(1, 31)]), ["day", "month"], "numeric", None, TODAY) == []
    extract_dates("le " + ", ".join(str(k) for k in range(1, 31)) + " mai, " + ", ".join(str(k) for k in range(1, 31)) + " juin à 20h", ["day", "month"], "numeric", None, TODAY)
    assert time.perf_counter() - began < 5


def test_far_years_are_no_dates():
    long = (["day", "month", "year"], "long", "long", TODAY)
    for text in ("jusqu'au 31 décembre 9999", "du 1 mai 1000 au 2 mai 2026", "le 5 mai 3025", "le 5 mai 0000"):
        assert extract_dates(text, *long) == []
    assert len(extract_dates("du 1 mai 2020 au 2 mai 2026", *long)[0]) == 2193
