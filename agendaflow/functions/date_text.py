"""Free-text dates of event pages: ``du 12 au 20 octobre, de 15h à 16h, le mardi`` and the like.

A text becomes typed tokens (day, month, year, time, weekday). Levels are the types in the order of
their first appearance; tokens form a forest by level, and a token without children takes those of the
next token of its level, which is how ``14, 15 & 16 novembre`` shares its month. Each path is a date.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Words of French dates (fixed values): names, then short forms.
FRENCH = {
    "weekdays": [["lundi", "lundis", "lun"], ["mardi", "mardis", "mar"], ["mercredi", "mercredis", "mer"], ["jeudi", "jeudis", "jeu"], ["vendredi", "vendredis", "ven"], ["samedi", "samedis", "sam"], ["dimanche", "dimanches", "dim"]],
    "months": [["janvier", "jan", "janv"], ["fevrier", "fev"], ["mars", "mar"], ["avril", "avr"], ["mai"], ["juin"], ["juillet", "juil", "juill"], ["aout"], ["septembre", "sep", "sept"], ["octobre", "oct"], ["novembre", "nov"], ["decembre", "dec"]],
    "to": ["au", "jusqu'au", "jusqu'a", "a"],
    "until": ["jusqu'au", "jusqu'a"],
    "today": ["aujourd'hui", "ce soir"],
    "tomorrow": ["demain"],
    "except": ["sauf"],
    "midnight": ["minuit"],
}
DICTIONARIES = {"french": FRENCH}
FRENCH_MONTH_NAMES = [names[0] for names in FRENCH["months"]]

_SCAN = re.compile(
    r"(?P<time>\d{1,2}:\d{2}(?:\s?[ap]m)?\b|\d{1,2}\s?[ap]m\b|\d{1,2}\s?h(?:\d{2})?(?![a-z0-9]))"
    r"|(?P<group>\d{1,4}(?:[./]\d{1,4})+)|(?P<number>\d+)|(?P<dash>-+>?|>)|(?P<word>[a-z]+(?:'[a-z]+)*)"
)


@dataclass
class Token:
    kind: str
    value: object = None
    mark: str = ""
    children: list = field(default_factory=list)
    place: int = 0


def clean(text: str) -> str:
    """Lower case without accents; arrows and long dashes as plain ones."""
    text = re.sub("[→–—]", "-", text.replace("’", "'"))
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if ord(c) < 128)


def clock(text: str) -> str | None:
    """``HH:MM`` of 18h, 18h30, 8am or 07:30 pm."""
    m = re.match(r"(\d{1,2})\s?[h:]?\s?(\d{2})?\s?([ap]m)?", text)
    hour, minute = int(m[1]), int(m[2] or 0)
    if m[3]:
        hour = hour % 12 + 12 * (m[3] == "pm")
    return f"{hour:02d}:{minute:02d}" if hour < 25 and minute < 60 else None


#: How far ahead events are listed: a later year of four digits is no year, a longer range none of dates.
MOST_YEARS = 10


def readings(number: str, months: str, years: str | None, window: range) -> list[Token]:
    """What a number may be: a day, a numeric month, a short year or a long one."""
    n, out = int(number), []
    if len(number) == 4:
        return [Token("year", n)] if 1 <= n < window.start + MOST_YEARS else []
    if 1 <= n <= 31:
        out.append(Token("day", n))
    if months == "numeric" and 1 <= n <= 12:
        out.append(Token("month", n))
    if years == "short" and len(number) == 2 and 2000 + n in window:
        out.append(Token("year", 2000 + n))
    return out


def tokenize(text: str, words: dict, order: list[str], months: str, years: str | None, today: dt.date, window: range) -> list[list[list[Token]]]:
    """The possible tokens, or runs of them, at each place; separators and exceptions are tokens too."""
    phrase = {p: k for k in ("today", "tomorrow", "except", "midnight", "until", "to") for p in reversed(words[k])}
    phrase |= {p: "until" for p in words["until"]}
    text = clean(text)
    for p in words["today"]:
        text = text.replace(p, p.replace(" ", "'"))
    phrase |= {p.replace(" ", "'"): "today" for p in words["today"]}
    part = lambda d: [Token(k, getattr(d, k)) for k in order]
    out: list[list[list[Token]]] = []
    for m in _SCAN.finditer(text):
        kind, s = m.lastgroup, m[0]
        if kind == "time":
            if value := clock(s):
                out.append([[Token("time", (value, None))]])
        elif kind == "group":
            numbers = re.split("[./]", s)
            fits = [o for a in range(len(order)) if len(o := order[a : a + len(numbers)]) == len(numbers) and all(any(t.kind == k for t in readings(n, months, years, window)) for n, k in zip(numbers, o))]
            if fits:
                out.append([[t for n, k in zip(numbers, o) for t in readings(n, months, years, window) if t.kind == k] for o in fits])
        elif kind == "number":
            if found := readings(s, months, years, window):
                out.append([[t] for t in found])
        elif kind == "dash":
            out.append([[Token("to", "-")]])
        elif s in phrase:
            k = phrase[s]
            if k in ("today", "tomorrow"):
                out.append([part(today + dt.timedelta(days=k == "tomorrow"))])
            elif k == "midnight":
                out.append([[Token("time", ("24:00", None))]])
            else:
                out.append([[Token(k, s)]])
        else:
            found = [Token("weekday", k) for k, names in enumerate(words["weekdays"]) if s in names]
            short = months == "short"
            found += [Token("month", k + 1) for k, names in enumerate(words["months"]) if s == names[0] or s in names[1:] and (short or not found)]
            if found:
                out.append([[t] for t in found])
    return out


def mark(tokens: list[Token]) -> tuple[list[Token], list[tuple[set, list]]] | None:
    """Joins time ranges, spreads weekday ranges, marks range ends and takes exceptions out."""
    seq: list[Token] = []
    exceptions: list[tuple[set, list]] = []
    k = 0
    while k < len(tokens):  # times joined by a separator
        t = tokens[k]
        if t.kind == "time" and k + 2 < len(tokens) and tokens[k + 1].kind in ("to", "until") and tokens[k + 2].kind == "time":
            seq.append(Token("time", (t.value[0], tokens[k + 2].value[0])))
            k += 3
        else:
            seq.append(Token(t.kind, t.value))
            k += 1
    tokens, seq, k = seq, [], 0
    while k < len(tokens):
        t = tokens[k]
        if t.kind == "except":
            days, times = set(), []
            while k + 1 < len(tokens) and tokens[k + 1].kind in ("weekday", "time", "to"):
                k += 1
                if tokens[k].kind == "weekday":
                    days.add(tokens[k].value)
                elif tokens[k].kind == "time":
                    times.append(tokens[k].value)
            exceptions.append((days, times))
        elif t.kind == "weekday" and k + 2 < len(tokens) and tokens[k + 1].kind in ("to", "until") and tokens[k + 2].kind == "weekday" and not (k + 3 < len(tokens) and tokens[k + 3].kind == "day" and seq and seq[-1].kind == "day"):
            last = tokens[k + 2].value
            # over the week's end a range stops on Sunday
            seq += [Token("weekday", d) for d in range(t.value, (6 if last < t.value else last) + 1)]
            k += 2
        else:
            seq.append(t)
        k += 1
    out: list[Token] = []
    pending = ""
    for t in seq:
        if t.kind in ("to", "until"):
            if t.value == "a":
                continue  # between times only
            open_start = next((x for x in reversed(out) if x.kind == "day"), None)
            if open_start is not None and not open_start.mark and not pending:
                open_start.mark, pending = "start", "end"
            elif t.kind == "until" and not pending:
                pending = "until"
            elif t.value == "-":
                return None
            continue
        if t.kind == "day" and pending:
            t.mark, pending = pending, ""
        out.append(t)
    marked = [k for k, t in enumerate(out) if t.mark]
    # the weekday of each range end only repeats what the date says
    first = [next((j for j in range(k, -1, -1) if out[j].kind == "weekday" and all(x.kind in ("month", "year", "time") for x in out[j + 1 : k])), None) for k in marked]
    if marked and all(j is not None for j in first):
        out = [t for k, t in enumerate(out) if k not in first]
    return (out, exceptions) if not pending else None


def paths(tokens: list[Token], order: list[str]) -> list[dict[str, Token]] | None:
    """All root-to-leaf paths of the forest, or None where the tokens don't fit the order."""
    levels = list(dict.fromkeys(t.kind for t in tokens))
    dates = [k for k in levels if k in ("day", "month", "year")]
    if "day" not in dates or "month" not in dates or dates != [k for k in order if k in dates]:
        return None
    depth = {k: i for i, k in enumerate(levels)}
    rows: list[list[Token]] = [[] for _ in levels]
    roots: list[Token] = []
    stack: list[Token] = []
    for place, t in enumerate(tokens):
        d = depth[t.kind]
        if stack and depth[stack[-1].kind] < d:
            between = levels[depth[stack[-1].kind] + 1 : d]
            if any(k in ("day", "month", "year") for k in between):
                return None
        elif stack and depth[stack[-1].kind] == d and t.kind in ("month", "year"):
            return None
        while stack and depth[stack[-1].kind] >= d:
            stack.pop()
        t.place = place
        (stack[-1].children if stack else roots).append(t)
        rows[d].append(t)
        stack.append(t)
    for row in reversed(rows[:-1]):
        for left, right in reversed(list(zip(row, row[1:]))):
            if not left.children:
                left.children = right.children
    out: list[dict[str, Token]] = []

    def walk(t: Token, held: dict[str, Token]) -> None:
        held = held | {t.kind: t}
        if t.children:
            for c in t.children:
                walk(c, held)
        else:
            out.append(held)

    for r in roots:
        walk(r, {})
    need = {"day", "month", *(["year"] if "year" in dates else [])}
    return out if all(need <= set(p) for p in out) else None


def dates_of(found: list[dict[str, Token]], exceptions: list[tuple[set, list]], today: dt.date) -> list[tuple] | None:
    """(start date, start time, end date, end time) of each event, or None for impossible dates."""

    def day_of(p: dict[str, Token]) -> dt.date:
        month, day = p["month"].value, p["day"].value
        year = p["year"].value if "year" in p else today.year + ((month, day) < (today.month, today.day))
        return dt.date(year, month, day)

    def keep(p: dict[str, Token], d: dt.date) -> bool:
        return "weekday" not in p or p["weekday"].value == d.weekday()

    out: list[tuple] = []

    def days(a: dt.date, b: dt.date) -> range:
        """The days from a on, up to b."""
        if (b - a).days > 366 * MOST_YEARS:
            raise ValueError("no range of dates")
        return range((b - a).days + 1)

    def add(d: dt.date, time: tuple | None, end: tuple | None = None) -> None:
        start, stop = time or (None, None)
        out.append((d, start, *(end or (d if stop else None, stop))))

    try:
        plain = [day_of(p) for p in found]
        seen: dict[int, dt.date] = {}
        for p, d in zip(found, plain):
            seen.setdefault(p["day"].place, d)
        listed = [seen[k] for k in sorted(seen)]
        if any(a > b for a, b in zip(listed, listed[1:])):
            return None
        ends = [p for p in found if p["day"].mark == "end"]
        for p, d in zip(found, plain):
            time = p["time"].value if "time" in p else None
            if not p["day"].mark:
                if keep(p, d):
                    add(d, time)
            elif p["day"].mark == "until":
                for n in days(today, d):
                    if keep(p, now := today + dt.timedelta(days=n)):
                        add(now, time)
            elif p["day"].mark == "start":
                after = min((e["day"].place for e in ends if e["day"].place > p["day"].place), default=None)
                mates = [e for e in ends if e["day"].place == after]
                if not mates:
                    return None
                same = [e for e in mates if e.get("time") is p.get("time") and e.get("weekday") is p.get("weekday")]
                other = [e for e in mates if "time" in e and "time" in p and e["time"] is not p["time"]]
                if same:
                    last = day_of(same[0])
                    for n in days(d, last):
                        if keep(p, now := d + dt.timedelta(days=n)):
                            add(now, time)
                elif other and not any(e.get("time") is q.get("time") for e in mates for q in found if q["day"] is p["day"]):
                    add(d, (time[0], None), (day_of(other[0]), other[0]["time"].value[0]))
                elif all("time" not in e for e in mates):
                    add(d, time)
                    for n in days(d, day_of(mates[0]))[1:]:
                        add(d + dt.timedelta(days=n), None)
    except ValueError:
        return None
    for days, times in exceptions:
        hit = list(dict.fromkeys(d for d, *_ in out if d.weekday() in days))
        out = [e for e in out if e[0] not in hit]
        out += [(d, t[0], d if t[1] else None, t[1]) for d in hit for t in times]
    return list(dict.fromkeys(sorted(out, key=lambda e: (e[0], e[1] or ""))))


@dataclass(frozen=True)
class Chronology:
    """The dates that a run of tokens has settled, as far as days, months and years tell before the text ends.

    Where months follow days, days wait for their month. Where years come last, dates wait for their year, and
    those that wait together ascend. A text that names no year takes each date's year from today's.
    """

    days: tuple = ()
    month: int | None = None
    year: int | None = None
    waiting: tuple | None = None  # the first and the last (month, day) of the next year
    last: tuple | None = None

    def after(self, t: Token, place: dict[str, int], no_year: bool, today: dt.date) -> Chronology | None:
        """With one token more; None where no text that goes on so can be in order."""
        days_first = place["day"] < place["month"]
        year_last = place["year"] > max(place["day"], place["month"]) and not no_year
        if t.kind == "year":
            if not year_last or self.waiting is None:
                return replace(self, year=t.value)
            first, end = self.waiting
            late = self.last is None or (t.value, *first) >= self.last
            return replace(self, waiting=None, last=(t.value, *end)) if late else None
        if t.kind == "day" and days_first:
            return self._wait(t.value, no_year, today)
        if t.kind == "month":
            now, settled = replace(self, month=t.value, days=()), self.days if days_first else ()
        else:
            now, settled = self, (t.value,) if self.month is not None else ()
        waiting, last = now.waiting, now.last
        for d in settled:
            if d > _LONGEST[now.month]:
                return None
            if year_last:
                if waiting is not None and (now.month, d) < waiting[1]:
                    return None
                waiting = waiting[0] if waiting else (now.month, d), (now.month, d)
            elif no_year or now.year is not None:
                whole = today.year + ((now.month, d) < (today.month, today.day)) if no_year else now.year, now.month, d
                if last is not None and whole < last:
                    return None
                last = whole
        return replace(now, waiting=waiting, last=last)


    def _wait(self, d: int, no_year: bool, today: dt.date) -> Chronology | None:
        """With one day more of the same month: no earlier than the one before, or once, without a year, where
        today lies between the two, and then before today."""
        if self.days and d == self.days[-1]:
            return self
        passed = any(a > b for a, b in zip(self.days, self.days[1:]))
        if self.days and d < self.days[-1] and (passed or not no_year or not d < today.day <= self.days[-1]):
            return None
        if passed and d >= today.day:
            return None
        return replace(self, days=(*self.days, d))


_LONGEST = [0, 31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def _joined(held: list[Token], t: Token, place: dict[str, int]) -> list[Token]:
    """``held`` with one token more, without what says the same again: the day just named, or a month whose
    days stand beside those of the same month. Texts with separators or exceptions are left as they are."""
    if any(x.kind in ("to", "until", "except") for x in held):
        return [*held, t]
    if t.kind == "day" and held and held[-1].kind == "day" and held[-1].value == t.value:
        return held
    later = place["day"] < place["month"]
    if t.kind == ("month" if later else "day"):
        own = t if later else held[-1] if held and held[-1].kind == "month" else None
        k = len(held) - 1 if later else len(held) - 2
        while own is not None and k >= 0 and held[k].kind == "day":
            k -= 1
        if own is not None and 0 <= k < (len(held) - 1 if later else len(held) - 2) and held[k].kind == "month" and held[k].value == own.value and (not later or k and held[k - 1].kind == "day"):
            return [*held[:k], *held[k + 1 :], t] if later else [*held[:-1], t]
    return [*held, t]


def combinations(choices: list[list[list[Token]]], order: list[str], today: dt.date | None = None, prune: bool = True) -> Iterator[list[Token]]:
    """The combinations of one choice at each place that may be dates, in the order of a product. One is
    left at the first token after which ``paths`` can't succeed: days, months and years that first
    appear against ``order``, two months or years together, a jump over a level, or a kind that no
    later place can bring. With ``prune``, so is one whose dates can't ascend, and of those that so far say
    the same, and so end alike, the first goes on alone. Time follows the readings that differ then, where a
    plain product nearly doubles with each number."""
    place = {k: i for i, k in enumerate(order)}
    later: list[set] = [set()]  # the kinds that places from k on may bring
    for runs in reversed(choices):
        later.append(later[-1] | {t.kind for run in runs for t in run})
    later.reverse()
    no_year = "year" not in later[0] or "year" not in place
    prune = prune and {"day", "month"} <= set(place)
    place.setdefault("year", -1)

    def step(seen: tuple[str, ...], last: str | None, t: Token) -> tuple[tuple[str, ...], str | None] | None:
        """The kinds of dates so far and the one just before, None after a weekday or time."""
        if t.kind in ("weekday", "time", "except"):
            return seen, None
        if t.kind not in place or t.kind not in order:
            return seen, last
        if t.kind not in seen:
            if seen and place[t.kind] < place[seen[-1]]:
                return None
            seen = (*seen, t.kind)
        if last and (last == t.kind != "day" or seen.index(t.kind) > seen.index(last) + 1):
            return None
        return seen, t.kind

    stack = [(0, (), None, [], Chronology())]
    known = set()
    while stack:
        k, seen, last, held, dates = stack.pop()
        if not {"day", "month"} <= later[k] | set(seen):
            continue
        if prune:
            key = k, seen, last, tuple((t.kind, t.value) for t in held)
            if key in known:
                continue
            known.add(key)
        if k == len(choices):
            yield held
            continue
        for run in reversed(choices[k]):
            state, own, now = (seen, last), held, dates
            for t in run:
                if not (state := step(*state, t)):
                    break
                if prune and t.kind in ("day", "month", "year") and t.kind in order:
                    now = now.after(t, place, no_year, today or dt.date.min)
                    if now is None:
                        state = None
                        break
                    own = _joined(own, t, place)
                else:
                    own = [*own, t]
            if state and not (prune and now.days and "month" not in later[k + 1]):
                stack.append((k + 1, *state, own, now))


def read_choices(choices: list[list[list[Token]]], order: list[str], years: str | None, today: dt.date) -> list[list[tuple]]:
    """The possible readings of a text whose tokens may be the runs of ``choices``, each a list of
    (start date, time, end date, time); a format with years needs one."""
    out: list[list[tuple]] = []
    for combination in combinations(choices, order, today):
        marked = mark(combination)
        if marked is None:
            continue
        found = paths(marked[0], order)
        if found is None or years and "year" not in found[0]:
            continue
        got = dates_of(found, marked[1], today)
        if got and got not in out:
            out.append(got)
    return out


def extract_dates(text: str | None, order: list[str], months: str, years: str | None, today: dt.date, words: dict = FRENCH, window: range | None = None) -> list[list[tuple]]:
    """The possible readings of one text by plain Python; none where it has no date. Tables of texts are read by
    ``operators.date_tokens``, which the tests compare with this."""
    if not text:
        return []
    window = window or range(today.year, today.year + 3)
    return read_choices(tokenize(text, words, order, months, years, today, window), order, years, today)


_DATE = StructType([StructField(n, t) for n, t in (("possibility", IntegerType()), ("start_date", StringType()), ("start_time", StringType()), ("end_date", StringType()), ("end_time", StringType()))])


def parse_dates(text: Column, order: list[str], months: str, years: str | None, as_of: dt.date, language: str = "french") -> Column:
    """``extract_dates`` of a column as an array of structs; a language without dictionary gives null."""
    words = DICTIONARIES.get(language)

    @F.pandas_udf(ArrayType(_DATE))
    def run(s: pd.Series) -> pd.Series:
        iso = lambda d: d.isoformat() if d else None
        one = lambda x: [(k, iso(a), b, iso(c), d) for k, p in enumerate(extract_dates(x, order, months, years, as_of, words)) for a, b, c, d in p]
        known = {x: one(x) for x in s.dropna().unique()} if words is not None else {}
        return s.map(lambda x: known.get(x) if isinstance(x, str) else None)

    return run(text)


def first_reading(text: str, formats: list[tuple], today: dt.date, words: dict) -> tuple[int, list[tuple]]:
    """How many readings the last format that reads the text gives, and the first of them. Formats (order,
    months, years) are tried up to one that reads it in one way."""
    n, dates = 0, []
    for order, months, years in formats:
        if got := extract_dates(text, list(order), months, years, today, words):
            n, dates = len(got), got[0]
            if n == 1:
                break
    return n, dates


_READ = StructType([StructField("n", IntegerType()), StructField("dates", ArrayType(StructType([f for f in _DATE.fields if f.name != "possibility"])))])


def read_dates(text: Column, formats: Column, as_of: Column, language: Column, dictionaries: dict[str, dict] | None = None) -> Column:
    """``first_reading`` of a column, its formats, day and language being columns too; each distinct
    combination of a batch is read once. A language without a dictionary gives no reading.
    ``dictionaries`` (``registries.date_words``) take the place of the built-in ones."""
    known_words = DICTIONARIES if dictionaries is None else dictionaries

    @F.pandas_udf(_READ)
    def run(texts: pd.Series, formats: pd.Series, days: pd.Series, languages: pd.Series) -> pd.DataFrame:
        iso = lambda d: d.isoformat() if d else None
        known: dict[tuple, tuple] = {}
        rows = []
        for x, f, day, language in zip(texts, formats, days, languages):
            own = () if f is None else tuple((tuple(o["order"]), o["month"], o["year"]) for o in f)
            key = x, own, day, language
            if key not in known:
                words = known_words.get(language)
                n, dates = first_reading(x, list(own), day, words) if x and words is not None and day is not None else (0, [])
                known[key] = n, [{"start_date": iso(a), "start_time": b, "end_date": iso(c), "end_time": e} for a, b, c, e in dates]
            rows.append(known[key])
        return pd.DataFrame(rows, columns=["n", "dates"])

    return run(text, formats, as_of, language)
