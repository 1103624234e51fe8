"""Joins of events with places, venues and their styles and addresses. First and last match are
resolved on the small side before the join, so a join never multiplies events."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import simplify


def one_per_key(df: DataFrame, key: str, seq: str, last: bool) -> DataFrame:
    """The first or last row of each key by ``seq``, as one aggregation."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(pick(F.struct(*rest), F.col(seq)).alias("r")).select(key, "r.*")


def with_coordinates(events: DataFrame, places: DataFrame) -> DataFrame:
    """Events with the longitude and latitude of the last place of their title, [0, 0] where none is,
    and ``known``."""
    last = one_per_key(places.select(F.col("title").alias("place"), "longitude", "latitude", "seq"), "place", "seq", True)
    out = events.join(last.drop("seq"), "place", "left")
    known = F.col("longitude").isNotNull()
    return out.select(*events.columns, F.coalesce("longitude", F.lit(0.0)).alias("longitude"), F.coalesce("latitude", F.lit(0.0)).alias("latitude"), known.alias("known"))


def aliases(venues: DataFrame) -> DataFrame:
    """One row for each name and alias of a venue: seq, name, city, country, key."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return venues.select("seq", "name", "city", "country", F.explode(names).alias("alias")).withColumn("key", simplify(F.col("alias")))


def resolve_places(events: DataFrame, venues: DataFrame, place: str = "place") -> DataFrame:
    """Events whose place is a name or alias of a venue in the same city get that venue's name; of
    several venues the last; else the place stays."""
    known = aliases(venues).groupBy("key", "city", "country").agg(F.max_by("name", "seq").alias("__venue"))
    out = events.withColumn("key", simplify(F.col(place))).join(known, ["key", "city", "country"], "left")
    resolved = F.coalesce("__venue", F.col(place))
    return out.select(*[resolved.alias(c) if c == place else F.col(c) for c in events.columns])


def style_chain(own: Column, place_style: Column, site_style: Column, default: str = "Live") -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(own), blank(place_style), blank(site_style), F.lit(default))


def fix_alias_urls(events: DataFrame, alias_venues: DataFrame) -> DataFrame:
    """Events at an alias venue take its address; the old ones stay in ``altURLs``."""
    first = alias_venues.withColumn("key", simplify(F.col("name"))).groupBy("key", "city", "country").agg(F.min_by("url", "seq").alias("__url"))
    out = events.withColumn("key", simplify(F.col("place"))).join(first, ["key", "city", "country"], "left")
    old = F.coalesce("altURLs", F.array("eventURL"))
    changed = {"altURLs": F.when(F.col("__url").isNotNull(), F.concat(old, F.array("__url"))).otherwise(F.col("altURLs")), "eventURL": F.coalesce("__url", "eventURL")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in events.columns])


def zones(places: DataFrame, registry: DataFrame) -> DataFrame:
    """Places with the zone of their city, else of their country; ``registry`` is (country, city, tz)."""
    own = registry.where("city IS NOT NULL").select("country", "city", F.col("tz").alias("__a"))
    of_country = registry.where("city IS NULL").select("country", F.col("tz").alias("__b"))
    out = places.join(own, ["country", "city"], "left").join(of_country, "country", "left")
    return out.select(*places.columns, F.coalesce("__a", "__b").alias("tz"))


def style_by_dictionary(text: Column, words: list[tuple[str, str]]) -> Column:
    """The last style of the dictionary (style, word) whose simplified word the simplified text
    contains; the text where none is. The dictionary is a parameter and becomes one array literal."""
    table = F.array(*[F.struct(F.lit(s).alias("style"), simplify(F.lit(w)).alias("word")) for s, w in words])
    plain = simplify(text)
    found = F.filter(table, lambda e: plain.contains(e["word"]))
    return F.coalesce(F.try_element_at(found, F.lit(-1))["style"], text)


#: Characters of dictionary words in one automaton, which each Python worker holds; larger dictionaries are
#: searched in parts.
AUTOMATON_CHARS = 8_000_000
_automata: dict[str, object] = {}


def _automaton(name: str, words: list[tuple[str, int]]):
    """The automaton of (word, number), the largest number of a word; kept by the worker."""
    if name not in _automata:
        import ahocorasick

        found = ahocorasick.Automaton()
        for word, n in words:
            if found.get(word, -1) < n:
                found.add_word(word, n)
        found.make_automaton()
        _automata.clear()
        _automata[name] = found
    return _automata[name]


def _searcher(words, name: str):
    @F.pandas_udf("long")
    def search(texts: pd.Series) -> pd.Series:
        own = _automaton(name, words.value)
        hit = lambda x: max((n for _, n in own.iter(x)), default=None) if x and len(own) else None
        known = {x: hit(x) for x in texts.dropna().unique()}
        return texts.map(known.get).astype("Int64")

    return search


def last_words(text: Column, words: DataFrame, most_chars: int = AUTOMATON_CHARS) -> Column:
    """The largest ``n`` of the words (word, n) that a text contains, null where it contains none.

    An automaton finds all words in one pass over the text, however many there are. The dictionary's size is
    counted first; it is broadcast in parts of at most ``most_chars``, so one of any size is searched exactly, in
    as many passes as it has parts.
    """
    spark = words.sparkSession
    words = words.where("word IS NOT NULL").groupBy("word").agg(F.max("n").cast("long").alias("n"))
    chars = words.agg(F.sum(F.length("word") + 1).alias("n")).first()["n"] or 0
    parts, found = max(1, -(-chars // most_chars)), []
    for p in range(parts):
        rows = words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == p).collect()
        blank = next((r["n"] for r in rows if r["word"] == ""), None)  # every text contains it
        shared, name = spark.sparkContext.broadcast([(r["word"], r["n"]) for r in rows if r["word"]]), uuid.uuid4().hex
        found += [_searcher(shared, name)(text), *([F.when(text.isNotNull(), F.lit(blank))] if blank is not None else [])]
    return F.greatest(*found) if len(found) > 1 else found[0]


def styles_by_dictionary(rows: DataFrame, text: str, dictionary: DataFrame, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``rows`` with ``found_style``: the style of the last word of a dictionary (style, word, ord), of any
    size, that the simplified text contains, words being simplified too; the text where there is none, null
    for null. Of words that are the same once simplified the last counts."""
    plain = dictionary.select("style", "ord", simplify(F.col("word")).alias("word"))
    marked = rows.withColumn("__n", last_words(simplify(F.col(text)), plain.select("word", F.col("ord").alias("n")), most_chars))
    styles = plain.groupBy(F.col("ord").alias("__n")).agg(F.max("style").alias("__style"))
    return marked.join(styles, "__n", "left").select(*rows.columns, F.coalesce("__style", text).alias("found_style"))


def country_styles(countries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The distinct styles of each country's languages, in order; ``countries`` is (country, languages),
    ``dictionary`` (language, style, ord)."""
    spoken = countries.select("country", F.posexplode_outer("languages").alias("pos", "language"))
    joined = spoken.join(dictionary, "language", "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("style").isNotNull(), F.struct("pos", "ord", "style"))))
    return joined.groupBy("country").agg(F.array_distinct(F.transform(listed, lambda x: x["style"])).alias("styles"))


def with_addresses(events: DataFrame, places: DataFrame) -> DataFrame:
    """Events with the address of the last place of their title, null where none is."""
    last = one_per_key(places.select(F.col("title").alias("place"), "url", "seq"), "place", "seq", True)
    return events.join(last.drop("seq"), "place", "left").select(*events.columns, "url")


def with_default_style(events: DataFrame, venues: DataFrame, default: str = "Live") -> DataFrame:
    """Events whose blank style becomes that of the first venue of their place (simplified name, city and
    country), of their site (``siteStyle``), or the default."""
    first = venues.withColumn("__key", simplify(F.col("name"))).groupBy("__key", "city", "country").agg(F.min_by("defaultStyle", "seq").alias("__style"))
    out = events.withColumn("__key", simplify(F.col("place"))).join(first, ["__key", "city", "country"], "left")
    style = style_chain(F.col("style"), F.col("__style"), F.col("siteStyle"), default)
    return out.select(*[style.alias(c) if c == "style" else F.col(c) for c in events.columns])


def unique_names(venues: DataFrame, id_: str, city: str, names: str) -> DataFrame:
    """The venues that have names, in ``names``, which no other entry of their city has, and how many."""
    keys = venues.select(id_, city, F.explode(names).alias("__name")).withColumn("__key", simplify(F.col("__name")))
    once = keys.groupBy(city, "__key").agg(F.count("*").alias("__n"), F.min(id_).alias(id_)).where("__n = 1")
    return once.groupBy(id_).agg(F.count("*").alias("n"))


def event_place(place: Column, source: Column) -> Column:
    """The place of an event as a struct: its name, and the city and country of its source."""
    return F.struct(place.alias("name"), source["city"].alias("city"), source["country"].alias("country"))


def same_city_others(venues: DataFrame, city: str, name: str) -> DataFrame:
    """``venues`` with ``n_others``: how many venues of the same city have another name, once simplified. Counted by
    city and by name, so venues are not paired."""
    key = venues.withColumn("__key", F.coalesce(simplify(F.col(name)), F.lit("")))
    by_name = key.groupBy(city, "__key").agg(F.count("*").alias("__own"))
    by_city = by_name.groupBy(city).agg(F.sum("__own").alias("__all"))
    return key.join(by_name, [city, "__key"], "left").join(by_city, city, "left").select(*venues.columns, (F.col("__all") - F.col("__own")).alias("n_others"))


#: Parts into which a city's venues are dealt while they are paired.
PARTS = 32


def same_city_pairs(venues: DataFrame, id_: str, city: str, name: str, parts: int = PARTS) -> DataFrame:
    """(a, b) with a < b: the ids of all pairs of venues of the same city whose names differ once simplified; venues
    without id, city or name are in none.

    There are as many rows as pairs. Each venue meets every part of its city, so the pairs of a large city are made
    in many tasks, whatever the number of cities."""
    keys = venues.select(F.col(id_).alias("a"), F.col(city).alias("__city"), simplify(F.col(name)).alias("__key"))
    others = keys.select(F.col("a").alias("b"), "__city", F.col("__key").alias("__other"), F.pmod(F.xxhash64("a"), F.lit(parts)).alias("__part"))
    spread = keys.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return spread.join(others.hint("merge"), ["__city", "__part"]).where("a < b AND __key <> __other").select("a", "b")


def languages_without_dictionary(languages: DataFrame, known: DataFrame, language: str) -> DataFrame:
    """The languages, each once, that no dictionary knows."""
    return languages.select(language).where(F.col(language).isNotNull()).distinct().join(known.select(language), language, "left_anti")
