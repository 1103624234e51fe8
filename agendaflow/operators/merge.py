"""Greedy reconciliation of one event listed by several sites."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PUNCTUATION, simplify
from ..storage import written
from .graph import linked_sets
from .stats import best_name_order

#: Columns that merging reads; others are not kept.
FIELDS = ["seq", "eventName", "place", "city", "country", "source", "style", "detailedStyle", "eventURL", "unixDate"]
_PUNCTUATION = re.compile("[" + re.escape(PUNCTUATION) + "]")


def simple(text: str | None) -> str:
    """``simplify`` for one string."""
    text = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(r"^\s|\s$", "", re.sub(r"\s{2,}", " ", re.sub(r"[\n\t]", " ", _PUNCTUATION.sub(" ", text))))


def alike(a: str, b: str) -> bool:
    return a in b or b in a


class Groups:
    """Groups of rows with similar names, in order: a row joins the first group whose first name is
    similar, and every other such group is then folded into that one. Rows are not kept, only the names
    of groups and, until a group is new or folded, where each name goes.

    With ``similar``, the names that are similar to each name, a row looks at those alone; without it, at
    every group. Rows come in ascending order."""

    def __init__(self, similar: dict[str, list[str]] | None = None) -> None:
        self.similar = similar
        self.first: dict[int, str] = {}  # groups by their first row, in the order of their making
        self.made: dict[str, int] = {}  # and by their first name
        self.into: dict[int, tuple[int, list[int]]] = {}  # folded: the group that took it, at which row and in which place
        self.known: dict[str, int] = {}
        self.names: dict[int, set[str]] = {}  # the names known of each group

    def _near(self, name: str) -> list[int]:
        if self.similar is None:
            return [g for g, own in self.first.items() if alike(own, name)]
        return sorted(self.made[x] for x in (name, *self.similar.get(name, ())) if x in self.made)

    def _forget(self, names: list[str]) -> None:
        for x in names:
            if x in self.known:
                self.names[self.known.pop(x)].discard(x)

    def add(self, row: int, name: str) -> int:
        if name in self.known:
            return self.known[name]
        near = self._near(name)
        if not near:
            self._forget([x for x in self.known if alike(x, name)] if self.similar is None else self.similar.get(name, []))
            self.first[row] = name
            self.made[name] = row
            self.names[row] = set()
            near = [row]
        for k, g in enumerate(near[1:]):
            self.into[g] = near[0], [row, k]
            del self.made[self.first.pop(g)]
            self._forget(list(self.names[g]))
        self.known[name] = near[0]
        self.names[near[0]].add(name)
        return near[0]

    def folded(self) -> Iterator[tuple[int, int, list[int]]]:
        """Each folded group, the group where it ended and the place of its rows in it."""
        for g in self.into:
            end, at = g, []
            while end in self.into:
                end, place = self.into[end]
                at = place + at
            yield g, end, at


def cluster(keys: list[str]) -> list[list[int]]:
    """The groups of a list of names as lists of positions."""
    groups, rows = Groups(), {}
    at = [groups.add(k, key) for k, key in enumerate(keys)]
    places = {g: (end, place) for g, end, place in groups.folded()}
    for k, g in enumerate(at):
        end, place = places.get(g, (g, []))
        rows.setdefault(end, []).append(([*place, k], k))
    return [[k for _, k in sorted(v)] for v in rows.values()]


#: Length of the pieces of names by which pairs are found; shorter names are pieces themselves.
PIECE = 5


def similar_names(names: DataFrame) -> DataFrame:
    """(a, b, short, long): the pairs of names of one block of which one contains the other. ``names`` has a
    row (block, id, name) for each name of a block.

    A name that lies in another brings all its pieces there, its rarest too. So each name is looked up by its
    rarest piece among all pieces of all names of its block, and only what shares that is compared: a block of
    any size is spread over its pieces, and no two names meet without sharing one.
    """
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda k: F.substring(F.col("name"), k, F.lit(n)))
    pieces = lambda n: F.when(F.length("name") >= n, F.array_distinct(at(n))).otherwise(F.array().cast("array<string>"))
    whole = names.select("block", "id", "name", F.explode(pieces(PIECE)).alias("piece"))
    counts = whole.groupBy("block", "piece").agg(F.count("*").alias("n"))
    rarest = whole.join(counts, ["block", "piece"]).groupBy("block", "id").agg(F.min_by(F.struct("piece", "name"), F.struct("n", "piece")).alias("x")).select("block", "id", "x.name", "x.piece")
    few = names.where(F.length("name") < PIECE).select("block", "id", "name", F.col("name").alias("piece"))
    sought = written(rarest.unionByName(few).select("block", "piece", F.col("id").alias("a"), F.col("name").alias("short")), "names-sought")
    lengths = [r["n"] for r in few.select(F.length("name").alias("n")).distinct().collect()]  # below PIECE
    for n in lengths:
        whole = whole.unionByName(names.select("block", "id", "name", F.explode(pieces(n) if n else F.array(F.lit(""))).alias("piece")))
    found = whole.join(sought, ["block", "piece"]).where((F.col("id") != F.col("a")) & F.col("name").contains(F.col("short")))
    return found.select("a", F.col("id").alias("b"), "short", F.col("name").alias("long"))


def grouped(events: DataFrame, zone: Column | str = "UTC") -> DataFrame:
    """Events with a parsed date, with ``group`` (the seq of the group's first event) and ``ord``, an array
    that sorts the events of a group; written once. Those of one place, city, country and local day form a
    block. ``seq`` tells events apart.

    Names that no other name of their block is similar to are groups by themselves. The others are split
    into sets that no similarity links, since a row's group depends on its own set alone; a task reads a
    set's pairs, then its rows in the order of ``seq``, and each row looks at the names similar to its own.
    So a block of very many names takes many tasks, and time in proportion to its rows and similar pairs.
    """
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis("unixDate"), zone))
    rows = events.where("unixDate > 0").select(*FIELDS, F.struct(simplify(F.col("place")).alias("key"), "city", "country", day.alias("day")).alias("block"), simplify(F.coalesce("eventName", F.lit(""))).alias("name"))
    schema = rows.select(*FIELDS).schema
    names = written(rows.groupBy("block", "name").agg(F.min("seq").alias("id")), "names")
    pairs = written(similar_names(names), "similar-names")
    alone = names.withColumnRenamed("id", "first").withColumn("set", F.lit(None).cast("long"))
    if pairs.limit(1).count():
        sets = linked_sets(pairs).withColumnsRenamed({"node": "first", "root": "own"})
        alone = alone.drop("set").join(sets, "first", "left").withColumnRenamed("own", "set")
    known = written(alone, "names-in-sets")
    placed = rows.join(known.select("block", "name", "first", "set"), ["block", "name"], "left").select(*FIELDS, "name", "first", "set")
    single = placed.where("set IS NULL").select(*FIELDS, F.col("first").alias("group"), F.array("seq").alias("ord"))
    if known.where("set IS NOT NULL").limit(1).count() == 0:
        return written(single, "grouped")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    in_set = known.where("set IS NOT NULL").select("first", "set")
    links = pairs.join(in_set, pairs["a"] == in_set["first"]).select(*blank, F.col("short").alias("name"), F.col("long").alias("other"), "set")
    both = links.unionByName(placed.where("set IS NOT NULL").select(*FIELDS, "name", F.lit(None).cast("string").alias("other"), "set"))
    spread = both.repartition("set").sortWithinPartitions("set", F.col("other").isNull(), "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, groups, given = None, Groups({}), None

        def ends(own: Groups) -> pa.RecordBatch:
            found = list(own.folded())
            nulls = [pa.nulls(len(found), f.type) for f in given.schema]
            return pa.RecordBatch.from_arrays([*nulls, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.int64()))], [*given.schema.names, "group", "end", "path"])

        for batch in batches:
            given = batch.select(FIELDS)
            at, kept = [], []
            for k, (own, name, other, seq) in enumerate(zip(*(batch[c].to_pylist() for c in ("set", "name", "other", "seq")))):
                if own != here:
                    if groups.into:
                        yield ends(groups)
                    here, groups = own, Groups({})
                if other is not None:
                    groups.similar.setdefault(name, []).append(other)
                    groups.similar.setdefault(other, []).append(name)
                else:
                    at.append(groups.add(seq, name))
                    kept.append(k)
            given = given.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*given.columns, pa.array(at, pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.list_(pa.int64()))], [*FIELDS, "group", "end", "path"])
        if groups.into:
            yield ends(groups)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    told = written(spread.mapInArrow(run, f"{kinds}, group long, end long, path array<long>"), "grouped-sets")
    folds = told.where("end IS NOT NULL").select("group", F.col("end").alias("__end"), F.col("path").alias("__path"))
    out = told.where("end IS NULL").drop("end", "path").join(folds, "group", "left")
    order = F.concat(F.coalesce("__path", F.array().cast("array<bigint>")), F.array("seq"))
    return written(single.unionByName(out.select(*FIELDS, F.coalesce("__end", "group").alias("group"), order.alias("ord"))), "grouped")


def merge_events(events: DataFrame, zone: Column | str = "UTC", styles: tuple[str, ...] = ()) -> DataFrame:
    """One row for each real event and date: seq, eventName, place, city, country, style, detailedStyle,
    eventURL, altURLs, unixDate, n_members and warning.

    ``grouped`` says which events are one; the rest are aggregations. The best name, the first style of
    the reference list or else the longest, and the longest detail are taken. If a site lists events at
    its own place, its dates count alone; else a date counts if it is the only one, or if a source that
    lists it lists another too. With no such date the most frequent one is taken, not local midnight if
    others are as frequent, and the earliest of them, with a warning. Addresses of a single date are
    all kept; of several dates each has its own and the others of that date. Rows without a parsed date
    (0 or -1) pass through.
    """
    rows = grouped(events, zone).withColumn("local", F.coalesce(F.col("place") == F.col("source"), F.lit(False)))
    text = lambda c: F.coalesce(c, F.lit(""))
    known = F.col("style").isin(list(styles))
    best = rows.groupBy("group").agg(
        F.count("*").alias("n_members"),
        F.min_by(F.struct("seq", "eventName", "place", "city", "country", "style", "detailedStyle", "eventURL"), "ord").alias("first"),
        F.min_by(text("eventName"), best_name_order(text("eventName"), F.col("ord"))).alias("eventName"),
        F.min_by(text("style"), F.struct(~F.coalesce(known, F.lit(False)), F.when(known, 0).otherwise(-F.length(text("style"))), "ord")).alias("style"),
        F.min_by(text("detailedStyle"), F.struct(-F.length(text("detailedStyle")), "ord")).alias("detailedStyle"),
        F.bool_or("local").alias("has_local"),
        F.min_by("eventURL", F.when(F.col("local") & F.col("eventURL").isNotNull(), F.col("ord"))).alias("local_url"),
    )
    # the groups are small next to their rows: counts, addresses and sources of each date come first
    listed = rows.groupBy("group", "unixDate", "local").agg(
        F.count("*").alias("n"), F.min_by(F.struct("eventURL"), "ord").alias("lead"), F.min("ord").alias("at"),
        F.array_sort(F.collect_list(F.when(F.col("eventURL").isNotNull(), F.struct("ord", "eventURL")))).alias("urls"), F.collect_set("source").alias("sources"),
    )
    used = listed.join(best.where("has_local").select("group", F.lit(True).alias("has_local")), "group", "left").where("local OR has_local IS NULL")
    zero = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(F.timestamp_millis("unixDate"), zone)), zone) == F.timestamp_millis("unixDate")
    dates = used.groupBy("group", "unixDate").agg(
        F.sum("n").alias("n"), F.min_by("lead", "at").alias("lead"), F.array_sort(F.flatten(F.collect_list("urls"))).alias("urls"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources")
    )
    urls = F.array_distinct(F.transform("urls", lambda x: x["eventURL"]))
    dates = dates.select("group", F.struct("unixDate", "n", F.col("lead.eventURL").alias("url"), urls.alias("urls"), "sources", zero.alias("zero")).alias("d"))
    events_of = dates.groupBy("group").agg(F.array_sort(F.collect_list("d")).alias("dates")).join(best, "group")

    sure = F.filter("dates", lambda d: F.exists("dates", lambda o: (o["unixDate"] != d["unixDate"]) & F.arrays_overlap(o["sources"], d["sources"])))
    sure = F.when(F.col("has_local") | (F.size("dates") == 1), F.col("dates")).otherwise(sure)
    most = F.filter("dates", lambda d: d["n"] == F.array_max(F.transform("dates", lambda x: x["n"])))
    timed = F.filter("most", lambda d: ~d["zero"])
    out = events_of.withColumns({"sure": sure, "most": most})
    guess = F.when((F.size("most") > 1) & (F.size(timed) > 0), timed).otherwise(F.col("most"))
    out = out.withColumn("d", F.explode(F.when(F.size("sure") > 0, F.col("sure")).otherwise(F.slice(guess, 1, 1))))
    alone, none, one = F.col("n_members") == 1, F.size("sure") == 0, F.size("sure") == 1
    own = F.when(none | alone, F.col("first.eventURL")).when(one, F.when(F.col("has_local"), F.coalesce("local_url", "first.eventURL")).otherwise(F.col("first.eventURL"))).otherwise(F.col("d.url"))
    others = F.array_except("d.urls", F.array("d.url"))
    pick = lambda c: F.when(alone, F.col(f"first.{c}")).otherwise(F.nullif(F.col(c), F.lit(""))).alias(c)
    merged = out.select(
        "first.seq", F.when(alone, F.col("first.eventName")).otherwise(F.col("eventName")).alias("eventName"), "first.place", "first.city", "first.country", pick("style"), pick("detailedStyle"),
        own.alias("eventURL"), F.when(alone | none, F.lit(None).cast("array<string>")).when(one, F.col("d.urls")).when(F.size(others) > 0, others).alias("altURLs"),
        F.col("d.unixDate").alias("unixDate"), "n_members", F.when(none, F.lit("no date confirmed")).alias("warning"),
    )
    rest = events.where(~F.coalesce(F.col("unixDate") > 0, F.lit(False))).select(
        *[F.lit(1).cast("long").alias(c) if c == "n_members" else (F.col(c) if c in FIELDS else F.lit(None).cast(merged.schema[c].dataType).alias(c)) for c in merged.columns]
    )
    return merged.unionByName(rest)
