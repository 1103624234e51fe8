"""Recipes as data: field rules, merged and pruned maps, scores of elements, plug-in classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import path_hits


def apply_rule(field: Column, rule: Column) -> Column:
    """A venue's rule for a field: one pattern keeps its first match, a pattern and a replacement
    replace the first match, no rule keeps the field."""
    one, two = rule[0], F.try_element_at(rule, F.lit(2))
    replaced = F.call_function("regexp_replace", field, F.concat(F.lit("^([\\s\\S]*?)(?:"), one, F.lit(")")), F.concat(F.lit("$1"), two))
    return F.when(F.coalesce(F.size(rule), F.lit(0)) == 0, field).when(F.size(rule) == 1, F.call_function("regexp_extract", field, one, F.lit(0))).otherwise(replaced)


def merge_maps(a: Column, b: Column) -> Column:
    """Two maps of lists; lists of the same key are joined."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda k, x, y: F.concat(F.coalesce(x, none), F.coalesce(y, none)))


def prune(recipe: Column) -> Column:
    return F.map_filter(recipe, lambda k, v: v.isNotNull() & (F.size(v) > 0))


def plausible_year(year: Column, as_of_year: int) -> Column:
    return (year >= as_of_year - 1) & (year <= as_of_year + 3)


def uses_alternate(key: str, value: Column) -> Column:
    """Alternate paths are read for fields that are missing or blank, and for every date."""
    return F.lit("Date" in key) | (F.trim(F.coalesce(value, F.lit(""))) == "")


def scores(blocks: DataFrame, block: str, recipe: Column) -> DataFrame:
    """Blocks with hits (how many keys their paths reach) and whether they reach a name and a date."""
    out = blocks.withColumn("__h", path_hits(F.col(block), recipe))
    reached = F.map_keys(F.map_filter("__h", lambda k, n: n > 0))
    named = lambda kind: F.exists(reached, lambda k: k.contains(kind))
    return out.withColumns({"hits": F.size(reached), "is_event": named("Name") & named("Date")}).drop("__h")


def sub_event_score(hits: Column, extra: Column) -> Column:
    """The paths that hit, further hits of the same paths only breaking ties."""
    return hits + F.lit(0.01) * extra


def best_block(scored: DataFrame, group: str, seq: str) -> DataFrame:
    """The block of most hits in each group, the first on a tie."""
    return scored.groupBy(group).agg(F.max_by(seq, F.struct("hits", -F.col(seq))).alias(seq), F.max("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("blocks_hit"))


def class_difference(nodes: DataFrame, group: str, classes: str) -> DataFrame:
    """The most classes that one node of a group has and another lacks, read against the group's all."""
    every = nodes.groupBy(group).agg(F.array_distinct(F.flatten(F.collect_set(classes))).alias("__all"))
    return nodes.join(every, group).groupBy(group).agg(F.max(F.size(F.array_except("__all", classes))).alias("most"))


def close_records(entities: DataFrame, group: str, seq: str, kind: str, value: str) -> DataFrame:
    """Events from recognised entities in order: a record ends when artist, date and place are there."""
    blank = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("artist", "date", "place")])
    listed = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(kind).alias("k"), F.col(value).alias("v"))))
    start = F.struct(F.array().cast("array<struct<artist:string,date:string,place:string>>").alias("out"), blank.alias("now"))

    def step(state, e):
        now = F.struct(*[F.when(e["k"] == c, e["v"]).otherwise(state["now"][c]).alias(c) for c in ("artist", "date", "place")])
        full = now["artist"].isNotNull() & now["date"].isNotNull() & now["place"].isNotNull()
        return F.when(full, F.struct(F.concat(state["out"], F.array(now)).alias("out"), blank.alias("now"))).otherwise(F.struct(state["out"].alias("out"), now.alias("now")))

    folded = entities.groupBy(group).agg(listed.alias("l")).select(group, F.aggregate("l", start, step, lambda s: s["out"]).alias("r"))
    return folded.select(group, F.explode("r").alias("e")).select(group, "e.*")


def classify(pages: DataFrame, text: str, answer: Callable[[str], str], name: str = "style") -> DataFrame:
    """Pages with the caller's answer for their text (a model, a service or a fake)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields), f"{name} string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: [None if t is None else answer(t) for t in pdf[text]]})

    return pages.mapInPandas(run, schema)


def same_record(a: Column, b: Column) -> Column:
    """Whether two structs, arrays or scalars are equal in all their parts, null being equal to null."""
    return a.eqNullSafe(b)


def combinations_without(classes: Column, k: int) -> Column:
    """The lists that remain of an array when ``k`` of its entries go, in every way, the last first."""
    out = F.array(classes)
    for _ in range(k):
        out = F.flatten(F.transform(out, lambda own: F.transform(F.reverse(F.filter(F.sequence(F.lit(0), F.size(own)), lambda j: j > 0)), lambda j: F.concat(F.slice(own, F.lit(1), j - 1), F.slice(own, j + 1, F.size(own))))))
    return F.array_distinct(out)


def recipe_of_answer(answer: Column) -> Column:
    """The sample strings of one event in a model's JSON answer (key to string or list), as key to strings;
    null where it isn't an object. ``analyse_pages`` makes a recipe of them."""
    inside = F.regexp_extract(answer, "(\\{[\\s\\S]*\\})", 1)
    values = F.from_json(inside, "map<string,string>")
    return F.transform_values(values, lambda k, v: F.coalesce(F.when(v.startswith("["), F.from_json(v, "array<string>")), F.array(v)))
