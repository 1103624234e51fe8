"""Recipes from sample strings: paths, selections and counts by joins over the elements of pages.

Each function takes the table of ``nodes.page_nodes`` and the names of the columns that tell a page. Paths are
rows of tables, so every page may have its own; nothing is gathered beyond one page's paths and texts.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.html import INLINE, VOID
from ..storage import dealt, temporary, written
from .nodes import contained

_SEGMENT = r"^\s*[\w*-]*(?:\.[^.:>\s]+)*(?::(?:eq\(\d+\)|not\(\[class\]\)))*\s*$"
_NUMBER = r":eq\(\d+\)"
#: Joins by page and element use that both sides are dealt by page; no side is sent to all.
_WHERE_THEY_LIE = {"spark__sql__requireAllClusterKeysForCoPartition": "false", "spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1"}


def with_ancestors(nodes: DataFrame, hits: DataFrame, *page: str) -> DataFrame:
    """Each element of ``hits`` with ``at``: its own number, and in further rows those of all elements around it."""
    own = dealt(hits.select(*page, "node_id").distinct(), "elements", *page)
    # what ends before a page's first hit or begins after its last one is around none
    ends = own.groupBy(*page).agg(F.min("node_id").alias("__first"), F.max("node_id").alias("__last"))
    around = nodes.select(*page, F.col("node_id").alias("__from"), F.col("last_id").alias("__to"))
    around = around.join(ends, list(page)).where("__from < __last AND __to >= __first AND __from < __to").drop("__first", "__last")
    up = contained(own, around, *page).select(*page, "node_id", F.col("__from").alias("at"))
    return up.unionByName(own.withColumn("at", F.col("node_id")))


def segments(nodes: DataFrame, *page: str) -> DataFrame:
    """``node_id``, ``depth`` and ``segment``: tag, classes and, where several siblings match those, its number.

    Siblings of one tag are counted by their sets of classes. A set meets only those sets that hold the one of its
    classes which the fewest have, so a list whose entries all have a class of their own takes linear time."""
    kind = F.array_sort(F.array_distinct("classes"))
    parent = [*page, "parent_id", "tag"]
    kinds = dealt(nodes.groupBy(*parent, kind.alias("kind")).agg(F.count("*").alias("n")), "kinds", *page)
    classes = kinds.withColumn("class", F.explode("kind"))
    rare = classes.groupBy(*parent, "class").agg(F.count("*").alias("of"))
    first = classes.join(rare, [*parent, "class"]).groupBy(*parent, "kind").agg(F.min_by("class", F.struct("of", "class")).alias("class"))
    others = classes.select(*parent, "class", F.col("kind").alias("other"), "n")
    alike = first.join(others, [*parent, "class"]).where(F.size(F.array_except("kind", "other")) == 0).groupBy(*parent, "kind").agg(F.sum("n").alias("alike"))
    bare = kinds.groupBy(*parent).agg(F.sum("n").alias("alike")).withColumn("kind", F.array().cast("array<string>"))
    found = nodes.withColumn("kind", kind).join(alike.unionByName(bare), [*parent, "kind"])
    number = F.when(F.col("alike") > 1, F.concat(F.lit(":eq("), "sib_index", F.lit(")"))).otherwise("")
    dotted = F.array_join(F.transform("classes", lambda c: F.concat(F.lit("."), c)), "")
    return found.select(*page, "node_id", "depth", F.concat("tag", dotted, number).alias("segment"))


def paths_of(nodes: DataFrame, hits: DataFrame, *page: str) -> DataFrame:
    """``node_id``, ``top_id`` and ``path`` of the elements of ``hits``: from the page (``top_id`` -1) or from the element
    ``top_id`` around them, which is not part of it. An element's path from itself is empty."""
    own = dealt(hits.select(*page, "node_id", "top_id").distinct(), "elements", *page)
    steps = dealt(with_ancestors(nodes, own, *page).join(own, [*page, "node_id"]).where("at > top_id"), "ancestors", *page)
    asked = steps.select(*page, F.col("at").alias("node_id")).distinct()
    parents = nodes.select(*page, "node_id", "parent_id").join(asked, [*page, "node_id"], "left_semi").select(*page, "parent_id").distinct()
    siblings = nodes.select(*page, "node_id", "parent_id", "depth", "tag", "classes", "sib_index").join(parents, [*page, "parent_id"], "left_semi")
    siblings = dealt(siblings, "siblings", *page)
    named = segments(siblings, *page).join(asked, [*page, "node_id"], "left_semi")
    steps = steps.join(named.withColumnRenamed("node_id", "at"), [*page, "at"])
    parts = F.array_sort(F.collect_list(F.struct("depth", "segment")))
    found = steps.groupBy(*page, "node_id", "top_id").agg(F.array_join(F.transform(parts, lambda p: p["segment"]), ">").alias("path"))
    return own.join(found, [*page, "node_id", "top_id"], "left").withColumn("path", F.coalesce("path", F.lit("")))


def _wanted(path: Column) -> Column:
    """What each segment of a path asks for; what is no segment asks for a tag that no element has."""
    eq = lambda s: F.nullif(F.regexp_extract(s, r":eq\((\d+)\)", 1), F.lit(""))
    tag = lambda s: F.when(s.rlike(_SEGMENT), F.lower(F.regexp_extract(s, r"^\s*([\w*-]*)", 1))).otherwise("?")
    classes = lambda s: F.array_remove(F.split(F.regexp_extract(s, r"^\s*[\w*-]*((?:\.[^.:>\s]+)*)", 1), r"\."), "")
    one = lambda s: F.struct(tag(s).alias("tag"), classes(s).alias("classes"), s.contains(":not([class])").alias("bare"), eq(s).cast("int").alias("number"))
    return F.when(path == "", F.array().cast("array<struct<tag:string,classes:array<string>,bare:boolean,number:int>>")).otherwise(F.transform(F.split(path, ">"), one))


def _anywhere(path: Column) -> Column:
    """Whether a path's segments may be any number of levels apart: all end with ``)``."""
    return F.forall(F.split(path, ">"), lambda s: F.trim(s).endswith(")"))


def _fits(want: Column) -> Column:
    tag = (want["tag"] == "") | (want["tag"] == "*") | (want["tag"] == F.col("tag"))
    return tag & (F.size(F.array_except(want["classes"], F.col("classes"))) == 0) & ~(want["bare"] & (F.size("classes") > 0))


def _candidates(nodes: DataFrame, paths: DataFrame, part: Column, *page: str) -> DataFrame:
    """The elements that fit one of the segments (``part``: of each row of ``paths``) that are asked for in their page; all
    of a page in which a path is empty. Joins that follow move those alone."""
    anything = F.expr("array(named_struct('tag', '', 'classes', cast(array() AS array<string>), 'bare', false, 'number', cast(null AS int)))")
    asked = paths.select(*page, F.explode(F.when(F.size(part) > 0, part).otherwise(anything)).alias("w"))
    asked = asked.select(*page, F.struct("w.tag", "w.classes", "w.bare").alias("w")).groupBy(*page).agg(F.collect_set("w").alias("__wants"))
    return nodes.join(asked, list(page)).where(F.exists("__wants", _fits)).drop("__wants")


def _perhaps_asked(nodes: DataFrame, paths: DataFrame, *page: str) -> DataFrame:
    """The elements that may fit a segment of one of a page's paths (``path``), whichever of its classes are taken away
    as long as one is left: of the segment's tag, and with one of its classes where it has any."""
    parts = lambda s: F.transform(F.split(F.regexp_replace(s, r":eq\(\d+\)|:not\(\[class\]\)", ""), r"\."), lambda x: F.trim(x))
    one = lambda s: F.struct(F.lower(parts(s)[0]).alias("tag"), F.slice(parts(s), 2, 10000).alias("classes"))
    asked = paths.select(*page, F.explode(F.split("path", ">")).alias("s")).groupBy(*page).agg(F.collect_set(one(F.col("s"))).alias("__wants"))
    fits = lambda w: ((w["tag"] == "") | (w["tag"] == "*") | (w["tag"] == F.col("tag"))) & ((F.size(w["classes"]) == 0) | F.arrays_overlap(w["classes"], F.col("classes")))
    return nodes.join(asked, list(page)).where(F.exists("__wants", fits)).drop("__wants")


def _nth(hits: DataFrame, want: Column, keep: Column, *keys: str) -> DataFrame:
    """Of the hits of each key the one that the segment's number asks for, all where it has none."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("node_id")) - 1
    return hits.withColumn("__n", place).where(keep | want["number"].isNull() | (F.col("__n") == want["number"])).drop("__n")


def _slim(nodes: DataFrame, *page: str) -> DataFrame:
    return nodes.select(*page, "node_id", "parent_id", "last_id", "tag", "classes")


def _walk(nodes: DataFrame, todo: DataFrame, *page: str) -> DataFrame:
    """What the paths of ``todo`` (page, start_id, path_id, node_id, last_id, ``__segs``, ``__any``) reach from its elements:
    start_id, path_id, node_id. Rows at the end of their path meet themselves, so one chain of joins, as long as the
    longest path, serves paths of any length."""
    todo = dealt(todo, "paths-to-walk", *page)
    own = [*page, "start_id", "path_id"]
    longest = todo.groupBy("__any").agg(F.max(F.size("__segs")).alias("n"), F.collect_set(F.size("__segs")).alias("sizes")).collect()
    longest = {r["__any"]: r for r in longest}
    slim = _slim(nodes, *page)
    out = [todo.where("NOT __any")]
    if False in longest:
        key = lambda kind, c: F.struct(kind.alias("kind"), F.col(c).alias("id"))
        keyed = slim.withColumn("__key", F.explode(F.array(key(F.lit(0), "parent_id"), key(F.lit(1), "node_id"))))
        keyed = keyed.select(*page, "__key", "node_id", "tag", "classes")
        at = out[0].select(*own, "__segs", "node_id")
        for k in range(longest[False]["n"]):
            ends, want = F.col("__key.kind") == 1, F.get("__segs", F.lit(k))
            step = at.withColumn("__key", key(F.when(F.size("__segs") > k, 0).otherwise(1), "node_id")).drop("node_id").join(keyed, [*page, "__key"])
            at = _nth(step.where(ends | _fits(want)), want, ends, *own, "__key").select(*own, "__segs", "node_id")
        out = [at.select(*own, "node_id")]
    else:
        out = [out[0].select(*own, "node_id")]
    for size in longest[True]["sizes"] if True in longest else []:
        at = todo.where(F.col("__any") & (F.size("__segs") == size)).select(*own, "__segs", "node_id", "last_id")
        for k in range(size):
            want = F.get("__segs", F.lit(k))
            around = at.select(*own, "__segs", F.col("node_id").alias("__from"), F.col("last_id").alias("__to"))
            step = contained(slim, around, *page).where(_fits(want))
            at = _nth(step, want, F.lit(False), *own, "__from").select(*own, "__segs", "node_id", "last_id").dropDuplicates([*own, "node_id"])
        out.append(at.select(*own, "node_id"))
    return functools.reduce(DataFrame.unionByName, out)


def reach(nodes: DataFrame, starts: DataFrame, paths: DataFrame, *page: str) -> DataFrame:
    """The elements that each path (``path_id``, ``path``) of a page reaches from each of its ``starts`` (``start_id``,
    ``last_id``): start_id, path_id, node_id. The first segment is a child of the start, or, where all segments end with
    ``)``, anywhere inside it; a number counts among the hits of one element. The empty path is the start itself."""
    paths = dealt(paths.select(*page, "path_id", "path"), "paths", *page)
    todo = starts.join(paths, list(page)).withColumn("node_id", F.col("start_id"))
    whole = F.col("path") == ""
    found = dealt(_candidates(_slim(nodes, *page), paths, _wanted(F.col("path")), *page), "candidates", *page)
    return _walk(found, todo.select(*page, "start_id", "path_id", "node_id", "last_id", _wanted(F.col("path")).alias("__segs"), (~whole & _anywhere(F.col("path"))).alias("__any")), *page)


def descend(nodes: DataFrame, paths: DataFrame, *page: str) -> DataFrame:
    """The elements that each path of a page reaches when its first segment may be anywhere: path_id, node_id. The
    first number counts in the page."""
    segs = _wanted(F.col("path"))
    want = F.get("__segs", F.lit(0))
    asked = dealt(paths.where("path != ''").select(*page, "path_id", segs.alias("__segs"), _anywhere(F.col("path")).alias("__any")), "paths", *page)
    slim = dealt(_candidates(_slim(nodes, *page), asked, F.col("__segs"), *page), "candidates", *page)
    first = _nth(slim.drop("parent_id").join(asked, list(page)).where(_fits(want)), want, F.lit(False), *page, "path_id")
    rest = F.slice("__segs", 2, F.greatest(F.size("__segs") - 1, F.lit(0)))
    todo = first.select(*page, F.col("node_id").alias("start_id"), "path_id", "node_id", "last_id", rest.alias("__segs"), (F.col("__any") & (F.size("__segs") > 1)).alias("__any"))
    return _walk(slim, todo, *page).select(*page, "path_id", "node_id").distinct()


def smallest_holding(nodes: DataFrame, samples: DataFrame, *page: str) -> DataFrame:
    """For each row of ``samples`` (page, keys, ``strings``, ``from_id``, ``to_id``) ``node_id``: the last deepest of the elements
    after from_id up to to_id whose text holds all strings, capitals or not. Rows without one are left out."""
    keys = [c for c in samples.columns if c not in (*page, "strings")]
    low = nodes.select(*page, "node_id", "depth", F.lower("text").alias("__low"))
    holds = F.forall("strings", lambda s: F.contains(F.col("__low"), F.lower(s)))
    found = samples.join(low, list(page)).where("node_id > from_id AND node_id <= to_id").where(holds)
    return found.groupBy(*page, *keys).agg(F.max_by("node_id", F.struct("depth", "node_id")).alias("node_id"))


def chain_ends(nodes: DataFrame, samples: DataFrame, *page: str) -> DataFrame:
    """For each row of ``samples`` (page, keys, ``string``, ``from_id``, ``to_id``) ``node_id``: from the first element after
    from_id that holds the string down to the last one of the chain in which each holds the next."""
    keys = [c for c in samples.columns if c not in page]
    found = samples.join(nodes.select(*page, "node_id", "parent_id", "text"), list(page)).where("node_id > from_id AND node_id <= to_id AND contains(text, string)")
    order = Window.partitionBy(*page, *keys).orderBy("node_id")
    breaks = F.coalesce((F.col("parent_id") != F.lag("node_id").over(order)).cast("int"), F.lit(0))
    running = F.sum("__break").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("__break", breaks).withColumn("__breaks", running).where("__breaks = 0").groupBy(*page, *keys).agg(F.max("node_id").alias("node_id"))


def with_link(nodes: DataFrame, hits: DataFrame, *page: str) -> DataFrame:
    """``hits`` with ``linked_id``: the element, or its nearest ancestor with an address; itself where none has one."""
    linked = nodes.where(F.coalesce("href", F.lit("")) != "")
    around = with_ancestors(linked, hits, *page).join(linked.select(*page, F.col("node_id").alias("at")), [*page, "at"])
    up = around.groupBy(*page, "node_id").agg(F.max("at").alias("linked_id"))
    return hits.join(up, [*page, "node_id"], "left").withColumn("linked_id", F.coalesce("linked_id", "node_id"))


def common_ancestors(nodes: DataFrame, hits: DataFrame, group: list[str], *page: str) -> DataFrame:
    """For each group of ``hits`` ``top_id``: the deepest element that holds all of them, or is one of them. A group
    without one is left out. Only a group's first element and its last number are looked at."""
    ends = hits.groupBy(*page, *group).agg(F.min("node_id").alias("node_id"), F.max("node_id").alias("__last"))
    around = with_ancestors(nodes, ends, *page).join(nodes.select(*page, F.col("node_id").alias("at"), "last_id"), [*page, "at"])
    return ends.join(around, [*page, "node_id"]).where("last_id >= __last").groupBy(*page, *group).agg(F.max("at").alias("top_id"))


def leaf_elements(nodes: DataFrame, *page: str) -> DataFrame:
    """The lowest elements with text (all columns of ``nodes``): one for text that only inline elements divide, and those that
    have text of their own beside other elements. Text outside of all elements is no row of the table.

    What lies inside an element that only inline ones divide is such an element too, so its parent tells whether
    it is the outermost; how many other elements lie inside one is a difference of running numbers."""
    other = (~F.col("tag").isin(*sorted(INLINE | VOID))).cast("int")
    so_far = Window.partitionBy(*page).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = nodes.select(*page, "node_id", "last_id", "parent_id", "text", F.sum(other).over(so_far).alias("__seen"))
    ends = seen.select(*page, F.col("node_id").alias("last_id"), F.col("__seen").alias("__end"))
    inside = seen.join(ends, [*page, "last_id"]).withColumn("__line", (F.col("text") != "") & (F.col("__end") == F.col("__seen")))
    # texts are joined by one blank: longer than its children's together, an element has text of its own
    parts = nodes.where("text != ''").groupBy(*page, F.col("parent_id").alias("node_id")).agg(F.sum(F.length("text") + 1).alias("__parts"))
    above = inside.select(*page, F.col("node_id").alias("parent_id"), F.col("__line").alias("__covered"))
    found = inside.join(parts, [*page, "node_id"], "left").join(above, [*page, "parent_id"], "left")
    own = F.length("text") + 1 > F.coalesce("__parts", F.lit(0))
    chosen = found.where("text != ''").where(F.when(F.col("__line"), ~F.coalesce("__covered", F.lit(False))).otherwise(own))
    return nodes.join(chosen.select(*page, "node_id"), [*page, "node_id"], "left_semi")


def regrouped(paths: DataFrame, *keys: str) -> DataFrame:
    """``paths`` (keys, ``path_no``, ``path``) in which those of a key that differ in one number only have become one without
    it; ``path_no`` is numbered anew, first what stays. What has become one with others doesn't come back as what further
    paths have become."""
    first = paths.groupBy(*keys, "path").agg(F.min("path_no").alias("path_no"))
    each = first.withColumn("__s", F.split("path", ">")).select("*", F.posexplode("__s").alias("__k", "__own"))
    masked = F.transform("__s", lambda s, i: F.when(i == F.col("__k"), F.regexp_replace(s, _NUMBER, "")).otherwise(s))
    groups = Window.partitionBy(*keys, "__k", "__masked")
    each = each.withColumn("__masked", F.array_join(masked, ">")).withColumn("__many", F.count("*").over(groups) > 1)
    merged = each.where("__many").groupBy(*keys, "__k", "__masked").agg(F.array_sort(F.collect_list("path_no")).alias("__at"))
    merged = merged.groupBy(*keys, F.col("__masked").alias("path")).agg(F.min("__at").alias("__at"))
    merged = merged.join(each.where("__many").select(*keys, "path").distinct(), [*keys, "path"], "left_anti")
    kept = each.groupBy(*keys, "path").agg(F.max("__many").alias("__many"), F.min("path_no").alias("__no")).where("NOT __many")
    both = kept.select(*keys, "path", F.lit(0).alias("__rank"), F.array("__no").alias("__at")).unionByName(merged.select(*keys, "path", F.lit(1).alias("__rank"), "__at"))
    both = both.groupBy(*keys, "path").agg(F.min(F.struct("__rank", "__at")).alias("__o"))
    return both.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("__o", "path")) - 1).alias("path_no"), "path")


def fields(nodes: DataFrame, blocks: DataFrame, recipe: DataFrame, *page: str) -> DataFrame:
    """The texts that a page's recipe (``key``, ``path_no``, ``path``) reads in each of its ``blocks`` (``start_id``, ``last_id``): start_id,
    key, text; path after path, names joined by commas, others by blanks. Keys that find no text have no row."""
    asked = dealt(recipe.select(*page, F.struct("key", "path_no").alias("path_id"), "path"), "paths", *page)
    shown = _candidates(nodes.select(*page, "node_id", "tag", "classes", "text"), asked, F.slice(_wanted(F.col("path")), -1, 1), *page)
    hits = reach(nodes, blocks, asked, *page).join(shown.select(*page, "node_id", "text"), [*page, "node_id"]).where("text != ''")
    texts = F.array_sort(F.collect_list(F.struct("path_id.path_no", "node_id", "text")))
    found = hits.groupBy(*page, "start_id", F.col("path_id.key").alias("key")).agg(F.transform(texts, lambda t: t["text"]).alias("__t"))
    return found.select(*page, "start_id", "key", F.when(F.contains("key", F.lit("Name")), F.array_join("__t", ", ")).otherwise(F.array_join("__t", " ")).alias("text"))


def read_events(nodes: DataFrame, delimiters: DataFrame, recipe: DataFrame, *page: str) -> DataFrame:
    """For each block (``node_id``) of each delimiter (``path_id``, ``path``) of a page ``event``: the key and text of its name and
    its date, as far as there are any, and ``valid``, whether it has as many of them as the recipe."""
    recipe = recipe.where(F.col("key").isin("eventName", "eventDate"))
    blocks = dealt(descend(nodes, delimiters, *page), "blocks", *page)
    starts = blocks.select(*page, F.col("node_id").alias("start_id")).distinct()
    starts = starts.join(nodes.select(*page, F.col("node_id").alias("start_id"), "last_id"), [*page, "start_id"])
    read = fields(nodes, starts, recipe, *page).groupBy(*page, F.col("start_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("key", "text"))).alias("event"))
    needed = recipe.groupBy(*page).agg(F.countDistinct("key").alias("__keys"))
    found = blocks.join(read, [*page, "node_id"], "left").join(needed, list(page), "left")
    event = F.coalesce("event", F.array().cast(read.schema["event"].dataType))
    return found.select(*page, "path_id", "node_id", event.alias("event"), (F.size(event) == F.coalesce("__keys", F.lit(0))).alias("valid"))


def count_events(nodes: DataFrame, delimiters: DataFrame, recipe: DataFrame, *page: str) -> DataFrame:
    """For each delimiter (``path_id``, ``path``) of a page ``events``: how many different valid events its blocks hold, that
    is pairs of a name and a date, as far as the recipe has them."""
    counted = read_events(nodes, delimiters, recipe, *page).groupBy(*page, "path_id").agg(F.countDistinct(F.when(F.col("valid"), F.col("event"))).alias("events"))
    return delimiters.select(*page, "path_id").join(counted, [*page, "path_id"], "left").withColumn("events", F.coalesce("events", F.lit(0)))


def loosened(nodes: DataFrame, delimiters: DataFrame, recipe: DataFrame, *page: str) -> DataFrame:
    """``delimiter`` of each page without the classes that hide events, and ``events``, how many it finds. In each round the
    first segment goes on in which taking away a class finds more, without the class that finds most; rounds end
    when no page finds more, and only pages that did take part in the next one."""
    asked = delimiters.select(*page, F.lit("0").alias("path_id"), F.col("delimiter").alias("path"))
    state = asked.join(count_events(nodes, asked, recipe, *page), [*page, "path_id"]).select(*page, F.col("path").alias("delimiter"), "events")
    open_, done = dealt(state, "delimiters", *page), []
    while not open_.isEmpty():
        each = open_.select("*", F.posexplode(F.split("delimiter", ">")).alias("k", "segment")).withColumn("parts", F.split("segment", r"\."))
        each = each.where("size(parts) > 2").withColumn("j", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)))
        fewer = F.array_join(F.filter("parts", lambda _, i: i != F.col("j")), ".")
        path = F.array_join(F.transform(F.split("delimiter", ">"), lambda s, i: F.when(i == F.col("k"), fewer).otherwise(s)), ">")
        tries = dealt(each.select(*page, F.struct("k", "j").alias("path_id"), path.alias("path"), F.col("events").alias("before")), "tries", *page)
        if tries.isEmpty():
            break
        found = tries.join(count_events(nodes, tries, recipe, *page), [*page, "path_id"]).where("events > before")
        best = found.groupBy(*page).agg(F.min(F.struct(F.col("path_id.k").alias("k"), (-F.col("events")).alias("less"), F.col("path_id.j").alias("j"), "path")).alias("b"))
        better = dealt(best.select(*page, F.col("b.path").alias("delimiter"), (-F.col("b.less")).alias("events")), "delimiters", *page)
        done.append(open_.join(better.select(*page), list(page), "left_anti"))
        open_ = better
    return functools.reduce(DataFrame.unionByName, [*done, open_])


def shortened(nodes: DataFrame, delimiters: DataFrame, *page: str) -> DataFrame:
    """``delimiter`` of each page and ``short``: its shortest end that reaches the same texts and has a class that the rest
    lacks, or the whole path."""
    classes = lambda s: F.array_distinct(F.flatten(F.transform(s, lambda x: F.slice(F.split(F.split(x, ":")[0], r"\."), 2, 10000))))
    whole = delimiters.withColumn("__s", F.split("delimiter", ">"))
    ends = whole.where("size(__s) > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("__s") - 1)))
    top, end = F.slice("__s", 1, F.col("k")), F.slice("__s", F.col("k") + 1, F.size("__s") - F.col("k"))
    ends = ends.where(F.size(F.array_except(classes(end), classes(top))) > 0).select(*page, F.col("k").alias("path_id"), F.array_join(end, ">").alias("path"))
    root = delimiters.select(*page, F.lit(-1).alias("start_id"), F.lit(2**31 - 1).alias("last_id"))
    own = reach(nodes, root, delimiters.select(*page, F.lit(0).alias("path_id"), F.col("delimiter").alias("path")), *page).select(*page, "path_id", "node_id")
    last = delimiters.where("delimiter != ''").select(*page, F.slice(_wanted(F.col("delimiter")), -1, 1).alias("__last"))
    shown = _candidates(nodes.select(*page, "node_id", "tag", "classes", "text"), last, F.col("__last"), *page).select(*page, "node_id", "text")
    hits = own.unionByName(descend(nodes, ends, *page)).join(shown, [*page, "node_id"])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda t: t["text"]), " ")
    read = dealt(hits.groupBy(*page, "path_id").agg(texts.alias("text")), "reached-texts", *page)
    same = read.where("path_id > 0").join(read.where("path_id = 0").select(*page, F.col("text").alias("__own")), list(page)).where("text = __own")
    same = same.join(ends, [*page, "path_id"]).groupBy(*page).agg(F.max_by("path", "path_id").alias("short"))
    return delimiters.join(same, list(page), "left").withColumn("short", F.coalesce("short", "delimiter"))


def induce(nodes: DataFrame, samples: DataFrame, *page: str, links: bool = True) -> DataFrame:
    """A recipe for each page from sample strings of one of its events (``key``, ``strings``): ``delimiter``, ``main_page`` (map of key
    to paths), ``events`` (how many different ones it finds) and ``dates`` (their texts, in the page's order).

    The block is the smallest element with all strings, or, where neither it nor anything inside it has an address, its nearest
    ancestor that has one (``links`` False: never). Without numbers, and without classes that hide events, its path is the
    delimiter, shortened where that finds as many. A string's element is the end of its chain, else the smallest that holds it,
    else the block. Null and empty strings are passed over; a page without a block has no row. Paths of ``Multi`` keys have
    no numbers; ``dates`` are those of blocks, not of sub-events. ``nodes`` is read often: pass a table that is ``dealt`` by page.

    All tables between are dealt by page, so joins move no rows, and none is broadcast: small as files, tables of paths
    that are alike in many pages are large in memory. Only the result stays."""
    with temporary(nodes.sparkSession, **_WHERE_THEY_LIE):
        return written(_induced(nodes, samples, *page, links=links), "induced-recipes", keep=True)


def _induced(nodes: DataFrame, samples: DataFrame, *page: str, links: bool) -> DataFrame:
    given = dealt(samples.select(*page, "key", F.filter("strings", lambda s: F.coalesce(s != "", F.lit(False))).alias("strings")), "samples", *page)
    every = given.groupBy(*page).agg(F.flatten(F.collect_list("strings")).alias("strings")).where("size(strings) > 0")
    block = smallest_holding(nodes, every.select("*", F.lit(-1).alias("from_id"), F.lit(2**31 - 1).alias("to_id")), *page).select(*page, "node_id")
    block = dealt(block.join(nodes.select(*page, "node_id", "last_id"), [*page, "node_id"]), "sample-blocks", *page)
    if links:
        inside = nodes.where(F.coalesce("href", F.lit("")) != "").select(*page, F.col("node_id").alias("__href"))
        has = block.join(inside, list(page)).where("__href >= node_id AND __href <= last_id").select(*page).distinct().withColumn("__has", F.lit(True))
        up = with_link(nodes, block.select(*page, "node_id"), *page).join(has, list(page), "left")
        up = up.select(*page, F.when(F.col("__has"), F.col("node_id")).otherwise(F.col("linked_id")).alias("node_id"))
        block = dealt(up.join(nodes.select(*page, "node_id", "last_id"), [*page, "node_id"]), "sample-blocks", *page)
    around = block.select(*page, F.col("node_id").alias("from_id"), F.col("last_id").alias("to_id"))
    one = dealt(given.select(*page, "key", F.posexplode("strings").alias("path_no", "string")).join(around, list(page)), "sample-strings", *page)
    ids = [*page, "key", "path_no"]
    inside = nodes.select(*page, "node_id", "parent_id", "depth", "text").join(around, list(page)).where("node_id > from_id AND node_id <= to_id")
    inside = dealt(inside.drop("from_id", "to_id"), "elements-in-blocks", *page)
    ends = chain_ends(inside, one, *page).select(*ids, F.col("node_id").alias("__end"))
    small = smallest_holding(inside, one.select(*ids, F.array("string").alias("strings"), "from_id", "to_id"), *page).select(*ids, F.col("node_id").alias("__small"))
    hits = one.join(ends, ids, "left").join(small, ids, "left")
    hits = dealt(hits.select(*ids, F.coalesce("__end", "__small", "from_id").alias("node_id"), F.col("from_id").alias("top_id")), "sample-elements", *page)
    # the block's own path is from the page
    whole = block.select(*page, "node_id", F.lit(-1).alias("top_id"))
    found = dealt(paths_of(nodes, hits.select(*page, "node_id", "top_id").unionByName(whole), *page), "paths-of-samples", *page)
    paths = hits.join(found, [*page, "node_id", "top_id"])
    grouped = regrouped(dealt(paths.select(*ids, "path"), "sample-paths", *page), *page, "key")
    plain = F.when(F.contains("key", F.lit("Multi")), F.regexp_replace("path", _NUMBER, "")).otherwise(F.col("path"))
    recipe = dealt(grouped.withColumn("path", plain).groupBy(*page, "key", "path").agg(F.min("path_no").alias("path_no")), "recipes", *page)
    top = dealt(found.where("top_id = -1").select(*page, F.regexp_replace("path", _NUMBER, "").alias("delimiter")), "block-paths", *page)
    # from here on paths are followed: classes of the delimiter's may go, tags stay
    asked = top.select(*page, F.col("delimiter").alias("path")).unionByName(recipe.select(*page, "path"))
    few = dealt(_perhaps_asked(nodes.select(*page, "node_id", "parent_id", "last_id", "tag", "classes", "text"), asked, *page), "elements-asked", *page)
    loose = dealt(loosened(few, top, recipe, *page), "delimiters", *page)
    short = dealt(shortened(few, loose.select(*page, "delimiter"), *page), "short-delimiters", *page)
    both = dealt(short.select(*page, F.posexplode(F.array("delimiter", "short")).alias("path_id", "path")), "delimiters", *page)
    text = F.filter("event", lambda e: e["key"] == "eventDate")
    dates = F.array_sort(F.collect_list(F.when(F.size(text) > 0, F.struct("node_id", text[0]["text"].alias("text")))))
    read = read_events(few, both, recipe, *page).groupBy(*page, "path_id")
    read = read.agg(F.count_distinct(F.when(F.col("valid"), F.col("event"))).alias("__found"), F.transform(dates, lambda d: d["text"]).alias("dates"))
    # the short path where it finds as many, else the long one
    either = both.join(read, [*page, "path_id"], "left").join(loose.select(*page, "events"), list(page))
    either = either.where((F.col("path_id") == 0) | (F.coalesce("__found", F.lit(0)) == F.col("events")))
    chosen = either.groupBy(*page, "events").agg(F.max_by(F.struct("path", "dates"), "path_id").alias("c")).select(*page, F.col("c.path").alias("delimiter"), "events", "c.dates")
    keyed = recipe.groupBy(*page, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("path_no", "path"))), lambda p: p["path"]).alias("paths"))
    main = keyed.groupBy(*page).agg(F.map_from_entries(F.collect_list(F.struct("key", "paths"))).alias("main_page"))
    out = chosen.join(main, list(page), "left")
    return out.withColumn("dates", F.coalesce("dates", F.array().cast("array<string>")))
