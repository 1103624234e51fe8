"""Pages as tables of elements: parsed once, then selected, nested and read by joins."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.html import HtmlNodes


def page_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each element of each page: the page's other columns and those of ``html_nodes``. Write it
    where several selections follow."""
    rest = [c for c in pages.columns if c != html]
    nodes = pages.lateralJoin(HtmlNodes(F.col(html).outer()))
    return nodes.select(*rest, "node_id", "parent_id", "last_id", "depth", "tag", "classes", "href", "sib_index", "text")


def _segment(text: str) -> tuple[Column, int | None]:
    """Whether an element is one of a path's segment, and its number where one is asked."""
    m = re.match(r"^([\w*-]*)((?:\.[^.:>\s]+)*)((?::(?:eq\(\d+\)|not\(\[class\]\)))*)$", text.strip())
    if not m:
        return F.lit(False), None
    own = F.lit(True) if m[1] in ("", "*") else F.col("tag") == m[1].lower()
    for c in m[2].split(".")[1:]:
        own = own & F.array_contains("classes", c)
    if ":not([class])" in m[3]:
        own = own & (F.size("classes") == 0)
    at = re.search(r":eq\((\d+)\)", m[3])
    return own, int(at[1]) if at else None


def contained(nodes: DataFrame, blocks: DataFrame, *page: str) -> DataFrame:
    """Each node with each block of its page that it lies inside: the columns of both. ``blocks`` has the page,
    ``__from`` and ``__to``, the number of its element and that of the last one inside.

    Elements nest, so one pass over a page in order tells how many blocks are open at each node, and within one
    depth of nesting the block is the one that opened last. Both are windows over the page's sorted elements: a
    page of n elements takes time in proportion to n and to the pairs, never to nodes times blocks.
    """
    own = [c for c in nodes.columns if c not in page]
    other = [c for c in blocks.columns if c not in page]
    item, block = F.struct(*own), F.struct(*other)
    no_item, no_block = (F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType) for df, c in ((nodes, item), (blocks, block)))
    row = lambda df, pos, kind, x, y: df.select(*page, F.col(pos).alias("__pos"), F.lit(kind).alias("__kind"), x.alias("__item"), y.alias("__block"))
    # a node comes before the block that it opens and before the end of those that it ends
    events = row(nodes, "node_id", 0, item, no_block).unionByName(row(blocks, "__from", 1, no_item, block)).unionByName(row(blocks, "__to", 2, no_item, no_block))
    so_far = Window.partitionBy(*page).orderBy("__pos", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("__kind") == 1, 1).when(F.col("__kind") == 2, -1).otherwise(0)).over(so_far)
    open_ = events.withColumn("__depth", depth).where("__kind < 2 AND __depth > 0")
    levels = F.when(F.col("__kind") == 1, F.array("__depth")).otherwise(F.sequence(F.lit(1).cast("long"), "__depth"))
    in_level = Window.partitionBy(*page, "__level").orderBy("__pos", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = open_.withColumn("__level", F.explode(levels)).withColumn("__block", F.last("__block", ignorenulls=True).over(in_level)).where("__kind = 0")
    return found.select(*page, *(F.col(f"__item.{c}").alias(c) for c in own), *(F.col(f"__block.{c}").alias(c) for c in other))


def _numbered(hits: DataFrame, number: int | None, keys: list[str]) -> DataFrame:
    if number is None:
        return hits
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("node_id"))).where(F.col("__n") == number + 1).drop("__n")


def _steps(nodes: DataFrame, found: DataFrame, segments: list[str], anywhere: bool, page: list[str]) -> DataFrame:
    """What further segments reach from the elements found, in turn."""
    for s in segments:
        own, number = _segment(s)
        hits = nodes.where(own)
        if anywhere:
            hits = contained(hits, found.select(*page, F.col("node_id").alias("__from"), F.col("last_id").alias("__to")), *page)
            hits = _numbered(hits, number, [*page, "__from"])
        else:
            hits = hits.join(found.select(*page, F.col("node_id").alias("parent_id")), [*page, "parent_id"], "left_semi")
            hits = _numbered(hits, number, [*page, "parent_id"])
        found = hits.select(*nodes.columns).dropDuplicates([*page, "node_id"])
    return found


def _anywhere(path: str) -> bool:
    return all(s.strip().endswith(")") for s in path.split(">"))


def select_path(nodes: DataFrame, path: str, *page: str) -> DataFrame:
    """The elements that a path reaches: its first segment anywhere in the page, each further one a child of
    the one before, or, where all segments end with ``)``, anywhere inside it. A number counts among the
    page's elements, then among those of one element. ``page`` are the columns that name a page."""
    first, *rest = path.split(">")
    own, number = _segment(first)
    return _steps(nodes, _numbered(nodes.where(own), number, list(page)), rest, _anywhere(path), list(page))


def _inside(inside: DataFrame, blocks: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """What a path reaches inside each block; the empty path, the block itself. ``inside`` has the elements of
    each block and its ``__from``, ``blocks`` the elements of the blocks themselves."""
    if not path:
        return blocks
    first, *rest = path.split(">")
    own, number = _segment(first)
    top = inside.where(own) if _anywhere(path) else inside.where(own & (F.col("parent_id") == F.col("__from")))
    return _steps(inside.drop("__from"), _numbered(top, number, keys).drop("__from"), rest, _anywhere(path), keys)


def nearest_links(nodes: DataFrame, hits: DataFrame, *page: str) -> DataFrame:
    """``hits`` with ``link``: the address of the element, or of its nearest ancestor that has one, or of the
    first element inside that has one; null where there is none. ``hits`` may repeat elements."""
    linked = nodes.where(F.coalesce("href", F.lit("")) != "").select(*page, "node_id", F.col("last_id").alias("__to"), F.col("href").alias("__href"))
    own = hits.select(*page, "node_id", "last_id").dropDuplicates([*page, "node_id"])
    up = contained(own, linked.withColumnRenamed("node_id", "__from"), *page).groupBy(*page, "node_id").agg(F.max_by("__href", "__from").alias("__up"))
    down = contained(linked.select(*page, "node_id", "__href"), own.select(*page, F.col("node_id").alias("__from"), F.col("last_id").alias("__to")), *page)
    down = down.groupBy(*page, F.col("__from").alias("node_id")).agg(F.min_by("__href", "node_id").alias("__down"))
    out = hits.join(up, [*page, "node_id"], "left").join(down, [*page, "node_id"], "left")
    return out.withColumn("link", F.coalesce(F.nullif("href", F.lit("")), "__up", "__down")).drop("__up", "__down")


def blocks_and_fields(nodes: DataFrame, delimiter: str, recipe: dict[str, str | list[str]], *page: str) -> DataFrame:
    """For each element of the delimiter (block_no, in the order of the page) the texts of the elements that
    each key's paths reach inside it, one column a key, path after path: names joined by commas, others by
    blanks, null where there is none. A key of ``URL`` has one address: that of the first element of its first
    path that has one itself, on an ancestor, inside or outside of the block, or inside it.

    A recipe is a parameter of one site's job, so each path is one chain of joins. Pass a written table where
    pages are many: it is read once for each path."""
    chosen = select_path(nodes, delimiter, *page).withColumn("block_no", F.row_number().over(Window.partitionBy(*page).orderBy("node_id")) - 1)
    keys = [*page, "block_no"]
    blocks = chosen.select(*keys, F.col("node_id").alias("__from"), F.col("last_id").alias("__to"))
    inside = contained(nodes, blocks, *page).drop("__to")
    out = blocks.select(*keys)
    for key, paths in recipe.items():
        paths = [paths] if isinstance(paths, str) else paths
        if "URL" in key:
            hits = nearest_links(nodes, _inside(inside, chosen, paths[0], keys).select(*keys, "node_id", "last_id", "href"), *page)
            found = hits.where("link IS NOT NULL").groupBy(*keys).agg(F.min_by("link", "node_id").alias(key))
        else:
            hits = [_inside(inside, chosen, p, keys).select(*keys, F.lit(k).alias("path"), "node_id", "text") for k, p in enumerate(paths)]
            hits = functools.reduce(DataFrame.unionByName, hits)
            texts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("path", "node_id", "text"))))
            joined = F.array_join(F.transform(texts, lambda t: t["text"]), ", " if "Name" in key else " ")
            found = hits.groupBy(*keys).agg(F.nullif(joined, F.lit("")).alias(key))
        out = out.join(found, keys, "left")
    return out
