"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, join_by_key

#: Rows of a join's smaller side that are broadcast at most (16 bytes each); the edges are counted first.
MOST_BROADCAST = 1_000_000
#: Files of a round's edges while they are that few.
FILES = 8


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that keep them from being stars: those with two smaller
    neighbours, or with a smaller and a larger one. Ends are combined before the shuffle."""
    larger = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("ups"))
    smaller = edges.groupBy(F.col("v").alias("node")).agg(F.lit(0).cast("long").alias("ups"), F.count("*").alias("n"))
    nodes = larger.withColumn("n", F.col("ups")).unionByName(smaller).groupBy("node").agg(F.sum("ups").alias("ups"), F.sum("n").alias("n"))
    r = nodes.agg(F.sum("ups").alias("n"), F.count_if(F.expr("ups > 1 OR (ups = 1 AND n > 1)")).alias("open")).first()
    return r["n"] or 0, r["open"]


def components(edges: DataFrame, few_edges: int = MOST_BROADCAST) -> DataFrame:
    """(node, component) of every node in ``edges`` (u, v): component is the smallest node reachable.

    Each round first links every node's larger neighbours to its smallest one, then the node and its
    smaller neighbours to the smallest of them. It ends, after as many rounds as that takes, when the
    edges are stars: every edge leads to a node that no other edge leads on from. Minima are combined
    before they are shuffled, and joined by broadcast while the counted edges are at most ``few_edges``;
    beyond that the edges of heavy nodes are. Each round's edges are a written table, older ones are
    deleted. Loops and repeated edges have no effect; no edges, no rows.
    """
    scratch = Scratch(edges.sparkSession)
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.cut(e, "edges")
    total, unfinished = _state(e)
    while unfinished:
        few = total <= few_edges
        in_files = (lambda df: df.coalesce(FILES)) if few else (lambda df: df)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        if not few:
            least = scratch.cut(least, "least")
        # an edge's larger end is linked to the least neighbour of its smaller end
        up = e.select(F.col("v").alias("u"), F.col("u").alias("w"))
        large = join_by_key(up, least.select("u", "m"), ["u"], least.select("u", "n"), few, "inner").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.cut(in_files(large), "edges")
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        if not few:
            down = scratch.cut(down, "down")
        small = join_by_key(large, down.select("u", "m"), ["u"], down.select("u", "n"), few, "inner")
        links = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = scratch.cut(in_files(small.select(F.explode(links).alias("x")).select("x.u", "x.v").where("u <> v").distinct()), "edges")
        scratch.clear(keep=1)
        total, unfinished = _state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
