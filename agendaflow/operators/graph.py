"""Groups of linked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def linked_sets(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the smallest node that links lead to.

    Every node points to the smallest node it knows. A round asks each node's neighbours for theirs and then
    follows pointers once more, so paths halve; it ends when no pointer moves. Both are aggregations and
    joins by key, the pointers are a written table after each round.
    """
    both = written(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    points = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "pointers")
    while True:
        of = points.select(F.col("node").alias("b"), F.col("root").alias("near"))
        heard = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        told = points.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # what a node's old root has heard of holds for the node too
        hook = told.where("root < was").groupBy(F.col("was").alias("at")).agg(F.min("root").alias("to"))
        step = told.join(hook, told["was"] == hook["at"], "left").select("node", "was", F.least("root", "to").alias("root"))
        step = written(step, "pointers")
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        points = written(step.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("was")).alias("moved")), "pointers")
        if not points.where("moved").limit(1).count():
            return points.select("node", "root")
        points = points.select("node", "root")
