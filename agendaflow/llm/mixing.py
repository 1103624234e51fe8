"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, cut, free_names

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Blocks of each source: a parameter, so a source has as many however large it is.
BLOCKS = 1024
SHARDS = 64
#: Bytes of mixed text that one task sorts and writes; a shard is dealt to as many tasks as that takes.
TASK_BYTES = 128 << 20
#: Sources are a dimension: their sizes are planned on the driver, and more than this is an error.
MOST_SOURCES = 100_000
SEED = 20240229
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """Words to take of each source, in the order of the weights: shares of the whole by weight, none
    above ``most`` times the source; what is above is shared anew by weight among the others."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weight[k] for k in free)
        over = [k for k in free if unit * weight[k] > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = unit * weight[k]
            break
        for k in over:
            out[k] = float(most * sizes[k])
            left -= out[k]
        free = [k for k in free if k not in set(over)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many blocks of each source (columns) go to each shard (rows).

    A node of the tree holds exact block quotas; its left half gets its share of the node's blocks as
    one draw without replacement, the right half gets the rest, down to single shards.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    nodes = [(0, shards, np.asarray(quotas, np.int64))]
    while nodes:
        a, b, own = nodes.pop()
        if b - a == 1:
            out[a] = own
            continue
        middle, total = (a + b) // 2, int(own.sum())
        draw = total * (middle - a) // (b - a)
        left = np.zeros_like(own)
        rest, need = total, draw
        for k, n in enumerate(own.tolist()):  # source by source, each given what is left
            if not need:
                break
            rest -= n
            left[k] = int(rng.hypergeometric(n, rest, need)) if n and rest else min(n, need)
            need -= int(left[k])
        nodes += [(a, middle, left), (middle, b, own - left)]
    return out


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def draw_blocks(sizes: np.ndarray, need: float, order: np.ndarray) -> np.ndarray:
    """Which blocks, taken in ``order``, bring their sum near ``need``: the longest run that fits, then
    each later block that still fits, then one more where that comes nearer."""
    taken = np.zeros(len(sizes), bool)
    total = 0
    for k in order.tolist():
        if total + sizes[k] <= need:
            taken[k] = True
            total += int(sizes[k])
    rest = np.flatnonzero(~taken)
    if len(rest):
        k = rest[np.argmin(sizes[rest])]
        if total + sizes[k] - need < need - total:
            taken[k] = True
    return taken


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The blocks of every source: source, block, source_size, target and shards, the shard of each
    time that the block is drawn. ``docs`` has source, size and block.

    A source's quota is the number of its blocks that bring it near its target. The splitting tree
    gives each shard its part of every quota, and the shards draw it, disjoint, from the source's permuted
    blocks. Block sums are combined before the shuffle, and a source has at most BLOCKS of them.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    sums = scratch.cut(docs.groupBy("source", "block").agg(F.sum("size").alias("size")), "mix-sums")
    rows = sums.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in rows]
    wanted = targets(sizes, weights, most)
    whole = [min(most, int(t // s)) if s else 0 for t, s in zip(wanted, sizes)]
    table = [(r["source"], r["size"], float(t), int(w)) for r, t, w in zip(rows, wanted, whole)]
    sources = spark.createDataFrame(table, "source string, source_size long, target double, whole int")

    def drawn(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        source, target, most_of_it, size = (group[c][0].as_py() for c in ("source", "target", "whole", "source_size"))
        order = np.random.default_rng(_seed(seed, "draw", source)).permutation(len(group))
        extra = draw_blocks(np.asarray(group["size"]), float(target - most_of_it * size), order) if most_of_it < most else np.zeros(len(group), bool)
        return group.select(["source", "block", "source_size", "target"]).append_column("copies", pa.array(most_of_it + extra.astype(np.int32), pa.int32()))

    joined = sums.join(sources, sums["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    copies = scratch.cut(joined.groupBy("source").applyInArrow(drawn, "source string, block int, source_size long, target double, copies int"), "mix-copies")
    quota = {r["source"]: r["n"] for r in copies.groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    split = split_quotas(np.array([quota.get(r["source"], 0) for r in rows], np.int64), shards, np.random.default_rng(seed))
    parts = spark.createDataFrame([(r["source"], split[:, k].tolist()) for k, r in enumerate(rows)], "source string, quotas array<long>")

    def deal(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        copies = np.repeat(np.arange(len(group)), np.asarray(group["copies"]))
        copies = np.random.default_rng(_seed(seed, "deal", group["source"][0].as_py())).permutation(copies)
        shard = np.searchsorted(np.cumsum(group["quotas"][0].as_py()), np.arange(len(copies)), "right")
        got: list[list[int]] = [[] for _ in range(len(group))]
        for k, s in zip(copies.tolist(), shard.tolist()):
            got[k].append(s)
        return group.select(["source", "block", "source_size", "target"]).append_column("shards", pa.array(got, pa.list_(pa.int32())))

    dealt = copies.join(parts, copies["source"].eqNullSafe(parts["source"])).drop(parts["source"])
    out = cut(dealt.groupBy("source").applyInArrow(deal, "source string, block int, source_size long, target double, shards array<int>"), "mix-blocks")
    scratch.clear()
    return out


def block_of(doc_id: Column, seed: int = SEED, blocks: int = BLOCKS) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(blocks)).cast("int")


def _sized(docs: DataFrame, *columns: Column | str) -> DataFrame:
    size = word_count(F.col("text")).alias("size")
    return docs.select(*columns, F.col("source").cast("string").alias("source"), size, block_of(F.col("doc_id")).alias("block"))


def takings(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (one entry for each time the document is
    taken) of every document.

    Null text has size 0; the null source is a source of its own, last; repeated rows are documents of
    their own that go together; an empty table gives an empty result. Blocks of equal size are taken in
    the order of their permutation. Seeds are fixed, so reruns agree.
    """
    light = cut(_sized(docs, "doc_id"), "mix-sizes")
    blocks = plan(light, **options)
    # a source's documents meet in as many keys as it has blocks
    out = light.join(blocks, light["block"].eqNullSafe(blocks["block"]) & light["source"].eqNullSafe(blocks["source"])).drop(blocks["source"], blocks["block"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix(docs: DataFrame, with_place: bool = False, **options) -> DataFrame:
    """The mixed rows: each document as many times as it is taken, dealt to its output shards and
    shuffled inside each; with mix_shard and mix_order if ``with_place``. Columns as in ``docs``.

    Rows are dealt by ranges of (shard, order), to at least one task a shard and to more as the text
    grows, so a shard is written by several tasks one after another. The edge cases are those of
    ``takings``."""
    scratch = Scratch(docs.sparkSession)
    light = scratch.cut(_sized(docs, F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")), "mix-sizes")
    total = light.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    blocks = plan(light, **options)
    scratch.clear()
    source, own, block, copy, shard, order = free_names(docs.columns, "source_key", "block_key", "block", "copy", "mix_shard" if with_place else "shard", "mix_order" if with_place else "order")
    drawn = blocks.select(F.col("source").alias(source), F.col("block").alias(block), F.posexplode("shards").alias(copy, shard))
    out = docs.withColumn(own, block_of(F.col("doc_id")))
    out = out.join(drawn, F.col("source").cast("string").eqNullSafe(F.col(source)) & (F.col(own) == F.col(block)))
    out = out.withColumn(order, F.xxhash64("doc_id", copy, shard, F.lit(options.get("seed", SEED))))
    tasks = max(options.get("shards", SHARDS), -(-total // TASK_BYTES))
    out = out.repartitionByRange(tasks, shard, order).sortWithinPartitions(shard, order)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, *([F.col(shard), F.col(order)] if with_place else []))
