"""Ranked lexical search over shards of wavelet trees whose postings are ordered by impact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytesops as B
from .shared import Scratch, bounded_batches, cut, released

#: A term is a maximal run of ASCII letters and digits and of all code points beyond ASCII.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
IS_TERM = np.zeros(256, bool)
IS_TERM[48:58] = IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True
FREQUENCY, LENGTH_SHARE = 1_000_000_000, 90
#: Postings that close a shard; a single longer document makes a larger one.
SHARD_POSTINGS = 1 << 20
#: Terms of the items that are broadcast at once (16 bytes each); more items are searched block by block.
BLOCK_TERMS = 1 << 20
#: Nodes that a step of the search opens at first and at most.
FIRST_NODES, MOST_NODES = 16, 1024
TOP = 10
SHARD = "docs binary, has_id binary, terms array<long>, counts array<int>, impacts binary, bits array<binary>"


def term_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each term, A-Z lower-cased, and each row's first term (n + 1 offsets). That two of
    the items' terms and the corpus's meet in one hash has a probability under 1e-6 up to 1e12 pairs."""
    low = B.LOWER[data]
    starts, ends = B.runs(IS_TERM[data], off)
    return B.range_hashes(low, starts, ends).view(np.int64), np.searchsorted(starts, off)


def frequencies(terms: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of the distinct terms of each row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((terms, row))
    row, terms = row[order], terms[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (terms[1:] != terms[:-1])
    where = np.flatnonzero(first)
    return row[where], terms[where], np.diff(np.append(where, len(row)))


class WaveletTree:
    """Lists of documents, each ordered by falling impact, as one sequence in a wavelet tree over document
    numbers.

    A level sends the numbers whose next bit is 0 before those whose bit is 1, in the order in which they
    came. A term's range at a node therefore holds its postings of the node's documents with the largest impact
    first, which bounds the term's part in the score of any of them.
    """

    def __init__(self, depth: int, bits: list[np.ndarray], impacts: np.ndarray):
        n = len(impacts)
        self.depth = depth
        self.before = np.zeros((depth, n + 1), np.int32)
        self.zeros = np.zeros(depth, np.int32)
        self.impacts = np.zeros((depth + 1, n + 1), np.int32)
        self.impacts[0, :n] = impacts
        for k, one in enumerate(bits):
            np.cumsum(~one, out=self.before[k, 1:])
            self.zeros[k] = z = self.before[k, n]
            self.impacts[k + 1, :z] = self.impacts[k, :n][~one]
            self.impacts[k + 1, z:n] = self.impacts[k, :n][one]

    @staticmethod
    def levels(docs: np.ndarray, depth: int) -> list[np.ndarray]:
        """The bits of each level for a sequence of document numbers."""
        out = []
        for k in range(depth):
            one = (docs >> (depth - 1 - k)) & 1 == 1
            out.append(one)
            docs = np.concatenate([docs[~one], docs[one]])
        return out

    def search(self, start: np.ndarray, end: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of which the k best, and all that tie with the last of them, are sure to be
        part, leaving out those below ``least`` or 1. After one way down, nodes of the largest bounds are opened
        first, and a node whose bound lies below the k-th score found is never opened.

        ``start`` and ``end`` are the ranges of the terms at the root, none empty. A node has one entry for
        each term that it holds; entries stand in the order of their nodes.
        """
        least, wide, n = max(least, 1), self.before.shape[1], FIRST_NODES
        before, impacts = self.before.ravel(), self.impacts.ravel()
        level, prefix = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([impacts[start].astype(np.int64) @ weights])
        node, s, e, w = np.zeros(len(start), np.int64), start.astype(np.int64), end.astype(np.int64), weights
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        dive = True
        if not self.depth:  # one document
            return (prefix, bound) if bound[0] >= least else (found, scores)
        while True:
            go = np.flatnonzero(bound >= least)
            if not len(go):
                return found, scores
            stay = np.zeros(len(bound), bool)
            stay[go] = True
            if dive:  # straight down, for a first k-th score
                go = go[level[go] == level[go].max()]
            if len(go) > n:
                go = np.sort(go[np.argpartition(-bound[go], n - 1)[:n]])
            stay[go] = False
            n = n if dive else min(2 * n, MOST_NODES)
            place = np.full(len(bound), -1)
            place[go] = np.arange(len(go))
            mine = np.flatnonzero(place[node] >= 0)
            own, at = place[node[mine]], level[node[mine]]
            low, high, z = before.take(at * wide + s[mine]), before.take(at * wide + e[mine]), self.zeros[at]
            s2, e2 = np.concatenate([low, s[mine] - low + z]), np.concatenate([high, e[mine] - high + z])
            child, w2, at = np.concatenate([own, own + len(go)]), np.concatenate([w[mine], w[mine]]), np.concatenate([at, at]) + 1
            some = np.flatnonzero(e2 > s2)
            s2, e2, child, w2, at = s2[some], e2[some], child[some], w2[some], at[some]
            first = np.flatnonzero(np.append(True, child[1:] != child[:-1]))
            sums = np.add.reduceat(w2 * impacts.take(at * wide + s2), first)
            kept, deep = child[first], at[first]
            prefix2 = prefix[go[kept % len(go)]] * 2 + kept // len(go)
            leaf = (deep == self.depth) & (sums >= least)
            dive = dive and not (deep == self.depth).any()
            if leaf.any():
                found, scores = np.append(found, prefix2[leaf]), np.append(scores, sums[leaf])
                if len(scores) >= k:
                    least = max(least, int(np.partition(scores, len(scores) - k)[-k]))
                    found, scores = found[scores >= least], scores[scores >= least]
            more = (deep < self.depth) & (sums >= least)
            stay &= bound >= least
            number = np.cumsum(stay) - 1
            old = np.flatnonzero(stay[node])
            entry = np.repeat(more, np.diff(np.append(first, len(child))))
            renumber = np.cumsum(more) - 1 + int(stay.sum())
            node = np.concatenate([number[node[old]], np.repeat(renumber, np.diff(np.append(first, len(child))))[entry]])
            s, e, w = np.concatenate([s[old], s2[entry]]), np.concatenate([e[old], e2[entry]]), np.concatenate([w[old], w2[entry]])
            level, prefix, bound = np.concatenate([level[stay], deep[more]]), np.concatenate([prefix[stay], prefix2[more]]), np.concatenate([bound[stay], sums[more]])


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with at least one term, and L, all their terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = words = 0
        for batch in batches:
            data, off = B.column_bytes(batch["text"])
            for a, b in B.blocks(off):
                own, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                starts, _ = B.runs(IS_TERM[own], at)
                n = np.diff(np.searchsorted(starts, at))
                held, words = held + int((n > 0).sum()), words + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([words], pa.int64())], ["docs", "terms"])

    with bounded_batches(docs.sparkSession):
        r = docs.select("text").mapInArrow(released(count), "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return r["docs"] or 0, r["terms"] or 0


def _shard(ids: list[pa.Array], row: np.ndarray, term: np.ndarray, tf: np.ndarray, lengths: np.ndarray, docs: int, words: int) -> pa.RecordBatch:
    """The shard of some documents, numbered by ascending doc_id, nulls last."""
    ids = pa.concat_arrays(ids)
    known, ids = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
    order = np.lexsort((ids, ~known))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * docs) // words
    impact = (FREQUENCY * tf) // (1000 * tf + 8 * m[row])
    row = number[row]
    by = np.lexsort((row, -impact, term))
    term = term[by]
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    bits = WaveletTree.levels(row[by], max(0, int(len(order) - 1).bit_length()))
    pack = lambda x: np.ascontiguousarray(x).tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([pack(ids[order])], pa.binary()),
            pa.array([pack(np.packbits(known[order]))], pa.binary()),
            pa.array([term[first]], pa.list_(pa.int64())),
            pa.array([np.diff(np.append(first, len(term))).astype(np.int32)], pa.list_(pa.int32())),
            pa.array([pack(impact[by].astype(np.int32))], pa.binary()),
            pa.array([[pack(np.packbits(x)) for x in bits]], pa.list_(pa.binary())),
        ],
        ["docs", "has_id", "terms", "counts", "impacts", "bits"],
    )


def build_index(docs: DataFrame, docs_and_terms: tuple[int, int] | None = None) -> DataFrame:
    """The written shards of all documents that have a term, one row a shard.

    A task closes a shard after SHARD_POSTINGS postings, so shards are many where the corpus is large, and
    texts are never shuffled. Every term of every text is indexed.
    """
    spark = docs.sparkSession
    n, words = docs_and_terms or corpus_counts(docs)
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held, rows = [], [], 0, 0

        def close() -> pa.RecordBatch:
            row, term, tf, lengths = (np.concatenate(x) for x in zip(*parts))
            return _shard(ids, row, term, tf, lengths, n, words)

        for batch in batches:
            data, off = B.column_bytes(batch["text"])
            for a, b in B.blocks(off):
                terms, at = term_runs(data[off[a] : off[b]], off[a : b + 1] - off[a])
                lengths = np.diff(at)
                some = lengths > 0
                if not some.any():
                    continue
                row, term, tf = frequencies(terms, at)
                parts.append((rows + (np.cumsum(some) - 1)[row], term, tf, lengths[some]))
                ids.append(batch["doc_id"].slice(a, b - a).filter(pa.array(some)))
                rows, held = rows + int(some.sum()), held + len(row)
                if held >= SHARD_POSTINGS:
                    yield close()
                    ids, parts, held, rows = [], [], 0, 0
        if rows:
            yield close()

    tasks = max(-(-words // SHARD_POSTINGS), spark.sparkContext.defaultParallelism)
    path = Scratch(spark)
    with bounded_batches(spark):
        # a row is a shard of some megabytes: the writer looks at its size after each
        return path.cut(light.coalesce(tasks).mapInArrow(released(build), SHARD), "lexical", **{"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each; null texts have none."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.column_bytes(batch["text"])
            for a, b in B.blocks(off):
                row, term, _ = frequencies(*term_runs(data[off[a] : off[b]], off[a : b + 1] - off[a]))
                yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(a + row)), pa.array(term)], ["item_id", "term"])

    light = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return light.mapInArrow(split, "item_id long, term long").distinct()


def weighted_items(items: DataFrame, index: DataFrame, docs: int) -> DataFrame:
    """item_id, terms and weights: the item's terms that documents hold, and floor(1000 ln((2N+2)/(2df+1)))."""
    wanted = cut(item_terms(items), "lexical-items")
    lists = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    df = lists.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1))).cast("long")
    held = wanted.join(df.select("term", weight.alias("weight")).where("weight > 0"), "term")
    return held.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("x")).select("item_id", "x.term", "x.weight")


def _searcher(asked, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = asked.value
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items)
        for batch in batches:
            for r in range(len(batch)):
                docs = np.frombuffer(batch["docs"][r].as_py(), np.int64)
                known = np.unpackbits(np.frombuffer(batch["has_id"][r].as_py(), np.uint8), count=len(docs)).astype(bool)
                impacts = np.frombuffer(batch["impacts"][r].as_py(), np.int32)
                bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(impacts)).astype(bool) for x in batch["bits"][r].as_py()]
                tree = WaveletTree(len(bits), bits, impacts)
                terms, ends = np.asarray(batch["terms"][r].values), np.cumsum(np.asarray(batch["counts"][r].values), dtype=np.int32)
                for i, (_, term, weight) in enumerate(items):
                    at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                    hit = terms[at] == term
                    if not hit.any():
                        continue
                    at = at[hit]
                    old_ids, old_known, old_score = best[i]
                    # what has fewer than the task's k-th best so far is no result
                    least = int(old_score[k - 1]) if len(old_score) >= k else 1
                    found, score = tree.search(np.append(np.int32(0), ends)[at], ends[at], weight[hit], k, least)
                    ids, own, score = np.append(old_ids, docs[found]), np.append(old_known, known[found]), np.append(old_score, score)
                    order = np.lexsort((ids, ~own, -score))[:k]
                    best[i] = ids[order], own[order], score[order]
                del tree, bits
        for (item, _, _), (ids, own, score) in zip(items, best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=~own), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of largest score above 0 for each item, ties to the
    smaller doc_id, null doc_ids last.

    A document's score sums w * ((10**9 tf) div (1000 tf + 8 m)) over the item's terms, each once. Null and
    empty texts have no terms, and items without any get no rows; rows that repeat an item_id are one item
    with the terms of all; rows that repeat a doc_id are documents of their own. No documents or items, no rows.

    Items are broadcast in blocks of about BLOCK_TERMS terms, whatever their number; each block meets every
    shard once, and a task keeps k documents an item.
    """
    spark = docs.sparkSession
    counts = corpus_counts(docs)
    index = build_index(docs, counts)
    asked = cut(weighted_items(items, index, counts[0]), "lexical-weights")
    blocks = max(1, -(-(asked.agg(F.sum(F.size("term")).alias("n")).first()["n"] or 0) // BLOCK_TERMS))
    own = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        block = [(r["item_id"], np.array(r["term"], np.int64), np.array(r["weight"], np.int64)) for r in asked.where(own == b).toArrow().to_pylist()]
        shared = spark.sparkContext.broadcast(block)
        with bounded_batches(spark, 1):
            found = cut(index.mapInArrow(released(_searcher(shared, k)), "item_id long, doc_id long, score long"), "lexical-found")
        out = found if out is None else out.unionByName(found)
    first = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", first).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_oracle(k: int = TOP) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = f"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{TERM}'))"
    return f"""
        WITH words AS (SELECT doc_id, row_id, {split} AS term FROM (SELECT doc_id, text, row_number() OVER () AS row_id FROM documents)),
        lengths AS (SELECT row_id, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY row_id),
        whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
        postings AS (SELECT row_id, term, count(*) AS tf FROM words GROUP BY row_id, term),
        asked AS (SELECT DISTINCT item_id, {split} AS term FROM benchmark),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, whole GROUP BY term, docs),
        scores AS (
            SELECT item_id, doc_id, row_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ({LENGTH_SHARE} * n * docs) // terms)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (row_id), whole
            GROUP BY item_id, doc_id, row_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
        WHERE rank <= {k}"""
