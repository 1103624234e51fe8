"""Approximate nearest neighbours by learned partitions of a neighbour graph."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, cut

K = 20
#: About so many vectors, drawn by a hash of vec_id, make a graph and train its classifier.
SAMPLE = 8000
GRAPH_NEIGHBOURS = 16
#: Rows that a partition is to hold; from LEAST_ROWS rows on there are LEAST_PARTS or more.
PART_ROWS, LEAST_ROWS, LEAST_PARTS = 2500, 200, 4
#: Partitions that one classifier tells apart at most. With more, each of its partitions is partitioned
#: again by a graph and a classifier of its own, so there are at most FAN * FAN; beyond that they grow.
FAN = 256
#: The part of the sampled neighbours that is to lie in the visited partitions; on held-out vectors the
#: classifier's total probability over them is set so that it does.
COVERAGE = 0.97
LEAST_PROBES = 2
HIDDEN = 128
#: Rows of a partition, and queries, that one task compares at once.
BLOCK_ROWS, BLOCK_QUERIES = 8000, 4000


def neighbour_graph(x: np.ndarray, k: int = GRAPH_NEIGHBOURS) -> np.ndarray:
    """The k rows of largest inner product with each row, itself excluded, block by block."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1000):
        near = x[a : a + 1000] @ x.T
        near[np.arange(len(near)), a + np.arange(len(near))] = -np.inf
        out[a : a + 1000] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(graph: np.ndarray, parts: int, seed: int = 11) -> np.ndarray:
    """Labels of ``parts`` (a power of two) equal parts that cut few edges: recursive bisection at the
    median of a smooth vector on the graph, then swaps of the rows that gain most."""
    n = len(graph)
    label = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    for _ in range(int(math.log2(parts))):
        new = label * 2
        for part in np.unique(label):
            rows = np.flatnonzero(label == part)
            where = np.full(n, -1)
            where[rows] = np.arange(len(rows))
            local = where[graph[rows]]
            source = np.repeat(np.arange(len(rows)), local.shape[1])[local.ravel() >= 0]
            target = local.ravel()[local.ravel() >= 0]
            a, b = np.concatenate([source, target]), np.concatenate([target, source])
            degree = np.bincount(a, minlength=len(rows)) + 1.0
            v = rng.standard_normal(len(rows))
            for _ in range(60):
                v = (np.bincount(a, v[b], len(rows)) + v) / degree
                v -= (v * degree).sum() / degree.sum()
                v /= np.abs(v).max() + 1e-30
            side = np.zeros(len(rows), bool)
            side[np.argsort(v, kind="stable")[len(rows) // 2 :]] = True
            for _ in range(10):
                other = np.bincount(a, side[b], len(rows))
                gain = np.where(side, degree - 1 - 2 * other, 2 * other - degree + 1)
                left, right = np.flatnonzero(~side & (gain > 0)), np.flatnonzero(side & (gain > 0))
                m = min(len(left), len(right), max(1, len(rows) // 20))
                if not min(len(left), len(right)):
                    break
                side[left[np.argsort(-gain[left], kind="stable")[:m]]] = True
                side[right[np.argsort(-gain[right], kind="stable")[:m]]] = False
            new[rows] += side
        label = new
    return label


class Router:
    """A one-hidden-layer classifier from vectors to probabilities of partitions, and the total
    probability up to which the most probable ones are visited."""

    def __init__(self, *values, level: float = 1.0):
        self.values, self.level = [np.asarray(v, np.float32) for v in values], level

    def __call__(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.values
        z = np.maximum(((x - mean) * scale) @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def visits(self, p: np.ndarray, level: float | None = None) -> np.ndarray:
        """Which partitions are visited, given their probabilities: the most probable up to the level."""
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.take_along_axis(p, order, axis=1).cumsum(axis=1) - np.take_along_axis(p, order, axis=1)
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, (before < (self.level if level is None else level)) | (np.arange(p.shape[1]) < LEAST_PROBES), axis=1)
        return out


def train_router(x: np.ndarray, target: np.ndarray, epochs: int = 30, seed: int = 5) -> Router:
    """Fits the classifier to soft labels by stochastic gradients (Adam)."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), 1 / (x.std() + 1e-12)
    z = (x - mean) * scale
    p = [rng.standard_normal((x.shape[1], HIDDEN)) * math.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, target.shape[1])) * math.sqrt(1 / HIDDEN), np.zeros(target.shape[1])]
    m, s, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            rows = order[a : a + 128]
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            o = h @ p[2] + p[3]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            d = (o / o.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ p[2].T) * (h > 0)
            grads = [z[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                p[k] = p[k] - 2e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
    return Router(mean, scale, *p)


def number_of_parts(rows: int) -> int:
    """A power of two."""
    return max(LEAST_PARTS, 1 << max(0, round(math.log2(rows / PART_ROWS)))) if rows >= LEAST_ROWS else 1


def fit(sample: np.ndarray, parts: int) -> Router:
    """The router of a balanced partition of the sample's neighbour graph. A fifth of the sample is held
    out of training, tells the level that reaches COVERAGE, and is trained on afterwards."""
    graph = neighbour_graph(sample)
    label = balanced_partition(graph, parts)
    soft = np.zeros((len(sample), parts))
    np.add.at(soft, (np.arange(len(sample)), label), 1.0)
    for k in range(graph.shape[1]):
        np.add.at(soft, (np.arange(len(sample)), label[graph[:, k]]), 1.0)
    soft /= soft.sum(axis=1, keepdims=True)
    held = np.random.default_rng(17).random(len(sample)) < 0.2
    trial = train_router(sample[~held], soft[~held])
    p = trial(sample[held])
    reached = lambda level: float((soft[held] * trial.visits(p, level)).sum(axis=1).mean())
    level = next((x for x in (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.925, 0.95, 0.96, 0.97, 0.98, 0.985, 0.99, 0.995, 0.998) if reached(x) >= COVERAGE), 1.0) if held.any() else 1.0
    out = train_router(sample, soft)
    out.level = level
    return out


class Index:
    """The router of the first partition and, by its partitions, those of the second."""

    def __init__(self, dimension: int, first: Router | None, second: dict[int, Router], width: int):
        self.dimension, self.first, self.second, self.width = dimension, first, second, width

    def place(self, x: np.ndarray) -> np.ndarray:
        if self.first is None:
            return np.zeros(len(x), np.int64)
        out = self.first(x).argmax(axis=1).astype(np.int64)
        return self._within(x, out)

    def _within(self, x: np.ndarray, top: np.ndarray) -> np.ndarray:
        out = top * self.width
        for part in np.unique(top).tolist():
            if part in self.second:
                rows = np.flatnonzero(top == part)
                out[rows] += self.second[part](x[rows]).argmax(axis=1)
        return out

    def probe(self, x: np.ndarray) -> list[list[int]]:
        if self.first is None:
            return [[0]] * len(x)
        lists: list[list[int]] = [[] for _ in range(len(x))]
        visits = self.first.visits(self.first(x))
        for part in np.flatnonzero(visits.any(axis=0)).tolist():
            rows = np.flatnonzero(visits[:, part])
            router = self.second.get(part)
            inner = router.visits(router(x[rows])) if router else np.ones((len(rows), 1), bool)
            for r, own in zip(rows.tolist(), inner):
                lists[r] += [part * self.width + int(j) for j in np.flatnonzero(own)]
        return lists


def vectors(table: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: no null, zero or non-finite vectors."""
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = np.asarray(col.flatten(), np.float64)
    return flat.reshape(len(col), -1)


def _by_length(own: Index, col: pa.Array, of_main, of_other) -> list:
    """``of_main`` of the vectors of the index's length, as a matrix, and ``of_other`` of the other lengths."""
    lengths = np.asarray(col.value_lengths())
    main = np.flatnonzero(lengths == own.dimension)
    out = [None if n == own.dimension else of_other(int(n)) for n in lengths.tolist()]
    if len(main):
        for k, x in zip(main.tolist(), of_main(_matrix(col.take(pa.array(main))))):
            out[k] = x
    return out


def _drawn(rows: DataFrame, share, salt: str) -> DataFrame:
    """The rows of which a hash of vec_id lies below ``share`` of 2**20."""
    return rows.where(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 20)) < share)


def _share(sample: int, n: int) -> int:
    return min(1 << 20, math.ceil((1 << 20) * sample / max(n, 1)))


def build_index(rows: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Index]:
    """Every row with its partition, and the routers; fitted to bounded samples.

    Vectors of most rows' length (the smaller on a tie) are partitioned by the routers. Those of another
    length have no inner product with them; each length is a partition of its own, -length.
    """
    spark = rows.sparkSession
    most = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    n, dimension = (most["n"], most["d"]) if most else (0, 0)
    main = rows.where(F.size("embedding") == dimension)
    parts = number_of_parts(n)
    top = parts if parts <= FAN else min(FAN, 1 << math.ceil(math.log2(parts) / 2))
    width = min(FAN, parts // top)
    index = Index(dimension, None, {}, width)
    if parts > 1:
        x = _matrix(_drawn(main, _share(sample, n), "fit").select("vec_id", "embedding").orderBy("vec_id").limit(2 * sample).select("embedding").toArrow()["embedding"])
        if len(x) >= 2 * top:
            index.first = fit(x, top)
    if width > 1 and index.first:
        index.second = _fit_second(spark, main, index, sample)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                part = _by_length(shared.value, batch["embedding"], shared.value.place, lambda d: -d)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array(part, pa.int32())], ["vec_id", "embedding", "part"])

    return cut(rows.mapInArrow(place, "vec_id long, embedding array<double>, part int"), "ann-index"), index


def _fit_second(spark, main: DataFrame, index: Index, sample: int) -> dict[int, Router]:
    """The routers inside the first partitions, each fitted by one task to a bounded sample of its rows;
    the driver gets at most FAN of them."""
    first = spark.sparkContext.broadcast(Index(index.dimension, index.first, {}, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array(first.value.place(_matrix(batch["embedding"])), pa.int32())], ["vec_id", "embedding", "part"])

    scratch = Scratch(spark)
    placed = scratch.cut(main.mapInArrow(place, "vec_id long, embedding array<double>, part int"), "ann-first")
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for part, n in counts.items() for x in (part, _share(sample, n))])[F.col("part")]
    width = index.width

    def one(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["vec_id"]), kind="stable")[: 2 * sample]
        x = _matrix(table["embedding"])[order]
        model = [pickle.dumps(fit(x, width))] if len(x) >= 2 * width else []
        return pa.table({"part": pa.array(np.asarray(table["part"])[: len(model)]), "model": pa.array(model, pa.binary())})

    models = _drawn(placed, share, "second").groupBy("part").applyInArrow(one, "part int, model binary").collect()
    scratch.clear()
    return {r["part"]: pickle.loads(r["model"]) for r in models}


def _nearest(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"]).astype(bool)
        ids, x = np.asarray(table["vec_id"]), _matrix(table["embedding"])
        q, qid, r, rid = x[asks], ids[asks], x[~asks], ids[~asks]
        order = np.argsort(rid, kind="stable")
        r, rid = r[order], rid[order]
        # the product is rounded otherwise than the score, by far less than this
        slack = 1e-9 * np.sqrt((q * q).sum(axis=1)) * (np.sqrt((r * r).sum(axis=1)).max() if len(r) else 0.0)
        query, found, score = [], [], []
        for a in range(0, len(q) if len(r) else 0, 256):
            near = q[a : a + 256] @ r.T
            near[qid[a : a + 256, None] == rid[None, :]] = -np.inf
            m = min(k, len(rid))
            least = -np.partition(-near, m - 1, axis=1)[:, m - 1 : m]
            # all that may be among the k first
            for i, row in enumerate(near >= np.maximum(least - slack[a : a + 256, None], -1e300)):
                hit = np.flatnonzero(row)
                exact = (r[hit] * q[a + i]).sum(axis=1)
                best = np.lexsort((rid[hit], -exact))[:k]
                query.append(np.full(len(best), qid[a + i]))
                found.append(rid[hit][best])
                score.append(exact[best])
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
        return pa.table({"query_id": cat(query, np.int64), "vec_id": cat(found, np.int64), "score": cat(score, np.float64)})

    return run


def _asked(rows: DataFrame, index: Index, is_query) -> DataFrame:
    """The queries, one an id, each with the partitions that it visits (written)."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                lists = _by_length(shared.value, batch["embedding"], shared.value.probe, lambda d: [-d])
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "embedding", "parts"])

    asks = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return cut(asks.mapInArrow(probe, "vec_id long, embedding array<double>, parts array<int>"), "ann-queries")


def compared_share(table: DataFrame, is_query) -> float:
    """The part of all pairs of a query and a row that ``search`` compares."""
    rows, index = build_index(vectors(table))
    asked = _asked(rows, index, is_query)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    pairs = asked.select(F.explode("parts").alias("part")).join(F.broadcast(sizes), "part").agg(F.sum("n").alias("n")).first()["n"]
    return (pairs or 0) / max(1, rows.count() * asked.count())


def search(table: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each row that
    ``is_query`` selects, its own row excluded, ties to the smaller vec_id.

    A partition is dealt into blocks of rows and of queries, and a task compares one with another, so
    no partition has to fit one task. Rows that repeat a vec_id are candidates each, and one query, the
    least vector where they differ; none of them is its own neighbour. Vectors of different lengths have
    no inner product. Fewer candidates give fewer rows; no query or no candidate gives none.
    """
    rows, index = build_index(vectors(table))
    queries = _asked(rows, index, is_query).select("vec_id", "embedding", F.explode("parts").alias("part"))
    sizes = rows.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("row_blocks"))
    asked = queries.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("query_blocks"))
    blocks = F.broadcast(sizes.join(asked, "part"))  # a row for each of at most FAN * FAN partitions and other lengths

    def deal(df: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col(own))
        return df.join(blocks, "part").select(
            "part", mine.alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other), F.lit(asks).alias("asks"), "vec_id", "embedding"
        ).select("part", "row_blocks", "query_blocks", "asks", "vec_id", "embedding")

    both = deal(rows, "row_blocks", "query_blocks", False).unionByName(deal(queries, "query_blocks", "row_blocks", True))
    near = both.groupBy("part", "row_blocks", "query_blocks").applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
    first = F.row_number().over(_by_query())
    return near.withColumn("rank", first).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_query():
    from pyspark.sql.window import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def recall(found: DataFrame, table: DataFrame, is_query, k: int = K, sample: int = 200) -> float:
    """The part of the true k nearest rows that ``found`` has, for a documented number of its queries,
    compared with every row by brute force, partition by partition."""
    rows = vectors(table)
    most = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.where(F.size("embedding") == (most["d"] if most else 0))
    drawn = rows.where(is_query).orderBy(F.xxhash64("vec_id")).limit(sample).toArrow()
    asked = rows.sparkSession.sparkContext.broadcast((np.asarray(drawn["vec_id"]), _matrix(drawn["embedding"])))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = asked.value
        for batch in batches:
            if len(batch):
                both = pa.table({"asks": pa.array([True] * len(qid) + [False] * len(batch)), "vec_id": np.concatenate([qid, np.asarray(batch["vec_id"])]), "embedding": pa.concat_arrays([pa.array(list(q), pa.list_(pa.float64())), batch["embedding"].cast(pa.list_(pa.float64()))])})
                yield from _nearest(k)(both).to_batches()

    near = rows.mapInArrow(compare, "query_id long, vec_id long, score double")
    true = near.withColumn("rank", F.row_number().over(_by_query())).where(F.col("rank") <= k)
    hit = true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(true.count(), 1)
