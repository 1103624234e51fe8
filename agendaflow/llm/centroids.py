"""Clustering around centroids with Drake's adaptive bounds, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, released

CLUSTERS, ROUNDS, DIMENSION, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components are kept within this, so that a squared distance of 64 of them fits a long.
MOST_COMPONENT = 1 << 27
#: The part of the rows that may need more bounds than are stored, when fewer are stored from then on.
SPARE = 0.01
STATE = "vec_id long, v array<int>, cluster int, was int, near array<int>, bounds array<double>, used int"


def quantised(table: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of the vectors of exactly ``dimension`` components,
    none of them null or not finite. Integers beyond MOST_COMPONENT become that."""
    x = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = F.transform("x", lambda e: F.floor(F.greatest(F.least(e * F.lit(float(scale)), F.lit(float(MOST_COMPONENT))), F.lit(float(-MOST_COMPONENT)))).cast("int"))
    return x.where((F.size("x") == dimension) & ~bad).select("vec_id", whole.alias("v"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of smallest sha256 of ``seed:vec_id``, in ascending order of it."""
    drawn = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in drawn.orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()], np.int64)


def _matrix(col: pa.Array, n: int, kind) -> np.ndarray:
    return np.asarray(col.flatten()).astype(kind, copy=False).reshape(n, -1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def _all_squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([_squared(v, c) for c in centroids], axis=1)


def _below(d: np.ndarray) -> np.ndarray:
    """A lower bound of the root of exact squares, rounding included."""
    return np.sqrt(d.astype(np.float64)) * (1 - 1e-12)


def _above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + 1e-12)


class Bounds:
    """A block of vectors: the centroid of each, its ``width`` next nearest ones in order, an upper bound
    of the own distance, a lower bound for each of those, and one for all centroids that remain."""

    def __init__(self, v: np.ndarray, cluster: np.ndarray, near: np.ndarray, bounds: np.ndarray):
        self.v, self.cluster, self.near, self.bounds = v, cluster, near, bounds

    @classmethod
    def scan(cls, v: np.ndarray, centroids: np.ndarray, width: int) -> Bounds:
        """From the distances to all centroids; ties go to the smaller number."""
        d = _all_squared(v, centroids)
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order, axis=1)
        rest = _below(d[:, width + 1]) if width + 1 < len(centroids) else np.full(len(v), np.inf)
        bounds = np.concatenate([_above(d[:, :1]), _below(d[:, 1 : width + 1]), rest[:, None]], axis=1)
        return cls(v, order[:, 0].astype(np.int32), order[:, 1 : width + 1].astype(np.int32), bounds)

    def narrow(self, width: int) -> None:
        """Stores fewer bounds; the least of those that go is one for the remainder."""
        if width < self.near.shape[1]:
            rest = self.bounds[:, width + 1 :].min(axis=1)
            self.near, self.bounds = self.near[:, :width], np.concatenate([self.bounds[:, : width + 1], rest[:, None]], axis=1)

    def move(self, drift: np.ndarray) -> None:
        """Loosens the bounds by how far each centroid went, and makes them ascend."""
        b = self.bounds
        b[:, 0] = (b[:, 0] + drift[self.cluster]) * (1 + 1e-12)
        b[:, 1:-1] -= drift[self.near]
        b[:, -1] -= drift.max()
        b[:, 1:] -= np.abs(np.where(np.isfinite(b[:, 1:]), b[:, 1:], 0)) * 1e-12
        b[:, 1:] = np.minimum.accumulate(b[:, :0:-1], axis=1)[:, ::-1]

    def _level(self, rows: np.ndarray) -> np.ndarray:
        """How many of the next nearest may be as near as the own centroid; one more: any may."""
        return (self.bounds[rows, :1] >= self.bounds[rows, 1:]).sum(axis=1)

    def assign(self, centroids: np.ndarray) -> np.ndarray:
        """Moves each vector to its nearest centroid; returns how many bounds it took."""
        width = self.near.shape[1]
        used = self._level(np.arange(len(self.v)))
        rows = np.flatnonzero(used)
        own = _squared(self.v[rows], centroids[self.cluster[rows]])
        self.bounds[rows, 0] = _above(own)
        used[rows] = self._level(rows)
        for level in range(1, width + 1):
            mine = used[rows] == level
            r = rows[mine]
            if not len(r):
                continue
            some = np.concatenate([self.cluster[r, None], self.near[r, :level]], axis=1)
            d = np.stack([own[mine], *(_squared(self.v[r], centroids[some[:, k]]) for k in range(1, level + 1))], axis=1)
            order = np.lexsort((some, d), axis=1)
            some, d = np.take_along_axis(some, order, axis=1), np.take_along_axis(d, order, axis=1)
            self.cluster[r], self.near[r, :level] = some[:, 0], some[:, 1:]
            self.bounds[r, 0], self.bounds[r, 1 : level + 1] = _above(d[:, 0]), _below(d[:, 1:])
        r = rows[used[rows] > width]
        if len(r):
            again = Bounds.scan(self.v[r], centroids, width)
            self.cluster[r], self.near[r], self.bounds[r] = again.cluster, again.near, again.bounds
        return used


def _state(batch: pa.RecordBatch, x: Bounds, was: np.ndarray, used: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch["vec_id"], batch["v"], pa.array(x.cluster, pa.int32()), pa.array(was, pa.int32()), _lists(x.near, pa.int32()), _lists(x.bounds, pa.float64()), pa.array(used, pa.int32())],
        ["vec_id", "v", "cluster", "was", "near", "bounds", "used"],
    )


def _first(centroids: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := len(batch):
                x = Bounds.scan(_matrix(batch["v"], n, np.int64), centroids, width)
                yield _state(batch, x, np.full(n, -1), np.full(n, width + 1))

    return run


def _next(old: np.ndarray, new: np.ndarray, width: int):
    drift = _above(((new - old) ** 2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := len(batch):
                x = Bounds(_matrix(batch["v"], n, np.int64), np.array(batch["cluster"]), _matrix(batch["near"], n, np.int32).copy(), _matrix(batch["bounds"], n, np.float64).copy())
                was = x.cluster.copy()
                x.narrow(width)
                x.move(drift)
                used = x.assign(new)
                yield _state(batch, x, was, used)

    return run


def _moves(clusters: int, dimension: int):
    """A partition's changes of each cluster's count and sums: what came less what left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, dimension + 1), np.int64)
        for batch in batches:
            if n := len(batch):
                v = np.concatenate([np.ones((n, 1), np.int64), _matrix(batch["v"], n, np.int64)], axis=1)
                cluster, was = np.asarray(batch["cluster"]), np.asarray(batch["was"])
                for k in range(clusters):
                    total[k] += v[cluster == k].sum(axis=0) - v[was == k].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(clusters), pa.int32()), _lists(total, pa.int64())], ["cluster", "sums"])

    return run


def _add_moves(state: DataFrame, sums: np.ndarray) -> None:
    """Adds to ``sums`` what the vectors that changed their cluster bring and take; only those are read."""
    clusters, width = sums.shape
    moved = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(released(_moves(clusters, width - 1)), "cluster int, sums array<long>")
    for r in moved.select("cluster", F.posexplode("sums").alias("k", "x")).groupBy("cluster", "k").agg(F.sum("x").alias("x")).collect():
        sums[r["cluster"], r["k"]] += r["x"]


def _width(counts: dict[int, int], width: int, least: int) -> int:
    """The fewest bounds that certify all but SPARE of the rows, as last used; never more than now."""
    allowed = SPARE * sum(counts.values())
    while width > least and sum(n for used, n in counts.items() if used >= width) <= allowed:
        width -= 1
    return width


def lloyd(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray, list[dict[int, int]]]:
    """The vectors with their clusters after ``rounds`` rounds and a last assignment (written, vec_id, v,
    cluster), the centroids, and how many rows used how many bounds in each round after the first.

    A round reads the table of vectors and bounds that the round before wrote and writes the next; it
    compares a vector only with the centroids that its bounds leave open. Sums change by the vectors that
    moved, in exact integers. Centroids, sums and counts (clusters x dimension numbers) are all that passes
    the driver.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession)
    rows = quantised(table, dimension, scale)
    centroids = first_centroids(rows, clusters, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], STATE).select("vec_id", "v", "cluster"), np.zeros((0, dimension), np.int64), []
    width = min(k - 1, max(1, k // 2))
    state = scratch.cut(rows.mapInArrow(released(_first(centroids, width)), STATE), "centroids-0")
    sums, log = np.zeros((k, dimension + 1), np.int64), []
    for r in range(rounds):
        _add_moves(state, sums)
        old, some = centroids, sums[:, 0] > 0
        centroids = np.where(some[:, None], sums[:, 1:] // np.maximum(sums[:, :1], 1), centroids)
        if r:
            width = _width(log[-1], width, min(k - 1, max(1, k // 8)))
        state = scratch.cut(state.mapInArrow(released(_next(old, centroids, width)), STATE), f"centroids-{r + 1}")
        scratch.clear(keep=1)
        log.append({x["used"]: x["n"] for x in state.groupBy("used").agg(F.count("*").alias("n")).collect()})
    return state.select("vec_id", "v", "cluster"), centroids, log


def cluster(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector of
    exactly ``dimension`` finite components.

    Ties go to the smaller centroid; an empty centroid stays where it is; rows that repeat a vec_id are
    vectors of their own, and where several could be a starting centroid the smaller vector comes first;
    those of null vec_id start last. Fewer vectors than ``clusters`` make as many centroids. Inertias too large
    for a long become the largest one. No vectors, no rows.
    """
    state, centroids, _ = lloyd(table, clusters, rounds, dimension, scale, seed)
    spark = table.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    last = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cluster int, centroid array<long>")
    terms = F.zip_with("v", "centroid", lambda a, b: (a.cast("long") - b) * (a.cast("long") - b))
    near = state.join(F.broadcast(last), "cluster").select("vec_id", "cluster", F.aggregate(terms, F.lit(0).cast("long"), lambda s, x: s + x).alias("distance"))
    total = {r["cluster"]: int(r["d"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    most = (1 << 63) - 1
    table = [(k, min(total.get(k, 0), most), min(sum(total.values()), most), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    return near.join(F.broadcast(spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> str:
    """The same rounds in SQL, one after another, each with all distances."""
    ctes = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS cluster, v
            FROM kept QUALIFY cluster < {clusters})""",
    ]
    distance = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (
            SELECT row_id, min({{'d': CAST({distance} AS BIGINT), 'c': cluster}}) AS best FROM kept AS k CROSS JOIN c{r} AS c GROUP BY row_id)"""
        )
        if r < rounds:
            ctes.append(
                f"""s{r} AS MATERIALIZED (
            SELECT cluster, list(m ORDER BY i) AS v
            FROM (SELECT best.c AS cluster, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
                  FROM kept JOIN a{r} USING (row_id), range(1, {dimension + 1}) AS t(i) GROUP BY best.c, i)
            GROUP BY cluster)"""
            )
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(s.v, c.v) AS v FROM c{r} AS c LEFT JOIN s{r} AS s ON s.cluster = c.cluster)")
    return f"""WITH {", ".join(ctes)}
        SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
            CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (row_id) JOIN c{rounds} AS c ON c.cluster = best.c"""
