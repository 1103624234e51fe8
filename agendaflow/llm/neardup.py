"""Near-duplicate documents by SetSketch registers, banding, joint estimation and exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .components import components
from .shared import Scratch, bounded_batches, cut, free_names, join_by_key, released

#: Registers hold truncated, exponentially spaced minima: floor(1 - log_BASE(minimum)), minima at RATE.
REGISTERS, BASE, RATE, TOP = 120, 1.001, 20.0, (1 << 16) - 1
#: Bands of registers: a pair at 0.85 shares none with probability (1 - 0.85**5)**24, below 1e-6.
BANDS, ROWS = 24, 5
#: Linked from 85 hundredths on.
LINK = 85
#: Pairs whose joint estimate is lower than this are not checked exactly; a pair at 0.85 falls there
#: with a probability of about 1e-7.
LEAST_ESTIMATE = 0.65
#: Rows of a bucket or cluster that one task compares at once, and their shingles; more are dealt into blocks.
BLOCK, BLOCK_SHINGLES = 128, 1 << 21
#: Rows, or bytes, that a worker gathers before it handles the groups it has whole.
FLUSH_ROWS, FLUSH_BYTES = 2000, 8 << 20
#: Ids of dropped documents that are broadcast at most (16 MB), and classes (2 MB).
MOST_BROADCAST, MOST_CLASSES = 1_000_000, 50_000

_rng = np.random.default_rng(7)
_FACTORS = (_rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) << B.U(1)) | B.U(1)
_ODD = (_rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) << B.U(1)) | B.U(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set of 64-bit hashes; merging two sets takes the larger registers."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([sets[k] for k in full])
    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    least = np.empty((len(full), REGISTERS), np.float64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat(flat * _FACTORS[i], at)
    minimum = -np.log1p(-np.minimum((least + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(minimum) / np.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def bands(table: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    parts = table.reshape(len(table), BANDS, ROWS).astype(np.uint64)
    return B.mix((parts * _ODD).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * B.U(0x9E3779B97F4A7C15))


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate_reaches(own: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray, level: float = LEAST_ESTIMATE) -> np.ndarray:
    """Whether the joint maximum-likelihood similarity of ``own`` with each of ``others`` is at least
    ``level``. The likelihood of the counts of larger, smaller and equal registers, given both set
    sizes, is concave in the similarity, so the sign of its slope at ``level`` tells."""
    u, v = n / (n + sizes), sizes / (n + sizes)
    possible = np.minimum(u / v, v / u) >= level
    more = (own > others).sum(axis=1)
    less = (own < others).sum(axis=1)
    same = REGISTERS - more - less
    rate = (BASE - 1) / BASE

    def parts(x, dx):
        return _chance(x), rate * dx / (1 - x * rate) / np.log(BASE)

    a, da = parts(np.maximum(u - v * level, 1e-12), -v)
    b, db = parts(np.maximum(v - u * level, 1e-12), -u)
    slope = more * da / a + less * db / b - same * (da + db) / (1 - a - b)
    return possible & (slope >= 0)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, an order-free 128-bit digest of the set (d1, d2) and the registers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.column_bytes(batch["text"])
            for a, b in B.blocks(off):
                sets = B.shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a])
                table = registers(sets)
                d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                d2 = np.array([B.mix(s ^ B.U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1), pa.array(d2), pa.array([r.tobytes() for r in table], pa.binary())],
                    ["doc_id", "n_shingles", "d1", "d2", "registers"],
                )

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, n_shingles long, d1 long, d2 long, registers binary")


def _band_keys(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                table = np.frombuffer(b"".join(batch["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
                keys = bands(table).view(np.int64)
                ids = np.repeat(np.asarray(batch["rep"]), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "rep"])

    return reps.select("rep", "registers").mapInArrow(released(run), "key long, rep long")


def _grouped(df: DataFrame, key: str, handle, schema: str) -> DataFrame:
    """``handle`` of each run of rows of one ``key``, its columns given as numpy arrays or lists. A worker
    holds one group and up to FLUSH_ROWS rows or FLUSH_BYTES more."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(table: pa.Table, last: bool):
            keys = np.asarray(table[key].combine_chunks())
            cuts = np.flatnonzero(np.diff(keys)) + 1
            edges = [0, *cuts.tolist(), len(keys)]
            n = len(edges) - 1 - (not last)
            columns = [table[c].combine_chunks() for c in names]
            got = [x for a, b in zip(edges[:n], edges[1 : n + 1]) if b - a > 1 for x in handle(dict(zip(names, (c.slice(a, b - a) for c in columns))))]
            out = np.array(got, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["u", "v"]), table.slice(edges[n])

        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            rows, size = rows + len(batch), size + batch.nbytes
            if rows >= FLUSH_ROWS or size >= FLUSH_BYTES:
                out, rest = flush(pa.Table.from_batches(held), False)
                yield out
                held, rows, size = rest.to_batches(), 0, 0
        if held:
            yield flush(pa.Table.from_batches(held), True)[0]

    spread = df.repartition(F.col(key)).sortWithinPartitions(key)
    return spread.mapInArrow(released(run), schema)


def _registers_of(group: dict) -> np.ndarray:
    return np.frombuffer(b"".join(group["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _join_parts(ids: np.ndarray, rows: np.ndarray, linked) -> list[tuple[int, int]]:
    """A forest over the links that ``linked(k)`` gives for the ``rows``: an edge only where it joins two
    parts that no earlier edge has joined. Rows of one id are one part."""
    part, out = np.unique(ids, return_inverse=True)[1], []
    for k in rows.tolist():
        hits = np.flatnonzero(linked(k))
        parts, first = np.unique(part[hits], return_index=True)
        new = parts != part[k]
        if new.any():
            out += [(int(ids[k]), int(ids[j])) for j in hits[first[new]]]
            part[np.isin(part, parts[new])] = part[k]
    return out


def _star(ids: np.ndarray, rows: list[int]) -> list[tuple[int, int]]:
    """Edges from the smallest id of a part to its others. Tasks that see the same part then give the
    same edges, which are dropped as repeats, and parts are one step deep."""
    own = np.unique(ids[rows]).tolist()
    return [(own[0], x) for x in own[1:]]


def _forest_by_estimate(group: dict) -> list[tuple[int, int]]:
    """Edges that join what the estimates join, a star for each part."""
    ids, sizes, table = np.asarray(group["rep"]), np.asarray(group["n_shingles"]), _registers_of(group)
    left, out = np.arange(len(ids)), []
    while len(left):
        part, left = [int(left[0])], left[1:]
        queue = list(part)
        while queue and len(left):
            k = queue.pop()
            hit = estimate_reaches(table[k], table[left], int(sizes[k]), sizes[left])
            queue += left[hit].tolist()
            part += left[hit].tolist()
            left = left[~hit]
        out += _star(ids, part)
    return out


def _rest_by_estimate(group: dict) -> list[tuple[int, int]]:
    """The same between the rows of the rest (core = 0) and all others."""
    ids, sizes, table = np.asarray(group["rep"]), np.asarray(group["n_shingles"]), _registers_of(group)
    return _join_parts(ids, np.flatnonzero(np.asarray(group["core"]) == 0), lambda k: estimate_reaches(table[k], table, int(sizes[k]), sizes))


class _Overlap:
    """Which sets share enough with one of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        names, self.local = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flag = np.zeros(len(names), np.int32)

    def __call__(self, k: int) -> np.ndarray:
        own = self.local[self.at[k] : self.at[k + 1]]
        self.flag[own] = 1
        both = np.add.reduceat(self.flag[self.local], self.at[:-1])
        self.flag[own] = 0
        return 100 * both >= LINK * (self.sizes + self.sizes[k] - both)


def exact_forest(ids: np.ndarray, sets: list[np.ndarray], core: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges between sets that share enough, a star for each part. With ``core``, only links of rows of the
    rest (core = 0) count."""
    linked = _Overlap(sets)
    if core is not None:
        return _join_parts(ids, np.flatnonzero(core == 0), linked)
    left, out = np.ones(len(ids), bool), []
    for first in range(len(ids)):
        if not left[first]:
            continue
        left[first] = False
        part = [first]
        queue = [first]
        while queue and left.any():
            hits = np.flatnonzero(linked(queue.pop()) & left)
            left[hits] = False
            queue += hits.tolist()
            part += hits.tolist()
        out += _star(ids, part)
    return out


def _sets_of(group: dict) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]


def _forest_exact(group: dict) -> list[tuple[int, int]]:
    return exact_forest(np.asarray(group["rep"]), _sets_of(group))


def _rest_exact(group: dict) -> list[tuple[int, int]]:
    return exact_forest(np.asarray(group["rep"]), _sets_of(group), np.asarray(group["core"]))


def _shingles(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The members (by rep) with their shingle hashes, computed from their texts again."""
    names = [c for c in members.columns if c != "rep"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields if f.name != "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.column_bytes(batch["text"])
            for a, b in B.blocks(off):
                sets = B.shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([batch["rep"].slice(a, b - a), *(batch[c].slice(a, b - a) for c in names), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", *names, "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep IS NOT NULL")
    return texts.join(members, "rep").select("rep", *names, "text").mapInArrow(released(run), f"rep long, {kinds}, shingles binary").where("octet_length(shingles) > 0")


_EDGES = "u long, v long"


def _block(column: str, blocks: str, salt: int):
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.col(blocks))


def _blocks(rows, shingles):
    """Into how many blocks so many rows, of so many shingles in all, are dealt: one if they fit."""
    fit = (rows <= BLOCK) & (shingles <= BLOCK_SHINGLES)
    return F.when(fit, F.lit(1)).otherwise(F.greatest(F.ceil(rows / (BLOCK // 2)), F.ceil(shingles / (BLOCK_SHINGLES // 2)))).cast("long")


def _linked_in_groups(rows: DataFrame, members: DataFrame, payload: list[str], forest, against, scratch: Scratch) -> DataFrame:
    """Edges that join what ``forest`` links inside groups. ``members`` has group, rep, n_shingles and the
    blocks of the group; ``rows`` has group, rep, blocks and the payload that is compared.

    A group of one block is compared whole. A larger one is dealt into blocks twice, which joins nearly
    all of what belongs together; then every row outside its largest part meets every row of the group,
    block by block, so no link between different parts stays unseen. Tasks emit forests, never pairs.
    """
    tasks = F.when(F.col("blocks") == 1, F.array(F.xxhash64("group"))).otherwise(F.array(*[F.xxhash64("group", F.lit(s), _block("rep", "blocks", s)) for s in (2, 3)]))
    edges = scratch.cut(_grouped(rows.select(F.explode(tasks).alias("task"), "rep", *payload), "task", forest, _EDGES), "edges")
    large = members.where("blocks > 1")
    if not large.limit(1).count():
        return edges
    found = scratch.cut(components(edges), "found").withColumnRenamed("node", "rep")
    parts = large.join(found, "rep", "left").select("group", "rep", "blocks", "n_shingles", F.coalesce("component", "rep").alias("part"))
    parts = scratch.cut(parts, "parts")
    counts = parts.groupBy("group", "part").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("w"))
    core = counts.groupBy("group").agg(F.max_by("part", F.struct("c", "part")).alias("core"), F.max(F.struct("c", "part", "w")).alias("most"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    core = core.where("most.c < c").select("group", "core", _blocks(F.col("c") - F.col("most.c"), F.col("w") - F.col("most.w")).alias("rest_blocks"))
    todo = scratch.cut(parts.join(core, "group").select("rep", "group", (F.col("part") == F.col("core")).cast("int").alias("core"), "rest_blocks"), "rest")
    if not todo.limit(1).count():
        return edges
    both = rows.join(todo, ["group", "rep"])
    own, rest = _block("rep", "blocks", 4), _block("rep", "rest_blocks", 5)
    # every row is once among all rows (core = 1) before each block of the rest; the rest comes before each block
    as_all = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rest_blocks") - 1), lambda x: F.struct(F.xxhash64("group", own, x).alias("task"), F.lit(1).alias("core")))
    as_rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.xxhash64("group", x, rest).alias("task"), F.lit(0).alias("core")))
    dealt = both.select(F.explode(F.when(F.col("core") == 1, as_all).otherwise(F.concat(as_all, as_rest))).alias("x"), "rep", *payload).select("x.task", "rep", *payload, "x.core")
    return edges.unionByName(_grouped(dealt, "task", against, _EDGES))


def candidate_edges(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges that join all pairs of representatives which share a band and pass the estimate. Buckets of
    one row go first."""
    keys = scratch.cut(_band_keys(reps).withColumnRenamed("key", "group"), "bands")
    shared = scratch.cut(keys.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", _blocks(F.col("n"), F.lit(0))), "shared")
    members = join_by_key(keys, shared.select("group", "blocks"), ["group"], shared.select("group", "n"), False, "inner").withColumn("n_shingles", F.lit(0).cast("long"))
    members = scratch.cut(members, "members")
    rows = members.drop("n_shingles").join(reps.select("rep", "n_shingles", "registers"), "rep")
    return _linked_in_groups(rows, members, ["n_shingles", "registers"], _forest_by_estimate, _rest_by_estimate, scratch)


def exact_edges(docs: DataFrame, reps: DataFrame, clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges that join what exact comparison links, inside the clusters (node, component)."""
    named = scratch.cut(clusters.select(F.col("node").alias("rep"), F.col("component").alias("group")).join(reps.groupBy("rep").agg(F.sum("n_shingles").alias("n_shingles")), "rep"), "clustered")
    sizes = named.groupBy("group").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("blocks"))
    members = scratch.cut(named.join(sizes, "group"), "clusters")
    sets = scratch.cut(_shingles(docs, members), "shingles")
    return _linked_in_groups(sets, members, ["shingles"], _forest_exact, _rest_exact, scratch)


_CLASS = ["d1", "d2", "n_shingles"]


def near_duplicates(docs: DataFrame, lasting: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document. ``lasting`` gets the tables that the result
    reads.

    Texts of equal sets form a class, stood for by its smallest doc_id; classes are sketched, banded,
    estimated and checked on full sets. A document without words has an empty set and is linked with
    nothing. Rows of one doc_id are one document for links. A null doc_id takes the component of its
    class, or null where the class has no other id, and is always kept. Empty in, empty out.
    """
    spark = docs.sparkSession
    scratch, lasting = Scratch(spark), lasting or Scratch(spark)
    with bounded_batches(spark):  # all jobs that hand rows to Python run in here
        table = lasting.cut(sketch(docs), "sketches")
        named = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = named.groupBy(*_CLASS).agg(F.min("doc_id").cast("long").alias("rep"), F.first("registers").alias("registers"), F.count("*").alias("n"))
        classes = scratch.cut(classes, "classes")
        clusters = scratch.cut(components(candidate_edges(classes, scratch)), "candidates")
        found = components(exact_edges(docs, classes, clusters, scratch)).select(F.col("node").alias("rep"), F.col("component"))
        known = lasting.cut(classes.join(found, "rep", "left").select(*_CLASS, F.coalesce("component", "rep").alias("component"), "n"), "known")
    full = table.where("n_shingles > 0").select("doc_id", *_CLASS)
    out = join_by_key(full, known.drop("n"), _CLASS, known.select(*_CLASS, "n"), known.count() <= MOST_CLASSES).select("doc_id", "n_shingles", "component")
    # empty sets are linked with nothing, so they don't meet in the join
    out = out.unionByName(table.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    scratch.clear()
    component = F.coalesce("component", F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay: the smallest doc_id of each component, and those without a doc_id;
    columns as they were. Rows of one doc_id stay or go together, but of those that repeat their words
    one stays, the same in every run."""
    lasting = Scratch(docs.sparkSession)
    found = cut(near_duplicates(docs, lasting), "near-duplicates").where("doc_id IS NOT NULL")
    lasting.clear()
    gone = found.where("NOT kept").select("doc_id").distinct()
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)  # else Spark joins by a shuffle
    out = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = found.where("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.limit(1).count():
        return out
    repeated = cut(repeated, "repeated")
    words, row = free_names(docs.columns, "words", "row")
    blank = "[\\x20\\x09-\\x0D]+"
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    mine = out.join(repeated, "doc_id", "left_semi").withColumn(words, F.trim(F.regexp_replace(lower, blank, " ")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    full = F.coalesce(F.col(words), F.lit("")) != ""
    one = mine.where(full).groupBy("doc_id", words).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(row)).select(*[F.col(row)[c].alias(c) for c in docs.columns])
    return out.join(repeated, "doc_id", "left_anti").unionByName(one).unionByName(mine.where(~full).drop(words)).select(*[F.col(f"`{c}`") for c in docs.columns])
