"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests; SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

#: Cells in each of a fingerprint's three tables; only those in use are kept.
CELLS = 64
ROUNDS = 40
#: A paragraph is a line, or, in longer ones, a run of sentences of at least so many characters.
LEAST_PART = 150
#: Text bytes that a bucket of neighbouring ids is to hold. Buckets are runs of cells of equal width in the
#: range of ids; cells are a little finer than buckets, up to MOST_CELLS (a row of 40 bytes each, broadcast),
#: beyond which they grow with the text.
BUCKET_BYTES = 2 << 20
CELL_BYTES = 1 << 20
MOST_CELLS = 1 << 19
#: A cell of one id alone that holds more than a bucket is split by its texts' hashes into so many.
SPLITS = 256
_CHECK = 16777215  # 24 bits


def paragraphs(text: str) -> str:
    """The paragraphs of a text, an SQL expression."""
    pattern = f"[^\\\\n]{{{LEAST_PART},}}?[.!?](?= )|[^\\\\n]+"
    return f"filter(transform(regexp_extract_all({text}, '{pattern}', 0), p -> trim(p)), p -> p <> '')"


def keys(text: str) -> str:
    """The distinct paragraph digests: 39 bits of hash above 24 bits that check them."""
    digest = f"transform({paragraphs(text)}, p -> shiftrightunsigned(xxhash64(p), 25))"
    return f"array_distinct(transform({digest}, h -> shiftleft(h, 24) | (xxhash64(h) & {_CHECK})))"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _entries(signed: str, cells: str, sign: int) -> str:
    """Each key in one cell of each of three tables; a negative key counts -1."""
    cell = lambda t: f"struct(cast({t} * {cells} + pmod(xxhash64(abs(v), {t}), {cells}) AS int) AS j, {sign} * cast(signum(v) AS int) AS n, abs(v) AS k)"
    return f"flatten(transform({signed}, v -> array({', '.join(map(cell, range(3)))})))"


def _merge(entries: str) -> str:
    """The sum of n and xor of k of each cell j, without the cells that come to nothing."""
    last = "IF(a.n = 0 AND a.k = 0, a.c, array_append(a.c, struct(a.j AS j, a.n AS n, a.k AS k)))"
    step = f"IF(e.j = a.j, struct(a.c AS c, a.j AS j, a.n + e.n AS n, a.k ^ e.k AS k), struct({last} AS c, e.j AS j, e.n AS n, e.k AS k))"
    start = "struct(array_repeat(struct(0 AS j, 0 AS n, 0L AS k), 0) AS c, -1 AS j, 0 AS n, 0L AS k)"
    return f"aggregate(sort_array({entries}), {start}, (a, e) -> {step}, a -> {last})"


def sketch(key_array: str, cells: str) -> str:
    return _merge(_entries(key_array, cells, 1))


def subtract(a: str, b: str) -> str:
    return _merge(f"concat({a}, transform({b}, x -> struct(x.j AS j, -x.n AS n, x.k AS k)))")


def _pure(cells: str) -> str:
    """The keys, with the sign of their count, of cells that hold one key alone."""
    ok = f"filter({cells}, x -> abs(x.n) = 1 AND (x.k & {_CHECK}) = (xxhash64(shiftrightunsigned(x.k, 24)) & {_CHECK}))"
    return f"array_distinct(transform({ok}, x -> x.n * x.k))"


def peel(difference: str, cells: str) -> str:
    """(whether all keys came out, the keys with their sign): cells of one key give it up, which is
    then taken from its other cells, until no such cell is left."""
    first = _let(difference, "d", f"struct(d AS d, {_pure('d')} AS p, array_repeat(0L, 0) AS f)")
    taken = _merge(f"concat(s.d, {_entries('s.p', cells, -1)})")
    step = _let(taken, "d", f"struct(d AS d, {_pure('d')} AS p, concat(s.f, s.p) AS f)")
    loop = f"aggregate(sequence(1, {ROUNDS}), {first}, (s, i) -> IF(size(s.p) = 0, s, {step}))"
    return _let(loop, "e", "struct(size(e.d) = 0 AS whole, e.f AS keys)")


def difference(a: str, b: str, cells: str) -> str:
    """The digests that one of two key arrays has (positive) and the other lacks (negative), as
    recovered from the difference of their sketches of that many cells; null where it can't be peeled."""
    return _let(peel(subtract(sketch(a, cells), sketch(b, cells)), cells), "w", "IF(w.whole, w.keys, NULL)")


def likeness(a: str, b: str, own_a: str, own_b: str) -> str:
    """Shared over all distinct paragraphs, from the recovered difference. ``own_a`` and ``own_b`` are
    the fingerprints; where their difference can't be peeled, larger sketches are tried."""
    both = f"(size({a}) + size({b}))"

    def count(cells_of_difference: str, cells: str) -> str:
        return _let(peel(cells_of_difference, cells), "w", "IF(w.whole, size(w.keys), NULL)")

    tries = [count(subtract(own_a, own_b), str(CELLS))]
    for cells in (str(4 * CELLS), f"greatest({16 * CELLS}, {both})", f"(2 * {both} + {32 * CELLS})"):
        tries.append(count(subtract(sketch(a, cells), sketch(b, cells)), cells))
    exact = f"size(array_except({a}, {b})) + size(array_except({b}, {a}))"  # where even the largest can't be peeled
    found = _let(f"coalesce({', '.join([*tries, exact])})", "v", f"cast({both} - v AS double) / ({both} + v)")
    return f"IF({a} = {b}, 1D, {found})"


def as_text(cells: str) -> str:
    return f"array_join(transform({cells}, x -> concat(x.j, ':', x.n, ':', lower(hex(x.k)))), ',')"


def _cells(docs: DataFrame) -> tuple[DataFrame, DataFrame, Column, Column]:
    """The cells that ``docs`` (doc_id, text) falls in: cell, bucket, before (the bucket before, the last
    one before the first) and the bucket's first row as (first_id, first_hash); the cells of the grid that
    are split; and a row's cell of the grid and, given its hash and split, its cell.

    Rows are ordered by id, null first, then by the hash of the text and the text. The driver gets the
    range of the ids and the size of all texts.
    """
    id_ = F.col("doc_id").cast("long")
    r = docs.agg(F.min(id_).alias("a"), F.max(id_).alias("b"), F.sum(F.octet_length("text")).alias("n")).first()
    low, width = r["a"] or 0, (r["b"] or 0) - (r["a"] or 0) + 1
    step = max(1, -(-width // max(16, min(MOST_CELLS // 2, (r["n"] or 0) // CELL_BYTES))))
    # null ids are cell -1; the parts of a split cell follow one another
    exact = (lambda c: c) if width < 1 << 53 else (lambda c: c.cast("decimal(38,0)"))
    grid = F.coalesce(F.floor((exact(id_) - exact(F.lit(low))) / exact(F.lit(step))), F.lit(-1)).cast("long")
    part = F.shiftright(F.col("hash"), 56) + F.lit(SPLITS // 2)
    light = docs.select(grid.alias("grid"), id_.alias("id"), F.xxhash64("text").alias("hash"), F.octet_length("text").alias("n"))
    whole = light.groupBy("grid").agg(F.sum("n").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.count("id").alias("ids"))
    alone = whole.where((F.col("n") > BUCKET_BYTES) & ((F.col("a") == F.col("b")) | (F.col("ids") == 0))).select("grid").orderBy(F.desc("n")).limit(MOST_CELLS // SPLITS // 2)
    split = cut(alone.withColumn("split", F.lit(True)), "split-cells")
    cell = F.col("grid") * SPLITS + F.when(F.col("split"), part).otherwise(0)
    fine = light.join(F.broadcast(split), "grid", "left").withColumn("cell", cell)
    cells = fine.groupBy("cell").agg(F.sum("n").alias("n"), F.min(F.struct("id", "hash")).alias("first"))
    # running sums over cells, whose number is bounded
    order = Window.orderBy("cell")
    sums = cells.withColumn("bucket", F.floor((F.sum("n").over(order) - F.col("n")) / BUCKET_BYTES))
    turn = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(turn), F.last("bucket").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    buckets = sums.groupBy("bucket").agg(F.min_by("first", "cell").alias("first")).withColumn("before", before)
    buckets = buckets.select("bucket", "before", F.col("first.id").alias("first_id"), F.col("first.hash").alias("first_hash"))
    return cut(sums.select("cell", "bucket").join(buckets, "bucket"), "id-cells"), split, grid, cell


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and own keys with the text and keys of the next document (__next, __next_keys) by
    ascending doc_id, after the last the first.

    Rows go to buckets of neighbouring ids, so texts are shuffled once; the first row of each bucket
    is also sent to the one before. Null ids come first; equal ids go by the texts' hashes, then by text.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cells, split, grid, cell = _cells(docs)
    placed = docs.withColumns({"grid": grid, "hash": F.xxhash64("text")}).join(F.broadcast(split), "grid", "left").withColumn("cell", cell)
    placed = placed.join(F.broadcast(cells), "cell")
    is_first = F.col("doc_id").cast("long").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    dealt = placed.select("doc_id", "text", "hash", F.posexplode(F.array_compact(F.array("bucket", F.when(is_first, F.col("before"))))).alias("extra", "bucket"))
    # the parts of a fingerprint are computed once a row, after the shuffle
    spread = dealt.repartition("bucket").withColumn("keys", F.expr(keys("text"))).withColumn("cells", F.expr(sketch("keys", str(CELLS))))
    window = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").asc_nulls_first(), "hash", "text")
    following = F.lead(F.struct("text", "keys", "cells")).over(window)
    return spread.withColumn("next", following).where("extra = 0").select("doc_id", "text", "keys", "cells", F.col("next.text").alias("next_text"), F.col("next.keys").alias("next_keys"), F.col("next.cells").alias("next_cells"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n / 2) code points replaced by as many of the next
    document's first (or all). Null text is empty. Likeness is shared over all distinct paragraphs, 1
    where both have none. Repeated rows each have their own; an empty table gives no rows.
    """
    rows = with_next(docs)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 AS int)), left(next_text, cast(n_chars div 2 AS int)))"))
    rows = rows.withColumn("edited_keys", F.expr(keys("edited"))).withColumn("edited_cells", F.expr(sketch("edited_keys", str(CELLS))))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(as_text("cells")).alias("fingerprint"),
        F.expr(as_text("edited_cells")).alias("edited_fingerprint"),
        F.expr(likeness("keys", "edited_keys", "cells", "edited_cells")).alias("near_edited"),
        F.expr(likeness("keys", "next_keys", "cells", "next_cells")).alias("near_next"),
    )
