"""Best-fit packing of documents into sequences by a linear grouping scheme."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytesops as B
from .shared import bounded_batches, cut, released
from .tokens import default_tokenizer_path, encoder

CAPACITY = 1024
END_ID = 2
#: Schemes that are tried: groups of large lengths, and the part of a sequence above which one is large.
SCHEMES = ((60, 1 / 6), (120, 1 / 3), (160, 0.45))


def encode_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with the partition that made it and the
    piece's rank in it among pieces of its length. Null text is empty: the end id alone."""
    tokenizer = tokenizer or default_tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, off = B.column_bytes(batch["text"])
            for a, b in B.blocks(off):
                ids, at = coder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                total = np.diff(at)
                n = -(-total // capacity)
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = total - capacity * (n - 1)
                length = np.where(piece == 0, head[doc], capacity)
                start = np.where(piece == 0, 0, head[doc] + capacity * (piece - 1))
                raw = memoryview(ids).cast("B")
                begin = (at[doc] + start).tolist()
                sums = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(begin, length.tolist())]
                order = np.argsort(length, kind="stable")
                run = length[order]
                first = np.searchsorted(run, run)
                rank = np.empty(len(run), np.int64)
                rank[order] = np.arange(len(run)) - first + seen[run]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return docs.select("doc_id", "text").mapInArrow(released(encode), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def _fullest(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most."""
    best = np.zeros(capacity + 1)
    choices = []
    for _ in range(capacity // int(sizes.min())):
        options = np.full((len(sizes) + 1, capacity + 1), -1.0)
        options[-1] = best
        for k, s in enumerate(sizes.tolist()):
            options[k, s:] = best[: capacity + 1 - s] + values[k]
        pick = options.argmax(axis=0)
        choices.append(pick)
        new = options[pick, np.arange(capacity + 1)]
        if np.array_equal(new, best):
            break
        best = new
    out, c = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(choices):
        k = int(pick[c])
        if k < len(sizes):
            out[k] += 1
            c -= int(sizes[k])
    return float(values @ out), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Patterns of the few sizes and how often each is used, by column generation; the fractional
    optimum is rounded down, so a little of the demand may be left."""
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(basis)
    for _ in range(60 * len(sizes)):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, column = _fullest(np.maximum(price, 0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leaving = int(ratio.argmin())
        basis[:, leaving] = column
        amount = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(int(x + 1e-6), basis[:, k].astype(np.int64)) for k, x in enumerate(amount) if int(x + 1e-6)]


def plan_scheme(counts: np.ndarray, capacity: int, groups: int, large: float) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of bins for ``counts[length]`` pieces: how many bins of the kind, and what each holds as
    (length, how many). The plan's size follows the number of lengths, not of pieces.

    Large lengths in falling order form groups of equal cardinality (single pieces, where there are fewer
    pieces than groups), each rounded up to its largest;
    the best configurations of the few sizes are filled with the real lengths; what is left and the
    small lengths go, longest first, where they leave the least room.
    """
    left = counts.astype(np.int64).copy()
    kinds: list[tuple[int, list[tuple[int, int]]]] = []
    if left[capacity]:
        kinds.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    lengths = np.arange(capacity - 1, int(large * capacity), -1)
    total = int(left[lengths].sum())
    open_bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(count: int, items: list[tuple[int, int]], room: int) -> None:
        if count:
            open_bins.setdefault(room, []).append((count, items))

    if total:
        groups = min(groups, total)
        ends = np.cumsum(left[lengths])
        cuts = np.unique((np.arange(1, groups + 1) * total) // groups)
        begin = np.concatenate([[0], cuts[:-1]])
        size = lengths[np.searchsorted(ends, begin, "right")]
        same = np.concatenate([[True], size[1:] != size[:-1]])
        begin, size = begin[same], size[same]
        demand = np.diff(np.append(begin, total))
        taken = begin.copy()  # the next piece of each group, in falling order
        for times, pattern in configurations(size, demand.astype(float), capacity):
            slots = [g for g in range(len(size)) for _ in range(pattern[g])]
            times = min([times, *(int((begin[g] + demand[g] - taken[g]) // pattern[g]) for g in set(slots))])
            if times <= 0:
                continue
            starts = []
            for g in slots:
                starts.append(int(taken[g]))
                taken[g] += times
            # bins of the pattern in runs over which every slot keeps one length
            borders = {0, times}
            for s in starts:
                inner = ends[(ends > s) & (ends < s + times)]
                borders.update((inner - s).tolist())
            marks = sorted(borders)
            for x, y in zip(marks[:-1], marks[1:]):
                own = [int(lengths[np.searchsorted(ends, s + x, "right")]) for s in starts]
                np.subtract.at(left, own, y - x)
                put(y - x, [(v, 1) for v in own], capacity - sum(own))
    for length in range(capacity - 1, 0, -1):
        need = int(left[length])
        while need:
            room = min((r for r in open_bins if r >= length), default=0)
            if room:
                count, items = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            else:
                room, items = capacity, []
                count = max(1, need // (capacity // length))
            each = min(room // length, need)
            used = min(count, need // each)
            put(count - used, items, room)
            put(used, [*items, (length, each)], room - each * length)
            need -= used * each
    return kinds + [kind for room in sorted(open_bins) for kind in open_bins[room]]


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """The plan of the scheme that needs the fewest bins."""
    return min((plan_scheme(counts, capacity, g, x) for g, x in SCHEMES), key=lambda kinds: sum(k[0] for k in kinds))


def slots(kinds: list[tuple[int, list[tuple[int, int]]]], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, how many a sequence), sorted by the first two."""
    rows, sequence, rank = [], 0, np.zeros(capacity + 1, np.int64)
    for count, items in kinds:
        offset = 0
        for length, each in items:
            rows.append((length, rank[length], sequence, offset, each))
            rank[length] += count * each
            offset += length * each
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Only documents longer than the capacity are cut; the first piece takes what full ones leave. The
    driver gets one count for each length. Each piece finds its slot by its rank among the pieces of
    its length, which is a running sum over the partitions' counts and the rank inside a partition, so
    no length is gathered in one task. Repeated rows are packed each; an empty table gives no rows.
    """
    with bounded_batches(docs.sparkSession):
        pieces = cut(encode_pieces(docs, capacity, end_id, tokenizer), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        totals[r["length"]] = r["n"]
    table = pieces.sparkSession.sparkContext.broadcast(slots(plan_bins(totals, capacity), capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = table.value
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch[c]) for c in ("length", "rank"))
            k = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            bins, place = np.divmod(rank - plan[k, 1], plan[k, 4]) if len(k) else (rank, rank)
            sequence, offset = plan[k, 2] + bins, plan[k, 3] + place * length
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    seated = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return seated.mapInArrow(released(seat), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
