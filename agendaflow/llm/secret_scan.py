"""Secrets in texts: three patterns, and tokens that pass a battery of randomness tests."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import bounded_batches, cut, released

#: The patterns of the base kinds, and the characters that a match or its group 2 must have.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: The order of kinds that start at one place; ``random`` is what the tests add.
KINDS = ("assign", "access", "hex", "random")

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: An encoding: its alphabets in the order of their symbols' values. The first that has all of a token's
#: characters is inferred; both cases of hex and of base 36 share their statistics.
ENCODINGS = {"hex": (DIGITS + "abcdef", DIGITS + "ABCDEF"), "base32": (UPPER + "234567",), "base36": (DIGITS + LOWER, DIGITS + UPPER), "base64": (UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", UPPER + LOWER + DIGITS + "+/-_")}
SIZES = [len(alphabets[0]) for alphabets in ENCODINGS.values()]
#: Token lengths that share their statistics, by the least of each class.
LENGTHS = (20, 24, 32, 48, 64, 128)
#: Classes of the combined probability: eighths of an octave below 1.
BINS = 64
CODES = len(ENCODINGS) * len(LENGTHS) * BINS
#: Stretches whose symbols are counted at once.
AT_ONCE = 4096
#: The part of the added tokens that may be ordinary text.
FALSE_DISCOVERIES = 0.01

SPAN = "struct<start:int,kind:int,end:int>"
FOUND = "struct<start:int,kind:int,end:int,cell:int,bin:int>"
PLAIN = "struct<code:int,n:bigint>"


def _symbols(alphabets: tuple[str, ...], fold: bool = False) -> np.ndarray:
    """The value of each byte in an encoding, -1 for others; ``fold``: letters of the other case too."""
    out = np.full(256, -1, np.int64)
    for a in alphabets:
        for k, c in enumerate(a):
            out[ord(c)] = min(k, len(alphabets[0]) - 1) if len(a) > len(alphabets[0]) else k
    if fold:
        for upper, lower in zip(UPPER, LOWER):
            out[ord(upper)] = out[ord(lower)] = max(out[ord(upper)], out[ord(lower)])
    return out


#: What a token needs to be in an encoding, and how ordinary text is read in it.
TABLES = [(k, _symbols((a,)) if len(a) == SIZES[k] else _symbols(alphabets)) for k, alphabets in enumerate(ENCODINGS.values()) for a in alphabets]
STREAMS = [_symbols(alphabets, fold=name != "base64") for name, alphabets in ENCODINGS.items()]
IS_TOKEN = np.zeros(256, bool)
IS_TOKEN[[ord(c) for c in UPPER + LOWER + DIGITS + "+/_=-"]] = True
IS_HEX = np.zeros(256, bool)
IS_HEX[[ord(c) for c in DIGITS + "abcdef"]] = True


def _tail(z: np.ndarray) -> np.ndarray:
    """The probability that a standard normal value exceeds each of ``z``."""
    return np.fromiter((0.5 * math.erfc(x / math.sqrt(2)) for x in z.tolist()), np.float64, len(z))


def _chi_tail(squares: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of chi-squared for uniform use of the alphabet, in Wilson and Hilferty's normal form; ``squares`` adds up the
    squares of the symbols' counts."""
    chi = size / n * squares.astype(np.float64) - n
    v = 2 / (9 * (size - 1))
    return _tail((np.cbrt(chi / (size - 1)) - (1 - v)) / math.sqrt(v))


def _runs_tail(above: np.ndarray, changes: np.ndarray, n: int) -> np.ndarray:
    """Of the number of runs above and below the alphabet's middle; ``changes`` is one less than it."""
    above = above.astype(np.float64)
    both = 2 * above * (n - above)
    spread = np.sqrt(np.maximum(both * (both - n), 0) / (n * n * (n - 1)))
    return 2 * _tail(np.abs(np.where(spread > 0, (changes - both / n) / np.where(spread > 0, spread, 1), math.sqrt(n))))


def _serial_tail(total: np.ndarray, squares: np.ndarray, products: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Of the correlation of neighbours, by the sums of the values, of their squares, of the neighbours' products and
    of the first and last value."""
    total, squares, products, ends = (x.astype(np.float64) for x in (total, squares, products, ends))
    spread = n * (n * squares - total * total)
    r = np.where(spread > 0, (n * n * products - n * total * (2 * total - ends) + (n - 1) * total * total) / np.where(spread > 0, spread, 1), 1.0)
    return 2 * _tail(np.abs(r + 1 / n) * math.sqrt(n))


def _fisher(*tails: np.ndarray) -> np.ndarray:
    half = -sum(np.log(np.maximum(q, 1e-300)) for q in tails)
    return np.exp(-half) * (1 + half + half * half / 2)


def _squares(x: np.ndarray, size: int) -> np.ndarray:
    """For each row the sum of the squares of its symbols' counts."""
    count = np.bincount((np.arange(len(x))[:, None] * size + x).ravel(), minlength=len(x) * size).reshape(len(x), size)
    return np.einsum("ij,ij->i", count, count)


def randomness(x: np.ndarray, size: int) -> np.ndarray:
    """For each row of symbol values below ``size``: the probability that independent, uniform symbols
    look less random than it, by Fisher's combination of three tests: use of the alphabet, runs and the correlation
    of neighbours.
    """
    x, n = x.astype(np.int64), x.shape[1]
    high = x >= size / 2
    return _fisher(
        _chi_tail(_squares(x, size), size, n),
        _runs_tail(high.sum(axis=1), (high[:, 1:] != high[:, :-1]).sum(axis=1), n),
        _serial_tail(x.sum(axis=1), (x * x).sum(axis=1), (x[:, 1:] * x[:, :-1]).sum(axis=1), x[:, 0] + x[:, -1], n),
    )


@functools.cache
def _tables(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two tests' probabilities by the sum of squares, and by above * n + changes; for the few lengths of
    stretches."""
    above, changes = np.divmod(np.arange((n + 1) * n), n)
    return _chi_tail(np.arange(n * n + 1), size, n), _runs_tail(above, changes, n)


def stretches(at: np.ndarray, n: int) -> np.ndarray:
    """Starts of stretches of ``n`` that together cover the rows whose offsets are ``at``: one after the other, and one
    at the row's end if a rest is left. Rows of fewer have none."""
    have = np.diff(at)
    long = have >= n
    first, have = at[:-1][long], have[long]
    number = -(-have // n)
    k = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    return np.repeat(first, number) + np.minimum(k * n, np.repeat(have - n, number))


class Sums:
    """Symbol values below ``size`` with running sums, from which stretches of any length are tested."""

    def __init__(self, x: np.ndarray, size: int):
        # in 32 bits: a difference is right even if the sums wrap
        run = lambda v: np.append(np.int32(0), np.cumsum(v, dtype=np.int32))
        self.x, self.size = x, size
        high = (x >= size / 2).astype(np.int8)
        pad = lambda v: np.append(np.zeros(min(1, len(x)), v.dtype), v)  # noqa: E731  nothing is before the first symbol
        self.above, self.changes, self.total, self.squares, self.products = run(high), run(pad(high[1:] != high[:-1])), run(x), run(x * x), run(pad(x[1:] * x[:-1]))

    def randomness(self, starts: np.ndarray, n: int) -> np.ndarray:
        """``randomness`` of the stretches of ``n`` symbols from ``starts``."""
        inside = lambda v, skip=0: v[starts + n] - v[starts + skip]
        chi, runs = _tables(self.size, n)
        symbols = np.arange(n)
        squares = np.concatenate([_squares(self.x[starts[k : k + AT_ONCE, None] + symbols], self.size) for k in range(0, len(starts), AT_ONCE)])
        serial = _serial_tail(inside(self.total), inside(self.squares), inside(self.products, 1), self.x[starts] + self.x[starts + n - 1], n)
        return _fisher(chi[squares], runs[inside(self.above) * n + inside(self.changes, 1)], serial)


def bins(p: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(BINS + 8 * np.log2(np.maximum(p, 1e-300))), 0, BINS - 1).astype(np.int64)


def cell(encoding: int, length: np.ndarray) -> np.ndarray:
    return encoding * len(LENGTHS) + np.searchsorted(LENGTHS, length, "right") - 1


def inferred(token: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The encoding of a token's bytes and their values; None for numbers, which encode no secret."""
    if not ((token < 48) | (token > 57)).any():
        return None
    for k, table in TABLES:
        x = table[token]
        if x.min() >= 0:
            return k, x
    return None


def _candidates(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(number of the token, cell, bin) of the tokens that an encoding has; equal lengths are tested together."""
    groups: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        if known := inferred(data[a:b]):
            numbers, rows = groups.setdefault((known[0], b - a), ([], []))
            numbers.append(k)
            rows.append(known[1])
    out = []
    for (encoding, n), (numbers, rows) in groups.items():
        c = int(cell(encoding, np.array([n]))[0])
        out += [(k, c, b) for k, b in zip(numbers, bins(randomness(np.stack(rows), SIZES[encoding])).tolist())]
    return out


def _ordinary(data: np.ndarray, off: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """How many stretches of the rows' ordinary text have each code (cell * BINS + bin): the whole text without its
    long tokens, read in each encoding and cut into stretches of each length."""
    count = np.zeros(CODES, np.int64)
    for encoding, table in enumerate(STREAMS):
        x = table[data]
        where = np.flatnonzero(ordinary & (x >= 0))
        sums, at = Sums(x[where], SIZES[encoding]), np.searchsorted(where, off)
        for k, n in enumerate(LENGTHS):
            starts = stretches(at, n)
            if len(starts):
                first = (encoding * len(LENGTHS) + k) * BINS
                count[first : first + BINS] += np.bincount(bins(sums.randomness(starts, n)), minlength=BINS)
    return count


def base_spans(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(row, start, kind, end) of the base matches, in bytes of the block, ordered."""
    found = []
    raw, low = data.tobytes(), B.LOWER[data].tobytes()

    def rows_with(text: bytes, words: tuple[bytes, ...]) -> list[int]:
        hits = []
        for word in words:
            p = text.find(word)
            while p >= 0:
                hits.append(p)
                p = text.find(word, p + 1)
        return np.unique(np.searchsorted(off, np.array(hits, np.int64), "right") - 1).tolist()

    for row in rows_with(low, KEYWORDS):
        found += [(row, m.start(), 0, m.end()) for m in ASSIGN.finditer(raw, off[row], off[row + 1]) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    for row in rows_with(raw, (b"AKIA",)):
        found += [(row, m.start(), 1, m.end()) for m in ACCESS.finditer(raw, off[row], off[row + 1]) if m.end() - m.start() >= LEAST_ACCESS]
    starts, ends = B.runs(IS_HEX[data], off)
    long = np.flatnonzero(ends - starts >= LEAST_HEX)
    row = np.searchsorted(off, starts[long], "right") - 1
    out = np.concatenate([np.array(found, np.int64).reshape(-1, 4), np.stack([row, starts[long], np.full(len(long), 2), ends[long]], axis=1)])
    return out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]


def _lists(row: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)


def _structs(names: list[str], columns: list[np.ndarray]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names)


def _scan_block(data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    """Base spans and tokens with their cells and bins, a list each row, and in the first row's list how many stretches
    of the block's ordinary text have each code."""
    n = len(off) - 1
    points = np.zeros(len(data) + 1, np.int64)  # code points before each byte
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    base = base_spans(data, off)
    starts, ends = B.runs(IS_TOKEN[data], off)
    long = ends - starts >= LENGTHS[0]
    starts, ends = starts[long], ends[long]
    ordinary = np.ones(len(data) + 1, np.int64)
    np.add.at(ordinary, starts, -1)
    np.add.at(ordinary, ends, 1)
    ordinary = np.cumsum(ordinary - np.append(0, np.ones(len(data), np.int64)))[:-1] > 0
    for k in range(len(ends)):  # padding is no symbol
        while ends[k] > starts[k] and data[ends[k] - 1] == 61:
            ends[k] -= 1
    long = ends - starts >= LENGTHS[0]
    starts, ends = starts[long], ends[long]
    row = np.searchsorted(off, starts, "right") - 1
    tested = np.array(sorted(_candidates(data, starts, ends)), np.int64).reshape(-1, 3)
    own = row[tested[:, 0]]
    at, to = starts[tested[:, 0]], ends[tested[:, 0]]
    # a token that touches a base span is found already; it still counts among the tested ones
    touch = np.zeros(len(tested), bool)
    if len(base):
        marks = np.zeros(len(data) + 1, np.int64)
        np.add.at(marks, base[:, 1], 1)
        np.add.at(marks, base[:, 3], -1)
        covered = np.append(0, np.cumsum(np.cumsum(marks)[:-1] > 0))
        touch = covered[to] > covered[at]
    plain = _ordinary(data, off, ordinary)
    codes = np.flatnonzero(plain)
    shift = points[off[:-1]]
    return [
        _lists(base[:, 0], n, _structs(["start", "kind", "end"], [points[base[:, 1]] - shift[base[:, 0]], base[:, 2], points[base[:, 3]] - shift[base[:, 0]]])),
        _lists(own, n, _structs(["start", "kind", "end", "cell", "bin"], [points[at] - shift[own], np.where(touch, -1, 3), points[to] - shift[own], tested[:, 1], tested[:, 2]])),
        _lists(np.zeros(len(codes), np.int64), n, pa.StructArray.from_arrays([pa.array(codes.astype(np.int32)), pa.array(plain[codes])], ["code", "n"])),
    ]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base, tested and ordinary of every row, written: one pass over the whole texts. ``ordinary`` are counts of
    a block of rows, which stand in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.column_bytes(batch["text"])
            for a, b in B.blocks(off):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *_scan_block(data[off[a] : off[b]], off[a : b + 1] - off[a])], ["doc_id", "base", "tested", "ordinary"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    with bounded_batches(docs.sparkSession):
        return cut(docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, base array<{SPAN}>, tested array<{FOUND}>, ordinary array<{PLAIN}>"), "secrets")


def thresholds(tested: dict[tuple[int, int], int], ordinary: dict[tuple[int, int], int], rate: float = FALSE_DISCOVERIES) -> list[int]:
    """For each cell the least bin from which tokens are secrets, BINS where none are.

    A token's p-value is the part of its cell's ordinary stretches that look as random as it; Benjamini and
    Hochberg's step-up rule holds the false discoveries below ``rate`` in each cell, so in short tokens,
    which ordinary text often resembles, it asks for more than in long ones.
    """
    out = []
    for c in range(len(ENCODINGS) * len(LENGTHS)):
        seen, plain = (np.array([x.get((c, b), 0) for b in range(BINS)])[::-1].cumsum()[::-1] for x in (tested, ordinary))
        p = (1 + plain) / (1 + plain[0])
        good = np.flatnonzero((seen > 0) & (p * seen[0] <= rate * seen))
        out.append(int(good[0]) if len(good) else BINS)
    return out


def _counts(column: DataFrame) -> dict[tuple[int, int], int]:
    return {(r["cell"], r["bin"]): r["n"] for r in column.groupBy("cell", "bin").agg(F.sum("n").alias("n")).collect()}


def _shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every row.

    Spans are kind:start:end in code points, end exclusive, by start and kind. The base kinds are matched
    leftmost and without overlap each; ``random`` are runs of 20 and more letters, digits and ``+/_=-`` (``=``
    at the end left out) that touch none of these and that the tests tell from the corpus's own text. What
    ordinary text looks like is counted on the whole text of all rows, in stretches for every encoding and length.

    Null text is empty; empty texts have no spans and the hash of the empty string; repeated rows are scanned
    each; a number is never ``random``; an empty table gives an empty result. Cells (24) and bins (64) are all
    that passes the driver.
    """
    table = scan(docs)
    tested = _counts(table.select(F.explode("tested").alias("x")).select("x.cell", "x.bin", F.lit(1).alias("n")))
    ordinary = _counts(table.select(F.explode("ordinary").alias("x")).select(F.expr(f"x.code div {BINS}").alias("cell"), F.expr(f"x.code % {BINS}").alias("bin"), "x.n"))
    least = F.array(*map(F.lit, thresholds(tested, ordinary, rate)))
    added = F.filter("tested", lambda x: (x["kind"] == 3) & (x["bin"] >= F.get(least, x["cell"])))
    added = F.transform(added, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return table.select(
        "doc_id", number(0), number(1), number(2), F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.array_sort(F.concat("base", added))).alias("spans"), F.size(added).cast("long").alias("n_random")
    )
