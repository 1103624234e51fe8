"""Byte-level BPE encoding of Arrow text columns, with each distinct piece encoded once a worker.

The tokenizer applies its merges inside pieces that a fixed pattern cuts from the text. Here numpy
finds the same cuts for whole blocks of rows, and the ``tokenizers`` library encodes only pieces a
worker has not met. Rows with code points whose class is not plain (multi-byte white space,
unassigned or astral ones), and rows that hold the string of a special token, go to the library whole,
so every row gets exactly the library's ids.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from . import bytesops as B

SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
_SLOTS = 1 << 19
_MOST_PIECES = 600_000


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point below 2**16."""
    out = np.full(1 << 16, ODD, np.uint8)
    for cp in range(1 << 16):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L":
            out[cp] = LETTER
        elif kind[0] == "N":
            out[cp] = NUMBER
        elif kind not in ("Cn", "Cs") and not chr(cp).isspace():
            out[cp] = OTHER
    out[[0x20, 9, 10, 11, 12, 13]] = SPACE
    out[0x1C:0x20] = OTHER
    return out


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the code point that each byte belongs to."""
    table = _classes()
    cls = table[data]
    high = data >= 0x80
    if high.any():
        cls[high] = ODD
        two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        cls[two] = cls[two + 1] = table[((data[two].astype(np.int32) & 31) << 6) | (data[two + 1] & 63)]
        three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
        if len(three):
            lead = data[three].astype(np.int32)
            c = table[((lead & 15) << 12) | ((data[three + 1].astype(np.int32) & 63) << 6) | (data[three + 2] & 63)]
            cls[three] = cls[three + 1] = cls[three + 2] = c
    return cls


def piece_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of each row start, and which rows hold code points of no plain class."""
    n = len(data)
    cls = _byte_classes(data)
    odd = np.zeros(len(off) - 1, bool)
    strange = np.flatnonzero(cls == ODD)
    if len(strange):
        odd[np.searchsorted(off, strange, "right") - 1] = True
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    first = first[:n]
    prev = np.empty(n, np.uint8)
    prev[0] = ODD
    prev[1:] = cls[:-1]
    prev[first] = ODD  # unlike any class
    blank_before = np.zeros(n, bool)
    blank_before[1:] = data[:-1] == 0x20
    blank_before &= ~first
    following = np.empty(n, np.uint8)
    following[-1] = SPACE
    following[:-1] = cls[1:]
    last = off[1:] - 1
    following[last[last >= 0]] = SPACE
    space = cls == SPACE
    cut = first | np.where(space, (prev != SPACE) | (following != SPACE), (prev != cls) & ~blank_before)
    quote = np.flatnonzero((data == 0x27) & (prev != OTHER) & ~blank_before)
    if len(quote):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        end = off[np.searchsorted(off, quote, "right")]
        a, b = padded[quote + 1], padded[quote + 2]
        one = ((a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)) & (quote + 1 < end)
        two = (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))) & (quote + 2 < end)
        cut[quote[one | two] + 1] = False
        cut = np.concatenate([cut, np.zeros(3, bool)])
        cut[quote[one] + 2] = True
        cut[quote[two] + 3] = True
        cut = cut[:n]
    return np.flatnonzero(cut), odd


class Encoder:
    """Encodes blocks of rows; keeps the ids of pieces it has met, up to a fixed number."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: The strings that the library takes for tokens of their own wherever they are.
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.met = np.zeros(0, np.uint64)  # sorted
        self.met_entry = np.zeros(0, np.int32)
        self.key = np.zeros(_SLOTS, np.uint64)
        self.entry = np.zeros(_SLOTS, np.int32)
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.width = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = self.filled = 0

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has. Pieces without line breaks are given to the library
        many at a time, one a line: it cuts there as it cuts in the text that they are from."""
        line = self.library.encode("\n", add_special_tokens=False).ids
        joined = [k for k, p in enumerate(pieces) if not (p[-1:].isspace() or p[:1] in b"\t\n\r\v\f")]
        if len(line) == 1 and len(joined) == len(pieces) and len(pieces) > 1:
            texts = ["\n".join(p.decode() for p in pieces[k : k + 1000]) + "\n" for k in range(0, len(pieces), 1000)]
            flat = np.concatenate([np.array(x.ids, np.int32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(flat == line[0])
            if len(ends) == len(pieces):
                return flat[flat != line[0]], np.diff(ends, prepend=-1).astype(np.int32) - 1
        if 0 < len(joined) < len(pieces):
            rest = sorted(set(range(len(pieces))) - set(joined))
            (a, m), (b, n) = self._ids([pieces[k] for k in joined]), self._ids([pieces[k] for k in rest])
            order = np.argsort(np.array(joined + rest), kind="stable")
            both, lengths = np.concatenate([a, b]), np.concatenate([m, n])
            at = np.cumsum(lengths) - lengths
            size = lengths[order].astype(np.int64)
            index = np.repeat(at[order] - (np.cumsum(size) - size), size) + np.arange(len(both))
            return both[index], lengths[order]
        ids = [x.ids for x in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum())), lengths

    def _learn(self, pieces: list[bytes]) -> None:
        flat, lengths = self._ids(pieces)
        total, n = len(flat), len(pieces)
        for name, need in (("at", self.used + n), ("size", self.used + n), ("width", self.used + n), ("flat", self.filled + total)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old)), old.dtype)]))
        new = slice(self.used, self.used + n)
        self.flat[self.filled : self.filled + total] = flat
        self.size[new] = lengths
        self.width[new] = np.fromiter(map(len, pieces), np.int32, n)
        self.at[new] = self.filled + np.cumsum(lengths) - lengths
        self.used += n
        self.filled += total

    def _entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = B.range_hashes(data, starts, ends)
        slot = (h >> np.uint64(65 - _SLOTS.bit_length())).astype(np.int64)
        found = self.entry[slot]
        missed = np.flatnonzero((self.key[slot] != h) | (self.width[found] != ends - starts))
        if len(missed):
            uniq, where, back = np.unique(h[missed], return_index=True, return_inverse=True)
            place = np.searchsorted(self.met, uniq)
            new = np.ones(len(uniq), bool)
            inside = place < len(self.met)
            new[inside] = self.met[place[inside]] != uniq[inside]
            if new.any():
                raw = data.tobytes()
                at = missed[where[new]]
                entries = np.arange(self.used, self.used + len(at), dtype=np.int32)
                self._learn([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
                self.met = np.insert(self.met, place[new], uniq[new])
                self.met_entry = np.insert(self.met_entry, place[new], entries)
            got = self.met_entry[np.searchsorted(self.met, uniq)]
            found[missed] = got[back]
            self.key[slot[missed]] = h[missed]
            self.entry[slot[missed]] = found[missed]
        return found

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows of a block, one after another, and the rows' n + 1 offsets in them."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        if self.used > _MOST_PIECES:
            self._forget()
        starts, odd = piece_starts(data, off)
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(off, at, "right")) - 1
                odd[row] |= at + len(token) <= off[row + 1]
                at = raw.find(token, at + 1)
        if odd.any():
            return self._with_library(data, off, odd)
        ends = np.append(starts[1:], len(data))
        found = self._entries(data, starts, ends)
        return self._spread(found, np.searchsorted(starts, off))

    def _spread(self, found: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[found].astype(np.int64)
        ends = np.zeros(len(found) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        index = np.repeat(self.at[found] - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[index], ends[row_at]

    def _with_library(self, data: np.ndarray, off: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts: list[np.ndarray] = []
        for r in range(len(odd)):
            own = data[off[r] : off[r + 1]]
            if odd[r]:
                parts.append(np.array(self.library.encode(own.tobytes().decode(), add_special_tokens=False).ids, np.int32))
            else:
                parts.append(self.encode(own, np.array([0, len(own)], np.int64))[0])
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        return np.concatenate(parts), at


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process and tokenizer file."""
    return Encoder(path)
