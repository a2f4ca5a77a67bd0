"""Vectorised 64-bit naming of words and byte strings, and a compact wire format."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_C1 = np.uint64(0xBF58476D1CE4E5B9)
_C2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)

#: ASCII white space that separates words: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Name of the ordered pair (a, b)."""
    x = a * _ODD
    x += mix(b + _GOLD)
    x += np.uint64(seed)
    return mix(x)


_DEPTH = 64
_TABLE = mix(np.arange(1, _DEPTH * 256 + 1, dtype=np.uint64) * _GOLD)


class Texts:
    """The texts of one group in a fixed order, as one byte array.

    Rows are ordered by id, then text, so that every pass over the group sees
    the same order whatever order the rows arrived in. A null text is empty.
    """

    def __init__(self, table: pa.Table):
        table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_id = table["doc_id"].combine_chunks()
        if isinstance(self.doc_id, pa.ChunkedArray):
            self.doc_id = self.doc_id.chunk(0) if self.doc_id.num_chunks else pa.array([], table.schema.field("doc_id").type)
        col = table["text"].cast(pa.large_string())
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
        self.n = len(col)
        lens = col.cast(pa.large_binary()).fill_null(b"")
        buf = lens.buffers()
        offs = np.frombuffer(buf[1], dtype=np.int64, count=self.n + 1 + lens.offset)[lens.offset :] if self.n else np.zeros(1, np.int64)
        self.raw = np.frombuffer(buf[2], dtype=np.uint8)[offs[0] : offs[-1]] if self.n and offs[-1] > offs[0] else np.zeros(0, np.uint8)
        self.offs = offs - offs[0]

    def ids(self) -> np.ndarray:
        """Ids as unsigned numbers in the same order; a null id ranks after every other."""
        ids = self.doc_id.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        return np.asarray(ids, dtype=np.int64).view(np.uint64) ^ np.uint64(1 << 63)


class Words:
    """Word spans of ``Texts`` and, on demand, their 64-bit names."""

    def __init__(self, texts: Texts, lower: bool = False):
        raw, offs = texts.raw, texts.offs
        self.raw = LOWER[raw] if lower else raw
        word = ~SPACE[raw]
        start, end = word.copy(), word.copy()
        if len(raw):
            start[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            full = offs[1:] > offs[:-1]
            first, last = offs[:-1][full], offs[1:][full] - 1
            start[first] = word[first]
            end[last] = word[last]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        #: First word of each document, and the number of words at the end.
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(texts.n), self.count)

    def names(self) -> np.ndarray:
        size = self.end - self.start
        n = len(size)
        out = np.zeros(n, np.uint64)
        step = max(1, min(n, 200_000)) if n else 1
        for k in range(0, n, step):
            s, z = self.start[k : k + step], size[k : k + step]
            at = np.cumsum(z) - z
            inner = np.arange(z.sum()) - np.repeat(at, z)
            byte = self.raw[np.repeat(s, z) + inner].astype(np.int64)
            val = _TABLE[np.minimum(inner, _DEPTH - 1) * 256 + byte]
            deep = np.flatnonzero(inner >= _DEPTH)
            if len(deep):
                val[deep] = mix((inner[deep] * 256 + byte[deep]).astype(np.uint64) * _ODD)
            out[k : k + step] = np.add.reduceat(val, at) + z.astype(np.uint64) * _GOLD
        return mix(out)


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, without the planes that are all zero."""
    a = np.ascontiguousarray(a, dtype="<u8")
    some = int(np.bitwise_or.reduce(a)) if len(a) else 0
    planes = [k for k in range(8) if some >> 8 * k & 255]
    return len(a).to_bytes(8, "little") + bytes([sum(1 << k for k in planes)]) + a.view(np.uint8).reshape(-1, 8)[:, planes].T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    n, planes = int.from_bytes(b[:8], "little"), [k for k in range(8) if b[8] >> k & 1]
    out = np.zeros((n, 8), np.uint8)
    if n and planes:
        out[:, planes] = np.frombuffer(b, np.uint8, offset=9).reshape(len(planes), n).T
    return out.view("<u8").reshape(n).astype(np.uint64)


def pack_near(a: np.ndarray) -> bytes:
    """``pack`` of numbers that may be far from zero but near each other."""
    base = a.min() if len(a) else np.uint64(0)
    return int(base).to_bytes(8, "little") + pack(a - base)


def unpack_near(b: bytes) -> np.ndarray:
    return unpack(b[8:]) + np.uint64(int.from_bytes(b[:8], "little"))


def pack_sorted(a: np.ndarray) -> bytes:
    d = np.ascontiguousarray(a, dtype=np.uint64).copy()
    if len(d):
        d[1:] -= a[:-1]
    # the first may be large: it goes ahead of the planes
    head = int(d[0]) if len(d) else 0
    return head.to_bytes(8, "little") + pack(d[1:])


def unpack_sorted(b: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    d = np.empty(n, np.uint64)
    d[0] = int.from_bytes(b[:8], "little")
    d[1:] = unpack(b[8:])
    return np.cumsum(d, dtype=np.uint64)
