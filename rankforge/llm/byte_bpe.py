"""Byte-level BPE encoding and decoding with segment trees.

A piece's bytes are the leaves of a segment tree; a leaf holds the rank of the
pair that starts there, and every node the leftmost least rank below it, so the
root names the next merge. A merge links a token to its live neighbour's
neighbour and updates three leaves: its own, the one it swallowed, and its left
neighbour's. Pieces of similar length share one array of trees and take their
merges in step; long pieces have a tree of their own.

Ranks are read on the driver and broadcast; vocabularies are a few MB at most.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_NONE = np.int64(1 << 62)
#: Trees of pieces up to this many bytes are built side by side.
_SIDE_BY_SIDE = 256
#: Pieces that a worker remembers, and texts' bytes in one step.
_REMEMBER, _STEP_BYTES = 100_000, 1 << 20
#: Fixed value: the widespread pattern whose matches hold a space at their start only, or are white space.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SELF = "\ud800"
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Tree:
    """One piece's segment tree."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(1, (len(values) - 1).bit_length())
        self.node = [_NONE] * self.size + values + [_NONE] * (self.size - len(values))
        for k in range(self.size - 1, 0, -1):
            self.node[k] = min(self.node[2 * k], self.node[2 * k + 1])

    def put(self, at: int, value: int) -> None:
        node, k = self.node, at + self.size
        node[k] = value
        while k > 1:
            k >>= 1
            node[k] = min(node[2 * k], node[2 * k + 1])


def _vocabulary(ranks: bytes) -> dict[bytes, int]:
    pairs = [line.split() for line in ranks.splitlines() if line.strip()]
    return {base64.b64decode(t): int(r) for t, r in pairs}


class Decoder:
    """The tokens' bytes, one after another; far smaller than what encoding needs."""

    def __init__(self, ranks: bytes):
        order = sorted(_vocabulary(ranks).items(), key=lambda x: x[1])
        self.token_size = np.zeros(order[-1][1] + 1, np.int64)
        self.token_size[[r for _, r in order]] = [len(t) for t, _ in order]
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in order), np.uint8)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.token_size[ids]
        ends = np.cumsum(np.concatenate([[0], sizes]))[np.cumsum(np.concatenate([[0], count]))]
        return gather(self.token_bytes, self.token_at[ids], sizes), ends


class Codec:
    def __init__(self, ranks: bytes, pattern: str):
        self.rank = _vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.spaced, twice = pattern == SPACED, re.compile(r" \s").search
        self.odd = lambda text: twice(text) or (text[-1:] == " " and text[-2:-1].isspace())
        self.base = max(self.rank.values()) + 1
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        merges = {}
        for token, r in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    merges[a * self.base + b] = r
        self.merges = merges
        bits = max(10, (4 * len(merges)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        todo = np.array(list(merges), np.int64)
        ranks_, step = np.array(list(merges.values()), np.int64), 0
        while len(todo):  # open addressing: one step more for all that found their slot taken
            slot = (self._slot(todo) + step) & (len(self.keys) - 1)
            free = self.keys[slot] == -1
            self.keys[slot[free]] = todo[free]
            won = self.keys[slot] == todo
            self.values[slot[won]] = ranks_[won]
            todo, ranks_, step = todo[~won], ranks_[~won], step + 1
        self.steps = step
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.at = self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        slot, out = self._slot(key), np.full(len(key), _NONE, np.int64)
        left = np.arange(len(key))
        for _ in range(self.steps):
            found = self.keys[slot]
            hit = found == key[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            left, slot = left[go], (slot[go] + 1) & (len(self.keys) - 1)
            if not len(left):
                break
        return out

    def encode_long(self, piece: bytes) -> np.ndarray:
        n, rank, base = len(piece), self.merges, self.base
        tok = self.single[np.frombuffer(piece, np.uint8)].tolist()
        tree = Tree([r * n + k if (r := rank.get(tok[k] * base + tok[k + 1])) is not None else _NONE for k in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def refresh(k: int) -> None:
            r = rank.get(tok[k] * base + tok[after[k]]) if after[k] < n else None
            tree.put(k, _NONE if r is None else r * n + k)

        while (top := tree.node[1]) != _NONE:
            k = top % n
            gone = after[k]
            tok[k], tok[gone] = top // n, -1
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            tree.put(gone, _NONE)
            refresh(k)
            if before[k] >= 0:
                refresh(before[k])
        return np.array([t for t in tok if t >= 0], np.int64)

    def encode_side_by_side(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has. ``width``, a power of two, is at least their length."""
        n, wide, deep = len(pieces), width + 1, 2 * width
        kind = np.int32 if self.base * width < 1 << 31 else np.int64
        none = np.iinfo(kind).max
        size = np.fromiter(map(len, pieces), np.int64, n)
        tok = np.full((n, wide), -1, np.int64)
        tok[np.arange(wide) < size[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 2, dtype=np.int64), (n, 1))
        after[np.arange(wide) >= size[:, None] - 1] = width
        before = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
        tree = np.full((n, deep), none, kind)
        row, col = np.nonzero(tok[:, 1:] >= 0)
        r = self.pair_ranks(tok[row, col], tok[row, col + 1])
        tree[row, width + col] = np.where(r < _NONE, r * width + col, none)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tok, after, before, tree = tok.ravel(), after.ravel(), before.ravel(), tree.ravel()
        levels = width.bit_length() - 1

        def put(base, at, values):
            k = at + width
            tree[base + k] = values
            for _ in range(levels):
                k >>= 1
                two = base + 2 * k
                tree[base + k] = np.minimum(tree[two], tree[two + 1])

        def refresh(rows, base, at):
            here = rows * wide
            nxt = after[here + at]
            r = self.pair_ranks(tok[here + at], tok[here + nxt])  # beyond the end stands -1, which no pair has
            put(base, at, np.where((r < _NONE) & (nxt < width), r * width + at, none))

        rows = np.arange(n)
        rows = rows[tree[rows * deep + 1] < none]
        while len(rows):
            base, here = rows * deep, rows * wide
            top = tree[base + 1].astype(np.int64)
            k = top & (width - 1)
            gone = after[here + k]
            tok[here + k] = top // width
            tok[here + gone] = -1
            nxt = after[here + gone]
            after[here + k] = nxt
            before[here + nxt] = k
            put(base, gone, none)
            refresh(rows, base, k)
            left = before[here + k]
            has = left >= 0
            refresh(rows[has], base[has], left[has])
            rows = rows[tree[base + 1] < none]
        live = tok.reshape(n, wide)[:, :width] >= 0
        return tok.reshape(n, wide)[:, :width][live], live.sum(axis=1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each has."""
        classes: dict[int, list[int]] = {}
        flat, sizes, order, whole, get = [], [], [], [], self.rank.get
        for i, p in enumerate(pieces):
            r = get(p)
            if r is not None:
                order.append(i)
                whole.append(r)
            else:
                classes.setdefault(1 << max(1, (len(p) - 1).bit_length()) if len(p) <= _SIDE_BY_SIDE else 0, []).append(i)
        flat.append(np.array(whole, np.int64))
        sizes.append(np.ones(len(whole), np.int64))
        for width, places in classes.items():
            step = max(1, (1 << 17) // width) if width else 1
            for k in range(0, len(places), step):
                part = [pieces[i] for i in places[k : k + step]]
                ids, size = self.encode_side_by_side(part, width) if width else ((x := self.encode_long(part[0])), np.array([len(x)]))
                flat.append(ids)
                sizes.append(size)
            order += places
        size = np.concatenate(sizes)
        at = np.cumsum(size) - size
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return gather(np.concatenate(flat), at[back], size[back]), size[back]

    def _units(self, text: str) -> list[str]:
        """Parts of a text that the pattern can't match across, as keys of ``known``.

        No match of the pattern but white space goes on past a space, so where
        no space stands before white space, or after it at the very end, the text
        falls apart before each.
        A key ending in a lone surrogate stands for itself, others for a space and themselves.
        """
        if not self.spaced or self.odd(text):
            return [p + _SELF for p in self.split(text)]
        keys = text.split(" ")
        keys[0] += _SELF
        return keys

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each has."""
        keys, count = [], []
        for t in texts:
            found = self._units(t) if t else []
            keys += found
            count.append(len(found))
        if len(self.known) > _REMEMBER:
            self.forget()
        new = list({*keys}.difference(self.known))
        if new:
            split, pieces, parts = self.split, [], []
            for key in new:
                found = split(key[:-1] if key[-1:] == _SELF else " " + key)
                pieces += found
                parts.append(len(found))
            place = dict(zip(dict.fromkeys(pieces), range(len(pieces)), strict=False))
            ids, size = self.encode_pieces([p.encode() for p in place])
            which = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
            at = np.cumsum(size) - size
            flat = gather(ids, at[which], size[which]).astype(np.int32)
            ends = np.cumsum(np.concatenate([[0], size[which]]))[np.cumsum([0, *parts])]
            self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.at = np.concatenate([self.at, len(self.flat) + ends[:-1]])
            self.sizes = np.concatenate([self.sizes, np.diff(ends)])
            self.flat = np.concatenate([self.flat, flat])
        which = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        sizes = self.sizes[which]
        ends = np.cumsum(np.concatenate([[0], sizes]))[np.cumsum([0, *count])]
        return gather(self.flat, self.at[which], sizes), np.diff(ends)


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of ``flat``, one after another."""
    return flat[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())]


@functools.lru_cache(maxsize=1)
def _decoder(ranks: bytes) -> Decoder:
    return Decoder(ranks)


@functools.lru_cache(maxsize=1)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def _slices(sizes):
    """Runs of rows with about ``_STEP_BYTES`` in them."""
    lo, held = 0, 0
    for k, n in enumerate(sizes):
        held += n or 0
        if held >= _STEP_BYTES:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``: the ids of each whole text, as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded by itself, without special tokens;
    ``path`` is a file of base64 tokens and ranks, read on the driver. One row
    for each input row, repeated rows too; null counts as empty and has no ids;
    ids of rows may be null; other columns are not read; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((_ranks(path), pattern))

    def run(batches):
        import pyarrow.compute  # noqa: F401

        codec = _codec(*shared.value)
        for batch in batches:
            for lo, hi in _slices(pa.compute.binary_length(batch.column(1)).to_pylist()):
                part = batch.slice(lo, hi - lo)
                ids, count = codec.encode(part.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum(count)]) * 4
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), packed], ["doc_id", "n_tokens", "ids"])
        pa.default_memory_pool().release_unused()  # the worker lives on for other tasks

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    return own.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``decode_ids`` of ``encode_texts``, in one Python worker a task in place of two.

    Nulls, repeated rows and an empty table are as in ``encode_texts``: a null
    text has no ids and no bytes, each row has its own, no row gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((_ranks(path), pattern))

    def run(batches):
        import pyarrow.compute  # noqa: F401

        codec, decoder = _codec(*shared.value), _decoder(shared.value[0])
        for batch in batches:
            for lo, hi in _slices(pa.compute.binary_length(batch.column(1)).to_pylist()):
                part = batch.slice(lo, hi - lo)
                ids, count = codec.encode(part.column(1).to_pylist())
                body, ends = decoder.decode(ids.astype(np.int64), count)
                cells = lambda at, flat, n=hi - lo: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), cells(np.concatenate([[0], np.cumsum(count)]) * 4, ids.astype("<u4")), cells(ends, body)], ["doc_id", "n_tokens", "ids", "decoded"])
        pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    return own.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (``doc_id, n_tokens, ids``) with ``decoded``, the bytes that the ids stand for.

    Null ids count as none and give no bytes; ``n_tokens`` is passed on as it is,
    null too, and not read. One row for each input row, repeated rows too; other
    columns are not read; an empty table gives an empty result.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(_ranks(path))

    def run(batches):
        decoder = _decoder(shared.value)
        for batch in batches:
            packed = batch.column(2).fill_null(b"")
            size = np.array([len(x) for x in packed.to_pylist()], np.int64)
            for lo, hi in _slices(size.tolist()):
                part = batch.slice(lo, hi - lo)
                ids = np.frombuffer(b"".join(packed.slice(lo, hi - lo).to_pylist()), "<u4").astype(np.int64)
                body, ends = decoder.decode(ids, size[lo:hi] // 4)
                out = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), out], ["doc_id", "n_tokens", "ids", "decoded"])
        pa.default_memory_pool().release_unused()

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
