"""Suffix dedup by bucket-pointer refinement of sampled suffixes.

A suffix is sampled where its 24-gram is the least of some window of ``length``
bytes; each window has one such suffix. Then:

1. Sampled suffixes are sorted into buckets by their 24-gram. A bucket of
   several groups gets a number, its bucket pointer, which goes back to the
   groups; a bucket of one suffix only is settled.
2. What is left is sorted on the pointers of its own bucket and of the bucket at
   the next sampled offset, with the bytes that neither 24-gram covers, over all
   that the windows of the suffix reach. If a smaller document has the same, all
   of these windows are repeats. A bucket stays open only if somewhere in it a
   later document differs from the earlier ones.
3. In open buckets each window is sorted on the pointer of the suffix in it and
   the bytes around its 24-gram.

The bytes of a 24-gram enter later steps by its pointer alone. Buckets are
numbered by the order of 64-bit names of 24-grams, so a false removal needs two
24-grams of one name with the same bytes around them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._names import Texts, mix, pack, pair, unpack
from ._rounds import Ask, distinct, earlier, rounds, runs, spread

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_GRAM = 24
#: Window starts that are worked on at once: what is live is bounded by this, not by the group or the text.
_PIECE = 1 << 17
_PLACE = np.uint64((1 << 20) - 1)
_SECOND = 0x5851F42D
#: The half of a name that says who reads it; a bucket pointer keeps it, and has the bucket's number in the other half.
_READER = np.uint64(0xFFFFFFFF << 32)


def _eight(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each offset, as one number."""
    return np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,))


def _fold(raw: np.ndarray, lo: np.ndarray, size, most: int, out: np.ndarray, grams, seed: int = 0) -> np.ndarray:
    """``out`` with the ``size`` bytes (at most ``most``) from each ``lo``, but for what lies in a 24-gram at one of ``grams``."""
    eight = _eight(raw)
    for k in range(0, most, 8):
        at = np.minimum(k, size - 8) + lo
        covered = np.zeros(len(lo), bool)
        for gram in grams:
            covered |= (at >= gram) & (at + 8 <= gram + _GRAM)
        out = pair(out, np.where(covered, np.uint64(0), eight[at]), k + seed)
    return out


class Buckets:
    """The sampled suffixes of one group, with the windows that each stands for.

    ``anchor`` is the place of a suffix, ``name`` that of its 24-gram; ``start`` is
    its first window, ``width`` the number of its windows (they are adjacent).
    """

    def __init__(self, texts: Texts, length: int):
        self.raw, self.length = texts.raw, length
        parts = [self._piece(texts, lo) for lo in range(0, max(0, len(texts.raw) - length + 1), _PIECE)]
        self.start, self.width, self.anchor, self.name, self.doc = (np.concatenate(c) if parts else np.zeros(0, t) for c, t in zip(zip(*parts, strict=True) if parts else [()] * 5, (np.int64, np.int64, np.int64, np.uint64, np.int64), strict=True))

    def _piece(self, texts: Texts, lo: int):
        """The suffixes of the windows that start in one piece; a piece's edge only parts a suffix in two."""
        raw = self.raw[lo : lo + _PIECE + self.length - 1]
        starts = np.arange(len(raw) - self.length + 1)
        doc = np.searchsorted(texts.offs, starts + lo, side="right") - 1
        inside = starts + lo + self.length <= texts.offs[doc + 1]
        starts, doc = starts[inside], doc[inside]
        eight = _eight(raw)
        gram = pair(pair(eight[:-8], eight[8:], 16)[:-8], eight[16:], _GRAM)
        least = self._least(gram, self.length - _GRAM + 1)[starts]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        width, anchor, start = np.diff(np.append(first, len(least))), least[first], starts[first]
        return start + lo, width, anchor + lo, mix(gram[anchor]), doc[first]

    @staticmethod
    def _least(gram: np.ndarray, w: int) -> np.ndarray:
        """Place of the leftmost least 24-gram among the ``w`` from each offset."""
        key = (mix(gram) & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
        size = 1
        while size * 2 <= w:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < w:
            key = np.minimum(key[: len(key) - (w - size)], key[w - size :])
        return (key & _PLACE).astype(np.int64)

    def pointers(self, which: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Bucket pointers of all suffixes, from the numbers of the distinct names of ``which``; the name itself where there is none."""
        out = self.name.copy()
        names, place = np.unique(self.name[which], return_inverse=True)
        out[which] = np.where(numbers > 0, names & _READER | numbers, names)[place]
        return out

    def extents(self, which: np.ndarray, pointer: np.ndarray) -> np.ndarray:
        """Identifiers of all bytes that the windows of these suffixes reach, and of the places of suffixes in them."""
        return np.concatenate([np.zeros(0, np.uint64), *(self._extents(which[k : k + _PIECE], pointer) for k in range(0, len(which), _PIECE))])

    def _extents(self, which: np.ndarray, pointer: np.ndarray) -> np.ndarray:
        start, anchor, size = self.start[which], self.anchor[which], self.width[which] - 1 + self.length
        after = np.minimum(which + 1, len(self.start) - 1)
        # the next suffix, where it is of the same document and its 24-gram ends in what the windows reach
        later = self.anchor[after]
        has = (self.doc[after] == self.doc[which]) & (later > anchor) & (later + _GRAM <= start + size)
        later = np.where(has, later, anchor)
        out = pair(pointer[which], np.where(has, pointer[after], np.uint64(0)))
        out = pair(out, (size << 32 | (later - start) << 16 | anchor - start).astype(np.uint64))
        return _fold(self.raw, start, size, 2 * self.length - _GRAM, out, (anchor, later))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of these suffixes, and the suffix of each."""
        z = self.width[which]
        return np.repeat(self.start[which] - (np.cumsum(z) - z), z) + np.arange(z.sum()), np.repeat(which, z)

    def window_names(self, starts: np.ndarray, which: np.ndarray, pointer: np.ndarray, seed: int) -> np.ndarray:
        """Identifiers of windows, from the pointers of their suffixes ``which``."""
        parts = [np.zeros(0, np.uint64)]
        for k in range(0, len(starts), _PIECE):
            lo, suffix = starts[k : k + _PIECE], which[k : k + _PIECE]
            anchor = self.anchor[suffix]
            parts.append(_fold(self.raw, lo, self.length, self.length, pair(pointer[suffix], (anchor - lo).astype(np.uint64), seed), (anchor,), seed))
        return np.concatenate(parts)


def number(names: np.ndarray, columns) -> np.ndarray:
    """The number of each name's bucket, from 1, among this reader's buckets of several groups; 0 where nobody else has the name."""
    order, starts = runs(names)
    many = np.diff(np.append(starts, len(order))) > 1
    return spread(order, starts, np.where(many, np.cumsum(many), 0).astype(np.uint64))


def settle(names: np.ndarray, columns) -> np.ndarray:
    """For (suffix, extent) entries: 1 if a smaller document has the same extent; 2 if the bucket is open and it doesn't."""
    own, extent = columns
    order = np.lexsort((own, extent, names))
    s, e = names[order], extent[order]
    new_name = np.concatenate([[True], s[1:] != s[:-1]])
    new_both = new_name | np.concatenate([[True], e[1:] != e[:-1]])
    names_at, both_at = np.flatnonzero(new_name), np.flatnonzero(new_both)
    least_name = spread(np.arange(len(s)), names_at, np.minimum.reduceat(own[order], names_at))
    least_both = spread(np.arange(len(s)), both_at, own[order][both_at])
    same = own[order] > least_both
    differs = ~same & (own[order] > least_name)
    is_open = spread(np.arange(len(s)), names_at, np.logical_or.reduceat(differs, names_at))
    out = np.empty(len(s), np.uint64)
    out[order] = np.where(same, 1, np.where(is_open, 2, 0))
    return out


class Refinement:
    def __init__(self, length: int):
        self.length = length

    def ask_suffixes(self, texts: Texts, state: bytes, replies):
        return Ask(np.unique(Buckets(texts, self.length).name)), b""

    def _keep(self, bits: np.ndarray, numbers: np.ndarray) -> bytes:
        """State of flags, and the numbers of the buckets that later steps point to."""
        return np.packbits(bits).tobytes() + pack(numbers)

    def _kept(self, state: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = (n + 7) // 8
        return np.unpackbits(np.frombuffer(state[:at], np.uint8), count=n).astype(bool), unpack(state[at:])

    def _entries(self, b: Buckets, which: np.ndarray, pointer: np.ndarray, ids: np.ndarray):
        """Distinct (bucket, extent) entries in the order of buckets, with the least owner of each; the place of each, and its owner."""
        name, extent, own = pointer[which], b.extents(which, pointer), ids[b.doc[which]]
        order = np.lexsort((own, extent, name))
        a, e = name[order], extent[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (e[1:] != e[:-1])]) if len(a) else np.zeros(0, bool)
        place = np.empty(len(a), np.int64)
        place[order] = np.cumsum(new) - 1
        return a[new], e[new], own[order][new], place, own

    def ask_extents(self, texts: Texts, state: bytes, replies: np.ndarray):
        b = Buckets(texts, self.length)
        _, place, count = distinct(b.name)
        live = (replies > 0) | (count > 1)
        numbers, live = replies[live], live[place] if len(place) else np.zeros(0, bool)
        which = np.flatnonzero(live)
        names, extent, least, _, _ = self._entries(b, which, b.pointers(which, numbers), texts.ids())
        return Ask(names, (least, extent)), self._keep(live, numbers)

    def _windows(self, b: Buckets, which: np.ndarray, pointer: np.ndarray, ids: np.ndarray):
        """Starts of the windows, their suffixes and owners; the distinct names, the place of each window and the least owners."""
        starts, suffix = b.windows(which)
        own = ids[b.doc[suffix]]
        names, first, place = np.unique(b.window_names(starts, suffix, pointer, 0), return_index=True, return_inverse=True)
        least = np.full(len(names), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, place, own)
        return starts, suffix, own, names, first, place, least

    def ask_windows(self, texts: Texts, state: bytes, replies: np.ndarray):
        b, ids = Buckets(texts, self.length), texts.ids()
        live, numbers = self._kept(state, len(b.start))
        live = np.flatnonzero(live)
        pointer = b.pointers(live, numbers)
        _, _, least, place, own = self._entries(b, live, pointer, ids)
        done = (own > least[place]) | (replies[place] == 1) if len(place) else np.zeros(0, bool)
        is_open = ~done & (replies[place] == 2) if len(place) else done
        known, ask = np.zeros(len(b.start), bool), np.zeros(len(b.start), bool)
        known[live[done]], ask[live[is_open]] = True, True
        which = np.flatnonzero(ask)
        starts, suffix, _, names, first, _, least = self._windows(b, which, pointer, ids)
        second = b.window_names(starts[first], suffix[first], pointer, _SECOND) >> np.uint64(32)
        # only the open buckets' numbers are needed again
        numbers = numbers[np.isin(np.unique(b.name[live]), b.name[which])]
        return Ask(names, (least, second)), self._keep(np.concatenate([known, ask]), numbers)

    def finish(self, texts: Texts, state: bytes, replies: np.ndarray) -> pa.Table:
        b, ids, n = Buckets(texts, self.length), texts.ids(), len(texts.raw)
        bits, numbers = self._kept(state, 2 * len(b.start))
        known, ask = np.flatnonzero(bits[: len(b.start)]), np.flatnonzero(bits[len(b.start) :])
        starts, _, own, _, _, place, least = self._windows(b, ask, b.pointers(ask, numbers), ids)
        if len(starts):
            starts = starts[(replies[place] == 1) | (own > least[place])]
        # removed bytes as disjoint runs: known suffixes, and single windows
        lo = np.concatenate([b.start[known], starts])
        hi = np.concatenate([b.start[known] + b.width[known] - 1, starts]) + self.length
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, lo, 1)
        np.add.at(step, hi, -1)
        cover = np.cumsum(step, dtype=np.int32)[:n] > 0
        lead = cover.copy()
        if n:
            lead[1:] &= ~cover[:-1]
            at = texts.offs[:-1][np.diff(texts.offs) > 0]
            lead[at] = cover[at]
        removed, spans = (np.concatenate([[0], np.cumsum(x)])[texts.offs] for x in (cover, lead))
        kept = texts.offs - removed
        body = np.ascontiguousarray(texts.raw[~cover])
        out = pa.Array.from_buffers(pa.large_binary(), texts.n, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())
        return pa.table({"doc_id": texts.doc_id, "n_bytes": pa.array(np.diff(texts.offs).astype(np.int64)), "n_removed": pa.array(np.diff(removed).astype(np.int64)), "n_spans": pa.array(np.diff(spans).astype(np.int64)), "kept": out})


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that starts in a document with a smaller id too.

    Texts are UTF-8 bytes; strings never cross documents and are judged on the
    input. Returns ``doc_id, n_bytes, n_removed, n_spans, kept`` (``kept`` is
    binary: cutting bytes may cut a character), one row for each input row. A
    null text is empty; a null id counts as larger than all others; rows that
    share an id are not smaller than each other; other columns are not read;
    an empty table gives an empty result. A group's bytes are worked on in pieces
    of 128 KB, long texts too; a text must fit in an executor's memory as such.
    """
    if length < 32:
        raise ValueError("length must be 32 bytes or more")
    talk = Refinement(length)
    return rounds(docs, id_col, text_col, [talk.ask_suffixes, talk.ask_extents, talk.ask_windows], [number, settle, earlier], talk.finish, RESULT, group_bytes=1 << 20, bucket_bytes=8 << 20)
