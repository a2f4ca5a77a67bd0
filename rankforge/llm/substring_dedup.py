"""Substring dedup by recompression.

Words are symbols. Rounds alternately name runs of one symbol and pairs of
neighbours: a bit of each symbol's name marks it left or right, and a left
symbol followed by a right one becomes one new symbol. Equal substrings get
equal symbols except near their ends.

1. The low symbols, after ``LOW`` rounds of pairs, are named over all documents by
   a Spark round: a symbol that several groups hold gets a number, the same for
   all; one of a single group keeps the hash that it came with. A window whose
   certain interior has a symbol of this place alone can't repeat.
2. High symbols are named runs and pairs of these global names. One of a
   window's length or more that others hold too shows that every window in it
   repeats.
3. What is left is verified window by window, by the global names of its
   interior and the words around it.

What decides a removal, a window or a high symbol, has two 64-bit names, one from
global names and one from the words alone, and is shared only if both are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._names import Texts, Words, mix, pack, pair, unpack
from ._rounds import Ask, distinct, holders, rounds
from .suffix_dedup import _READER, number

RESULT = "doc_id long, n_words long, n_removed long, kept string"
#: Pair rounds before the symbols that reject windows, and before those that confirm them.
LOW, HIGH = 5, (14, 18)
_LOW_TAG, _HIGH_TAG, _SECOND_TAG = np.uint64(0x51A7E5), np.uint64(0x7A11), np.uint64(0x2ECD)
_STEP = 0xD1342543DE82EF95


def _group(new: np.ndarray, sym, span, doc):
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(sym))), np.add.reduceat(span, head), doc[head]


def run_round(sym, span, doc, k: int):
    """Name each run of one symbol; also the new index of each symbol."""
    new = np.ones(len(sym), bool)
    new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    head, n, span, doc = _group(new, sym, span, doc)
    out = sym[head]
    many = n > 1
    out[many] = pair(out[many], n[many].astype(np.uint64), 2 * k)
    return out, span, doc, np.cumsum(new) - 1


def pair_round(sym, span, doc, k: int):
    """Name each pair of a left and a right symbol; also the new indices and who is right."""
    right = (mix(sym + np.uint64(2 * k + 1)) >> np.uint64(63)).astype(bool)
    new = np.ones(len(sym), bool)
    new[1:] = ~(~right[:-1] & right[1:] & (doc[1:] == doc[:-1]))
    head, n, span, doc = _group(new, sym, span, doc)
    out = sym[head]
    two = np.flatnonzero(n == 2)
    out[two] = pair(out[two], sym[head[two] + 1], 2 * k + 1)
    return out, span, doc, np.cumsum(new) - 1, right


class Sums:
    """Names of any stretch of a sequence, from sums of its scrambled symbols."""

    def __init__(self, sym: np.ndarray):
        power = np.cumprod(np.full(len(sym), _STEP, np.uint64))
        self.back = np.cumprod(np.full(len(sym) + 1, pow(_STEP, -1, 1 << 64), np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sym) * power, dtype=np.uint64)])

    def names(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64)


class Grammar:
    """The low symbols of one group's words, and for each window its certain interior."""

    def __init__(self, texts: Texts, window: int):
        self.words = w = Words(texts)
        self.window, self.name = window, w.names()
        sym, n = self.name, len(self.name)
        span, doc = np.ones(n, np.int64), w.doc
        #: Word positions at which a window starts.
        self.starts = np.flatnonzero(np.arange(n) + window <= w.first[doc + 1]) if n else np.zeros(0, np.int64)
        self.low, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if not len(self.starts):
            return
        # at word position p, the boundary of the present round that surely is one for a text that starts (ends) there
        left, right = np.arange(n + 1), np.arange(n + 1)
        sym, span, doc, at = run_round(sym, span, doc, 0)
        left = np.append(at + 1, len(sym))[left]
        right = np.append(0, at)[right]
        for k in range(1, LOW + 1):
            sym, span, doc, at, is_right = pair_round(sym, span, doc, k)
            left = np.append(at + is_right, len(sym))[left]
            right = np.append(0, at + is_right)[right]
        self.span, self.doc = span, doc
        #: First and last low symbol of each window's interior, and the word at which each low symbol starts.
        self.core = left[self.starts], right[self.starts + window]
        self.at = np.append(0, np.cumsum(span))
        self.low, self.place, self.count = distinct(mix(sym ^ _LOW_TAG))

    def globals(self, numbers: np.ndarray) -> np.ndarray:
        """The global names of the low symbols in their order, from the numbers of the distinct ones."""
        return np.where(numbers > 0, self.low & _READER | numbers, self.low)[self.place]

    def high(self, named: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Symbols over global names with ``window`` words or more, at each high level: symbol, first word, words."""
        sym, span, doc, out = named, self.span, self.doc, []
        for k in range(LOW + 1, max(HIGH) + 1):
            sym, span, doc, _ = run_round(sym, span, doc, k)
            sym, span, doc, _, _ = pair_round(sym, span, doc, k)
            if k in HIGH:
                long = np.flatnonzero(span >= self.window)
                out.append((sym[long], (np.cumsum(span) - span)[long], span[long]))
        return out

    def high_names(self, high) -> np.ndarray:
        """For each high level the names, then the second names."""
        words, out = Sums(self.name ^ _SECOND_TAG), [np.zeros(0, np.uint64)]
        for k, (sym, start, span) in enumerate(high):
            out += [mix(sym ^ (_HIGH_TAG + np.uint64(k))), mix(words.names(start, start + span) ^ (_SECOND_TAG + np.uint64(k)))]
        return np.concatenate(out)

    def window_names(self, which: np.ndarray, named: np.ndarray) -> np.ndarray:
        """Names of the windows at ``starts[which]``: from the global names inside and the words around them, then from words alone."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        starts, a, b = self.starts[which], self.core[0][which], self.core[1][which]
        b = np.maximum(a, b)
        ends, words = starts + self.window, Sums(self.name)
        # without an interior all words are around it
        lo, hi = np.where(a < b, self.at[a], ends), np.where(a < b, self.at[b], ends)
        inner = pair(Sums(named).names(a, b), (lo - starts).astype(np.uint64), 1)
        return np.concatenate([pair(pair(inner, words.names(starts, lo), 2), words.names(hi, ends), 3), _word_names(self.name, starts, self.window)])


def _word_names(name: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The names of the ``window`` words from each start, doubling lengths."""
    level, size, seed = name, 1, 1 << 20
    while size * 2 <= window:
        level = pair(level[:-size], level[size:], size + seed)
        size *= 2
    return pair(level[starts], level[starts + window - size], window + seed)


class Recompression:
    def __init__(self, window: int):
        self.window = window

    def ask_symbols(self, texts: Texts, state: bytes, replies):
        return Ask(Grammar(texts, self.window).low), b""

    def ask_high(self, texts: Texts, state: bytes, replies: np.ndarray):
        g = Grammar(texts, self.window)
        if not len(g.low):
            return Ask(np.zeros(0, np.uint64)), pack(replies)
        names, _, _ = distinct(g.high_names(g.high(g.globals(replies))))
        return Ask(names), pack(replies)

    def ask_windows(self, texts: Texts, state: bytes, replies: np.ndarray):
        g, numbers = Grammar(texts, self.window), unpack(state)
        if not len(g.low):
            return Ask(np.zeros(0, np.uint64)), pack(numbers)
        named = g.globals(numbers)
        alone = ~((numbers > 0) | (g.count > 1))[g.place]
        apart = np.concatenate([[0], np.cumsum(alone)])
        a, b = g.core
        maybe = (a >= b) | (apart[np.maximum(a, b)] == apart[a])
        known = np.zeros(len(g.name) + 1, bool)
        skip = np.zeros(len(g.name) + 1, bool)
        high, at = g.high(named), 0
        _, place, count = distinct(g.high_names(high))
        here = ((replies > 0) | (count > 1))[place] if len(place) else np.zeros(0, bool)
        for sym, start, span in high:  # the highest shared symbol decides who registers its windows
            ok, own = here[at : at + len(sym)] & here[at + len(sym) : at + 2 * len(sym)], replies[place[at : at + len(sym)]] < 2
            at += 2 * len(sym)
            for mark, value in ((known, True), (skip, None)):
                s, z, o = start[ok], span[ok] - self.window + 1, own[ok]
                idx = np.repeat(s - (np.cumsum(z) - z), z) + np.arange(z.sum())
                mark[idx] = True if value else np.repeat(~o, z)
        known, skip = known[g.starts], skip[g.starts]
        ask = maybe & ~skip
        names, _, _ = distinct(g.window_names(ask, named))
        return Ask(names), np.packbits(np.concatenate([known, ask])).tobytes() + pack(numbers)

    def finish(self, texts: Texts, state: bytes, replies: np.ndarray) -> pa.Table:
        g = Grammar(texts, self.window)
        w, n, starts = g.words, len(g.name), g.starts
        gone = np.zeros(n + 1, np.int64)
        if len(starts):
            size = (2 * len(starts) + 7) // 8
            bits = np.unpackbits(np.frombuffer(state[:size], np.uint8), count=2 * len(starts)).astype(bool)
            known, ask = bits[: len(starts)], bits[len(starts) :]
            _, place, count = distinct(g.window_names(ask, g.globals(unpack(state[size:]))))
            repeats = known.copy()
            both = ((replies > 0) | (count > 1))[place]
            repeats[ask] |= both[: len(both) // 2] & both[len(both) // 2 :]
            np.add.at(gone, starts[repeats], 1)
            np.add.at(gone, starts[repeats] + self.window, -1)
        keep = np.cumsum(gone)[:n] == 0
        kept = np.concatenate([[0], np.cumsum(keep)])
        n_kept = kept[w.first[1:]] - kept[w.first[:-1]]
        # kept words, each but the first of its text after a space
        s, z = w.start[keep], (w.end - w.start)[keep]
        lead = np.ones(len(s), np.int64)
        firsts = kept[w.first[:-1]]
        lead[firsts[n_kept > 0]] = 0
        size = z + lead
        at = np.cumsum(size) - size
        total = int(size.sum())
        out = np.full(total, 0x20, np.uint8)
        src = np.arange(total) - np.repeat(at + lead - s, size)
        body = np.ones(total, bool)
        body[at[lead == 1]] = False
        out[body] = texts.raw[src[body]]
        offs = np.concatenate([at, [total]])[kept[w.first]]
        text = pa.Array.from_buffers(pa.large_string(), texts.n, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())
        return pa.table({"doc_id": texts.doc_id, "n_words": pa.array(w.count.astype(np.int64)), "n_removed": pa.array((w.count - n_kept).astype(np.int64)), "kept": text})


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Remove every word that a repeated window of ``window`` words covers.

    A window repeats if its words also start anywhere else, in the same text
    or another; windows are judged on the input. Returns ``doc_id, n_words,
    n_removed, kept``: one row for each input row, repeated rows included (they
    repeat each other); ``kept`` joins the words that stay by one space. A null
    text has no words; ids may be null; other columns are not read; an empty
    table gives an empty result.
    """
    if window < 2:
        raise ValueError("window must be 2 words or more")
    talk = Recompression(window)
    return rounds(docs, id_col, text_col, [talk.ask_symbols, talk.ask_high, talk.ask_windows], [number, holders, holders], talk.finish, RESULT)
