"""Random streams in parts: generators set to any place of a seed's stream, and the counts of a stretch of samples.

A comparison's samples are drawn from one stream, as the seed gives it. A part
jumps to where its samples begin, so parts run side by side and their counts add
up to those of the whole stream, whatever the number of parts.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

#: Bits of the state of the Mersenne Twister, and words of its key.
_BITS, _KEY = 19937, 624

#: Numbers drawn at once: few enough for a core's cache, and for a product that BLAS doesn't spread over threads, as tasks have one core each.
BLOCK = 1 << 17
#: Words drawn at once where each is worked on by itself: few enough for their room to be used again.
DRAWN = 1 << 16


def _raw_words(key: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` words of the recurrence that begins with ``key``."""
    bits, out = np.random.MT19937(), [key]
    bits.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": _KEY}}
    while _KEY * len(out) < n:
        bits.random_raw(_KEY)  # a whole new key
        out.append(bits.state["state"]["key"].copy())
    return np.concatenate(out)[:n]


@lru_cache(maxsize=1)
def _taps() -> tuple[int, ...]:
    """Exponents, but for the highest, of the polynomial that the recurrence obeys: the shortest one that fits its last bits (Berlekamp and Massey)."""
    key = np.array(random.Random(1).getstate()[1][:-1], np.uint32)
    seen, have, old, length, gap = 0, 1, 1, 0, 1
    for n, bit in enumerate((_raw_words(key, 2 * _BITS + 64)[1:] & 1).tolist()):
        seen = seen << 1 | bit
        if (have & seen).bit_count() & 1:
            kept = have
            have ^= old << gap
            if 2 * length <= n:
                length, old, gap = n + 1 - length, kept, 0
        gap += 1
    assert length == _BITS
    return tuple(length - i for i in range(1, length + 1) if have >> i & 1)


@lru_cache(maxsize=256)
def _power(k: int) -> int:
    """x ** k modulo that polynomial, as bits."""
    taps, mask, r = _taps(), (1 << _BITS) - 1, 1
    for bit in bin(k)[2:]:
        r = int("0".join(bin(r)[2:]), 2) << (bit == "1")  # squared, times x
        while r >> _BITS:
            high, r = r >> _BITS, r & mask
            for t in taps:
                r ^= high << t
    return r


def twister_at(seed: int, words: int) -> np.random.RandomState:
    """The generator of ``random.Random(seed)`` after ``words`` 32-bit words were taken from it."""
    state = random.Random(seed).getstate()[1]
    key = np.array(state[:-1], np.uint32)
    same = np.random.RandomState()
    if words < 1 << 16:
        same.set_state(("MT19937", key, state[-1]))
        if words:  # none would still take one
            same.bytes(4 * words)
        return same
    at = np.flatnonzero(np.frombuffer(_power(words).to_bytes(_BITS // 8 + 1, "little"), np.uint8)[:, None] >> np.arange(8) & 1)
    run = _raw_words(key, _BITS + _KEY)
    same.set_state(("MT19937", np.array([np.bitwise_xor.reduce(run[at + j]) for j in range(_KEY)], np.uint32), _KEY))
    return same


def signs_at(seed: int, drawn: int) -> np.random.Generator:
    """``numpy.random.default_rng(seed)`` after ``drawn`` choices between two values: each takes half of a 64-bit word."""
    rng = np.random.default_rng(seed)
    rng.bit_generator.advance(drawn // 2)
    if drawn % 2:
        rng.integers(0, 2, 1)
    return rng


def _blocks(first: int, last: int, n: int):
    """Sizes of blocks of about ``BLOCK`` numbers, ``last - first`` samples of ``n`` in all."""
    rows = max(1, BLOCK // n)
    return (min(rows, last - at) for at in range(first, last, rows))


#: Columns that single precision adds up at once, and the sum up to which it counts whole numbers exactly.
_COLUMNS, _EXACT = 1 << 14, 1 << 24


class Reached:
    """Tells which rows of signs give a mean as large as the observed one; ties count up to rounding.

    Values are rounded to whole numbers small enough for single precision to add
    them up exactly, and what all roundings together can amount to is known. Rows
    that are nearer to the limit than that are counted again in double precision.
    """

    def __init__(self, values: np.ndarray, two_sided: bool):
        self.values, self.size = values, np.abs if two_sided else np.asarray
        self.limit = float(self.size(values.mean())) - 1e-12
        total = float(np.abs(values).sum())
        self.slack, self.coarse = 1e-12 * total, []
        for at in range(0, len(values), _COLUMNS):
            some = values[at : at + _COLUMNS]
            most = float(np.abs(some).sum())
            places = int(np.clip(np.floor(np.log2((_EXACT - len(some)) / most)), -900, 900)) if 0 < most < np.inf else 0
            whole = np.rint(np.ldexp(some, places))
            self.slack += float(np.abs(some - np.ldexp(whole, -places)).sum()) * (1 + 1e-9)
            self.coarse.append((at, whole.astype(np.float32), -places))

    def count(self, signs: np.ndarray) -> int:
        """Of the rows of ``signs``, -1 or 1 in single precision."""
        n, sums = len(self.values), np.zeros(len(signs))
        for at, whole, places in self.coarse:
            sums += np.ldexp((signs[:, at : at + len(whole)] @ whole).astype(float), places)
        over = self.size(sums) - n * self.limit
        near = ~(np.abs(over) > self.slack)
        hits = int(np.count_nonzero(over[~near] > 0))
        if near.any():
            hits += int((self.size(signs[near].astype(float) @ self.values / n) >= self.limit).sum())
        return hits


#: Signs of the eight bits of a byte, the lowest first: a bit that is set is a minus.
_OF_BYTE = (1 - 2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32))
#: 64-bit words of a unit of the recurrence, at most: few enough for what is added up to stay in a core's cache.
_UNIT = 16


def _top_bits(twister: np.random.RandomState, bits: int):
    """The top bits of every other word, 64 in one, at least ``bits`` of them in all.

    Every other term of a recurrence over bits obeys the same recurrence, and so
    does every term 2 ** k times as far away: one exclusive or of words, each tap a
    word for each unit of 64 bits, makes 64 bits of the stream. So the generator
    itself makes the first ones only.
    """
    words = min(-(-bits // 64), _BITS)
    drawn = np.concatenate([twister.randint(0, 2**32, size=128 * min(1024, words - at), dtype=np.uint32)[::2] >> np.uint32(31) for at in range(0, words, 1024)])
    have = np.packbits(drawn.astype(np.uint8), bitorder="little").view("<u8")
    yield have
    left, taps, unit = bits - 64 * words, _taps(), 1
    gap = _BITS - taps[0]
    while left > 0:
        while unit < _UNIT and len(have) >= 2 * unit * _BITS:
            unit *= 2
        held, step, turns = _BITS * unit, gap * unit, 2 * _BITS // gap
        room = np.empty(held + turns * step, have.dtype)
        room[:held] = have[-held:]
        for at in range(held, len(room), step):
            made = room[at : at + step]
            made[:] = room[at - held + taps[0] * unit :][:step]
            for t in taps[1:]:
                np.bitwise_xor(made, room[at - held + t * unit :][:step], out=made)
            yield made
            left -= 64 * step
            if left <= 0:
                return
        have = room


def _flips(twister: np.random.RandomState, rows, n: int):
    """Blocks of ``rows`` by ``n`` signs, a plus where ``random()`` is below one half."""
    rows = list(rows)
    stream, have, skip = _top_bits(twister, sum(rows) * n), [np.zeros(0, np.uint8)], 0
    for r in rows:
        size = -(-(skip + r * n) // 8)
        while sum(map(len, have)) < size:
            have.append(next(stream).view(np.uint8))
        found = np.concatenate(have)
        yield _OF_BYTE.take(found[:size], axis=0).reshape(-1)[skip : skip + r * n].reshape(r, n)
        have, skip = [found[(skip + r * n) // 8 :].copy()], (skip + r * n) % 8


def sign_flip_hits(values: np.ndarray, seed: int, first: int, last: int, tests: list[tuple[float, bool]]) -> list[int]:
    """Of the samples ``first`` to ``last`` of a sign-flip test: those with a mean as large as the observed one; ties count up to rounding.

    A count for each ``shift, two_sided`` of ``tests``, which are drawn once: the test is of the values and their shift.
    """
    n, hits = len(values), [0] * len(tests)
    reached = [Reached(values + shift, two_sided) for shift, two_sided in tests]
    for signs in _flips(twister_at(seed, 2 * first * n), _blocks(first, last, n), n):
        hits = [h + r.count(signs) for h, r in zip(hits, reached, strict=True)]
    return hits


def randomization_hits(values: np.ndarray, seed: int, first: int, last: int) -> int:
    """Of the samples ``first`` to ``last`` of a two-sided randomisation test: those as large as the observed mean."""
    n, hits, reached = len(values), 0, Reached(values, True)
    odd = first * n % 2  # the second half of a word that the sample before has the first half of
    words = signs_at(seed, first * n - odd).bit_generator
    room = np.empty(max(1, BLOCK // n) * n // 2 + 2, "<u8")
    begin = 0  # of what is to be drawn: one word may be left from the block before
    for rows in _blocks(first, last, n):
        end = (odd + rows * n + 1) // 2
        for at in range(begin, end, DRAWN):
            made = room[at : min(at + DRAWN, end)]
            # a choice is the top bit of half a word, the low half first; as a number's sign it is the other way round, which two sides don't tell
            np.bitwise_and(words.random_raw(len(made)), np.uint64(0x8000000080000000), out=made)
            np.bitwise_or(made, np.uint64(0x3F8000003F800000), out=made)
        hits += reached.count(room.view("<f4")[odd : odd + rows * n].reshape(rows, n))
        odd = begin = (odd + rows * n) % 2
        room[0] = room[end - 1]
    return hits


def word_range(n: int, samples: int, part: int, parts: int) -> tuple[int, int]:
    """The words that a part of a bootstrap counts: about as many are drawn in all as the samples need, since some are passed over."""
    words = samples << n.bit_length()
    return words * part // parts, words * (part + 1) // parts


def _indices(twister: np.random.RandomState, words: int, n: int) -> np.ndarray:
    """What ``randrange(n)`` makes of the next words: their top bits, those beyond ``n`` passed over."""
    word = twister.randint(0, 2**32, size=words, dtype=np.uint32) >> np.uint32(32 - n.bit_length())
    return word[word < n]


def count_indices(n: int, seed: int, samples: int, part: int, parts: int) -> int:
    """How many indices a part's words give."""
    first, last = word_range(n, samples, part, parts)
    twister, found = twister_at(seed, first), 0
    for at in range(first, last, BLOCK):
        found += len(_indices(twister, min(BLOCK, last - at), n))
    return found


def _ordered_indices(words: np.random.Generator, bits: int, size: int) -> np.ndarray:
    """The top ``bits`` of the next ``size`` words, an even number: two are drawn at once, the first the upper half."""
    two = words.integers(0, 2**64 - 1, size // 2, dtype=np.uint64, endpoint=True)
    out = np.empty((size // 2, 2), np.int64)
    out[:, 0] = two >> np.uint64(64 - bits)
    two <<= np.uint64(32)
    out[:, 1] = two >> np.uint64(64 - bits)
    return out.reshape(-1)


def bootstrap_means(values: np.ndarray, seed: int, samples: int, part: int, parts: int, before: int, found: int) -> np.ndarray:
    """Means of the resamples that begin among a part's indices, of which there are ``found`` after ``before`` in earlier parts. The last part takes all that are left.

    Values are added up as whole numbers of 62 bits a sample, so sums don't depend
    on where parts and blocks begin. Indices that are passed over find a zero.
    """
    n = len(values)
    first, last = -(-before // n), samples if part == parts - 1 else min(samples, -(-(before + found) // n))
    if first >= last:
        return np.zeros(0)
    bits, places, table = n.bit_length(), 0, values
    if np.isfinite(values).all():
        places = int(62 - bits - np.frexp(np.abs(values).max())[1])
        table = np.rint(np.ldexp(values, places)).astype(np.int64)
    table = np.concatenate([table, np.zeros((1 << bits) - n, table.dtype)])
    words = np.random.Generator(twister_at(seed, word_range(n, samples, part, parts)[0])._bit_generator)
    left, sums, held = first * n - before, [], table.dtype.type(0)  # indices until the next sample begins, and the sum so far
    begun, wanted = left == 0, last - first
    left = left or n
    while len(sums) < wanted:
        size = min(DRAWN, max(1024, (left + (wanted - len(sums) - begun) * n) // 2 * 2))
        at = _ordered_indices(words, bits, size)
        got, inside = table.take(at, mode="wrap"), at < n
        count = int(np.count_nonzero(inside))
        if count < left:
            held, left = held + got.sum(), left - count
            continue
        ends = np.flatnonzero(inside)[left - 1 :: n] + 1  # of samples
        cut = np.concatenate([[0], ends[ends < size]])
        pieces = np.add.reduceat(got, cut)
        pieces[0] += held
        done = pieces[: len(ends)]
        sums.extend(done[0 if begun else 1 :].tolist())
        held = pieces[-1] if len(cut) > len(ends) else table.dtype.type(0)
        left, begun = n - (count - left) % n, True
    return np.ldexp(np.array(sums[:wanted], float) / n, -places)
