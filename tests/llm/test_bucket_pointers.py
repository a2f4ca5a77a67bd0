"""Bucket-pointer refinement against brute force, its dialogue held in one process over small alphabets, runs and edits."""

import random

import numpy as np
import pytest
from dialogue import hold

from rankforge.llm import suffix_dedup
from rankforge.llm._rounds import earlier

LENGTH = 32


def dialogue(groups, number=suffix_dedup.number):
    """What the groups' documents keep."""
    talk = suffix_dedup.Refinement(LENGTH)
    rows = hold(groups, [talk.ask_suffixes, talk.ask_extents, talk.ask_windows], [number, suffix_dedup.settle, earlier], talk.finish)
    return {row["doc_id"]: (row["n_removed"], row["kept"]) for row in rows}


def brute(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - LENGTH + 1):
            if first.setdefault(raw[k : k + LENGTH], i) < i:
                gone[k : k + LENGTH] = True
        out[i] = (int(gone.sum()), bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 3 else "abcdefgh é"
    pool = ["".join(rng.choice(letters) for _ in range(rng.choice([20, 31, 32, 60, 200]))) for _ in range(6)] + ["a" * 90, "ab" * 70, None, ""]
    rows = []
    for i in range(40):
        text = rng.choice(pool)
        if text and rng.random() < 0.7:
            for _ in range(rng.choice([0, 1, 1, 3])):
                k = rng.randrange(len(text))
                text = text[:k] + rng.choice(letters) + text[k + rng.choice([0, 1]) :]
            text = rng.choice(["", "b" * 40, text]) + text
        rows.append((i, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(30))
def test_same_as_brute_force(seed):
    rows = corpus(seed)
    want = brute(rows)
    for parts in (1, 3, 40):
        assert dialogue([rows[k::parts] for k in range(parts)]) == want


def test_pieces_of_a_text(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 64)
    rows = corpus(1) + corpus(3)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    assert dialogue([rows[k::5] for k in range(5)]) == brute(rows)


def test_pointers_stand_for_the_bytes_of_a_24_gram():
    """With wrong numbers, texts that differ in the 24-gram of a bucket alone are taken for equal: nothing else tells them apart."""
    rows = corpus(2)

    def one_number(names, columns):
        return np.minimum(suffix_dedup.number(names, columns), 1)

    keep = suffix_dedup._READER
    try:
        suffix_dedup._READER = np.uint64(0)
        assert dialogue([rows[k::40] for k in range(40)]) == brute(rows)
        assert dialogue([rows[k::40] for k in range(40)], one_number) != brute(rows)
    finally:
        suffix_dedup._READER = keep
