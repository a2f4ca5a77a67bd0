"""Recompression over names that a round gives out, against brute force over small vocabularies, runs and edits."""

import collections
import random

import numpy as np
import pytest
from dialogue import hold

from rankforge.llm import substring_dedup
from rankforge.llm._rounds import holders
from rankforge.llm.suffix_dedup import number


def dialogue(groups, window, name=number):
    talk = substring_dedup.Recompression(window)
    rows = hold(groups, [talk.ask_symbols, talk.ask_high, talk.ask_windows], [name, holders, holders], talk.finish)
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows)


def brute(rows, window):
    texts = {i: (t or "").split() for i, t in rows}
    seen = collections.Counter(tuple(w[k : k + window]) for w in texts.values() for k in range(len(w) - window + 1))
    out = []
    for i, w in sorted(texts.items()):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = True
        out.append((i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["a", "b"] if seed % 3 == 0 else [f"w{k}" for k in range(5 if seed % 3 == 1 else 200)]
    pool = [[rng.choice(vocab) for _ in range(rng.choice([5, 34, 35, 36, 80, 400]))] for _ in range(6)] + [["a"] * 90, ["a", "b"] * 50]
    rows = [(100, None), (101, ""), (102, " \n ")]
    for i in range(30):
        w = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(rng.choice([[], [f"own{i}"], rng.choice(pool)]) + w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(24))
def test_same_as_brute_force(seed):
    rows, window = corpus(seed), 35 if seed % 2 else 6
    want = brute(rows, window)
    for parts in (1, 4, 33):
        assert dialogue([rows[k::parts] for k in range(parts)], window) == want


def test_high_symbols_are_of_global_names(monkeypatch):
    """Numbers that differ between groups hide every repeat in which a low symbol is."""
    shared = " ".join(f"w{k}" for k in range(600))
    groups = [[(1, "x " + shared)], [(2, "y " + shared)]]
    assert [r[2] for r in dialogue(groups, 35)] == [600, 600]

    def apart(names, columns):
        return np.arange(1, len(names) + 1, dtype=np.uint64)

    assert [r[2] for r in dialogue(groups, 35, apart)] == [0, 0]
