"""Rows alike in masses, the light half of the n-gram join, and white space at the end of a text."""

import base64
import itertools
import random

import pytest

from rankforge.llm import _rounds, byte_bpe, ngram_join, substring_dedup, suffix_dedup
from rankforge.llm.queries import tokenizer

SCHEMA = "doc_id long, text string"


def test_rows_alike_are_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(_rounds, "ALIKE", 50)
    alike = "the same words in each of these rows and some more of them here again " * 2
    rows = [(None, alike)] * 2000 + [(None, None)] * 300 + [(7, alike)] * 200 + [(k, f"w{k} " * 40) for k in range(20, 40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    seen = []
    true_rounds = _rounds.rounds

    def watched(*args, **named):
        out = true_rounds(*args, **named)
        seen.append(out)
        return out

    monkeypatch.setattr(ngram_join, "rounds", watched)
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.n_shingles and r.doc_id in (None, 7)} == {7}
    ones = substring_dedup.dedup_substrings(docs, window=12).collect()
    assert len(ones) == len(rows) and all(r.n_removed == r.n_words for r in ones if r.doc_id in (None, 7))
    kept = suffix_dedup.dedup_suffixes(docs).collect()
    assert len(kept) == len(rows)
    assert all((r.n_removed > 0) == (r.doc_id is None and r.n_bytes > 0) for r in kept if r.doc_id in (None, 7))


def brute(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("boundary", [0, 3, 9, 40])
def test_light_and_heavy_halves_agree(spark, monkeypatch, boundary):
    rng = random.Random(boundary)
    bases = [[f"v{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 5, 6, 9, 12, 20, 30]))] for _ in range(14)]
    rows = []
    for i in range(150):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1])):
            w[rng.choice([0, -1])] = f"v{rng.randrange(60)}"
        rows.append((i, " ".join(w + [f"v{rng.randrange(3)}"] * rng.choice([0, 0, 1]))))
    monkeypatch.setattr(ngram_join, "_choose_boundary", lambda *_: min(boundary, ngram_join.most_light(80)))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_subsets_of_a_set_are_bounded():
    from math import comb

    x = ngram_join.most_light(80)
    assert 10 <= x < 64
    worst = lambda x: max(comb(n, ngram_join.least_overlap(n, m, 80)) for n in range(1, x * 100 // 80 + 1) for m in range(-(-80 * n // 100), n * 100 // 80 + 1) if min(n, m) <= x)
    assert worst(x) <= ngram_join.SUBSETS < worst(x + 1)


def test_white_space_before_a_last_space(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    ranks = {bytes([k]): k for k in range(256)} | {b"\n ": 256, b" b": 257, b"\t ": 258, b"a\n": 259}
    path = tmp_path / "small.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["a\n ", "a\n b", "a \n", "\n ", "a\t ", " ", "a ", "a\n \n ", "b\n  b\n ", "  ", "a  "] + ["".join(random.Random(k).choices("ab \n\t", k=9)) for k in range(60)]
    got = byte_bpe.encode_texts(spark.createDataFrame(list(enumerate(texts)), SCHEMA), str(path), public_tokenizers.PATTERN).select("doc_id", "ids").collect()
    for r in got:
        assert list(memoryview(bytes(r.ids)).cast("I")) == enc.encode_ordinary(texts[r.doc_id]), texts[r.doc_id]


def test_one_worker_encodes_and_decodes_as_two(spark):
    from rankforge.llm.queries import tokenizer

    path, pattern = tokenizer()
    rng = random.Random(8)
    rows = [(k, "".join(rng.choices(["word", " ", "\n", "É", "日本", "12", "'s"], k=rng.randrange(60)))) for k in range(80)] + [(90, None), (91, ""), (None, "a b"), (90, None), (92, "long " * 30_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one, two = byte_bpe.encode_and_decode(docs, path, pattern), byte_bpe.decode_ids(byte_bpe.encode_texts(docs, path, pattern), path, pattern)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert sorted(bytes(r.decoded).decode() for r in one.collect()) == sorted(t or "" for _, t in rows)
    assert byte_bpe.encode_and_decode(docs.limit(0), path, pattern).count() == 0


def test_decode_null_ids(spark):
    path, pattern = tokenizer()
    rows = [(1, 1, bytes([5, 0, 0, 0])), (2, None, None), (None, 0, b""), (2, None, None), (4, None, bytes([7, 0, 0, 0]))]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, ids binary")
    got = [(r.doc_id, r.n_tokens, len(r.decoded) > 0) for r in byte_bpe.decode_ids(df, path, pattern).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (2, None, False), (None, 0, False), (2, None, False), (4, None, True)], key=str)
