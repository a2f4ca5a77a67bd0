"""Each operator against brute force, on rows with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import json
import random
import re

import numpy as np
import pytest

from rankforge.llm import byte_bpe, chat_format, exact_dedup, language_id, mixing, ngram_join, quality_classifier, quality_rules, substring_dedup, suffix_dedup
from rankforge.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(50)] + ["Été", "naïve", "A", "###"]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 25, 60, 90]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "Ünï", None]), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, " \n ", "en", "s1", 0), (903, "word " * 3000, "en", "s2", 0)]
    return rows + [rows[3], (None, "a b c d e f", "en", "s1", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, SCHEMA)


def bag(rows):
    return sorted(map(str, rows))


def covered(n, starts, size):
    out = [False] * n
    for s in starts:
        out[s : s + size] = [True] * size
    return out


def test_substring_dedup(docs):
    rows, df = docs
    ws = [WORD.findall(r[1] or "") for r in rows]
    seen = collections.Counter(tuple(w[k : k + 12]) for w in ws for k in range(len(w) - 11))
    want = []
    for r, w in zip(rows, ws, strict=True):
        gone = covered(len(w), [k for k in range(len(w) - 11) if seen[tuple(w[k : k + 12])] > 1], 12)
        want.append([r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)])
    assert bag(map(list, substring_dedup.dedup_substrings(df, window=12).collect())) == bag(want)


def test_suffix_dedup(docs):
    rows, df = docs
    key = lambda i: 1 << 62 if i is None else i
    first = {}
    bs = [(r[1] or "").encode() for r in rows]
    for r, b in zip(rows, bs, strict=True):
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], 1 << 63), key(r[0]))
    want = []
    for r, b in zip(rows, bs, strict=True):
        gone = covered(len(b), [k for k in range(len(b) - 49) if first[b[k : k + 50]] < key(r[0])], 50)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want.append([r[0], len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)])
    assert bag([*r[:4], bytes(r[4])] for r in suffix_dedup.dedup_suffixes(df).collect()) == bag(want)


def test_byte_bpe(docs):
    import base64

    import tiktoken

    rows, df = docs
    path, pattern = tokenizer()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.decode_ids(byte_bpe.encode_texts(df, path, pattern), path, pattern).collect()
    want = [(r[0], plain.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows]
    assert bag((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got) == bag(want)
    codec = byte_bpe.Codec(open(path, "rb").read(), pattern)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é漢\n 12'sx.!😀\t") for _ in range(rng.randrange(60))) for _ in range(200)] + ["a" * 3000, "=-" * 900, " " * 700]
    ids, count = codec.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [plain.encode_ordinary(t) for t in texts]


def test_exact_dedup(docs):
    rows, df = docs
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(AZ)].append(r[0])
    want = []
    for text, ids in groups.items():
        most, kept = max((i for i in ids if i is not None), default=None), False
        for i in ids:
            want.append([i, most, len(ids), i == most and not kept, hashlib.sha256(text.encode()).hexdigest()])
            kept |= i == most
    assert bag(map(list, exact_dedup.find_copies(df).collect())) == bag(want)
    assert exact_dedup.drop_copies(df).count() == len(groups)


def near(rows):
    sets = {}
    for k, r in enumerate(rows):
        w = WORD.findall((r[1] or "").translate(AZ))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min((x for x in (least.get(find(k)), r[0]) if x is not None), default=None)
    return [[r[0], len(sets[k]), least[find(k)]] for k, r in enumerate(rows)]


def test_ngram_join(docs):
    rows, df = docs
    assert bag(map(list, ngram_join.jaccard_components(df).collect())) == bag(near(rows))


def test_long_lists_and_survivors(spark, monkeypatch):
    """Large groups of near copies with lists longer than a block, null and repeated ids."""
    rng = random.Random(4)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        for k in range(40):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(60)] = f"e{rng.randrange(4)}"
            rows.append((100 * g + k, " ".join(w), None, None, 0))
    rows += [(None, rows[0][1], None, None, 0), (None, rows[0][1], None, None, 0), (0, rows[1][1], None, None, 0), rows[2], (None, None, None, None, None), (None, None, None, None, None), (7, " ", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = near(rows)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    assert bag(map(list, ngram_join.jaccard_components(df).collect())) == bag(want)
    least = [n[2] for n in want]
    kept = ngram_join.drop_near_copies(df).collect()
    assert len(kept) == len({c for c, n in zip(least, want, strict=True) if n[1]}) + 3
    assert {r.doc_id for r in kept if WORD.search(r.text or "")} == {c for c, n in zip(least, want, strict=True) if n[1]}


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    n, seen = len(w), collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    rep = sum(covered(n, [k for k in range(n - 7) if seen[tuple(w[k : k + 8])] > 1], 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n]


def test_quality_rules(docs):
    rows, df = docs
    got = quality_rules.apply_quality_rules(df).collect()
    assert bag(list(r)[:7] for r in got) == bag([r[0], *counts(r[1])] for r in rows)
    assert all(r.kept <= (not r.base_failed) for r in got)


def guilty_hosts():
    long = lambda k: " ".join(f"x{k}y{i}" for i in range(40))
    again = "a b c d e f g h " * 5
    rows = [(k, "short", "en", "bad", 0) for k in range(60)] + [(100 + k, again, "en", "loop", 0) for k in range(60)] + [(200, long(200), "en", "bad", 0), (201, long(201), "en", "loop", 0)]
    rows += [(300 + k, long(k) if k % 10 else "few words", "en", f"good{k % 7}", 0) for k in range(400)]
    return rows + [(800, long(8), "en", None, 0), (801, None, None, None, None), (802, "one", "en", "tiny", 0), (803, long(9), "en", "tiny", 0)]


def test_guilty_hosts_against_sql(spark, tmp_path):
    import duckdb

    from rankforge.llm import queries

    rows = guilty_hosts()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE["op10_quality_rules"])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert bag(map(list, got.select(names).collect())) == bag(map(list, want.fetchall()))
    by_id = {r.doc_id: r for r in got.collect()}
    assert (by_id[200].kept, by_id[200].base_failed, by_id[200].host_guilty) == (False, False, "short")
    assert (by_id[201].kept, by_id[201].host_guilty) == (False, "repeat") and by_id[803].kept and by_id[800].kept
    kept = {r.doc_id for r in quality_rules.drop_failed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {k for k, r in by_id.items() if r.kept}


def place(doc_id, seed=8):
    import struct

    import xxhash

    if doc_id is None:
        first = 42
    else:
        first = xxhash.xxh64(str(doc_id).encode(), seed=42).intdigest()
    return xxhash.xxh64(struct.pack("<i", seed), seed=first).intdigest() >> 38


def mix_by_hand(rows, shards, seed=8):
    """The shards that take each row, worked out in plain Python."""
    import struct

    import xxhash

    size = {k: len(WORD.findall(r[1] or "")) for k, r in enumerate(rows)}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[k] for k, r in enumerate(rows) if r[3] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > 2 * total[s]]
        target |= {s: 2.0 * total[s] for s in full} or {s: unit * weight[s] for s in open_}
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    quotas, sequence = [], {}
    for s in names:
        own = [(k, place(r[0])) for k, r in enumerate(rows) if r[3] == s]
        blocks = sorted({p >> 17 for _, p in own}, key=lambda b: np.int64(np.uint64(xxhash.xxh64(struct.pack("<i", seed), seed=xxhash.xxh64(struct.pack("<i", b), seed=42).intdigest()).intdigest())))
        n = int(target[s] // total[s]) if total[s] else 0
        draws, rest, sum_ = [(b, 1 << 26) for b in blocks * n], target[s] - n * total[s], 0
        for b in blocks:
            words = sum(size[k] for k, p in own if p >> 17 == b)
            if sum_ + words >= rest > sum_:
                cells, upto, past = sorted({p for _, p in own if p >> 17 == b}), 0, None
                for p in cells:
                    z = sum(size[k] for k, q in own if q == p)
                    upto += z
                    if upto - z / 2 <= rest - sum_:
                        past = p + 1
                draws.append((b, cells[0] if past is None else past))
                break
            if sum_ + words < rest:
                draws.append((b, 1 << 26))
            sum_ += words
        quotas.append(len(draws))
        sequence[s] = draws
    shares = mixing.split_tree(np.array(quotas), shards, seed)
    out = [[] for _ in rows]
    for s, share in zip(names, shares, strict=True):
        at = 0
        for shard, n in enumerate(share.tolist()):
            for b, past in sequence[s][at : at + n]:
                for k, r in enumerate(rows):
                    if r[3] == s and place(r[0]) >> 17 == b and place(r[0]) < past:
                        out[k].append(shard)
            at += n
    return size, total, target, out


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(5, 40), None, rng.choice(["a", "b", "b", "b", "c", None]), 0) for k in range(700)]
    rows += [(900, None, None, "a", 0), (901, "", None, "none", 0), (None, "x y", None, "a", 0), rows[5]]
    df = spark.createDataFrame(rows, SCHEMA)
    size, total, target, shards = mix_by_hand(rows, 4)
    want = bag([r[0], place(r[0]) >> 17, total[r[3]], round(target[r[3]], 6), shards[k]] for k, r in enumerate(rows))
    for most_broadcast in (1 << 17, 0):  # the table of blocks broadcast, and shuffled
        plan = mixing.plan_mix(df.repartition(7), shards=4, broadcast_rows=most_broadcast).collect()
        assert bag([r.row.doc_id, r.block, r.source_size, round(r.target, 6), r.shards] for r in plan) == want
    for s in total:
        taken = sum(size[k] * len(shards[k]) for k, r in enumerate(rows) if r[3] == s)
        assert target[s] <= 2 * total[s] + 1e-6 and abs(taken - target[s]) <= 60
    assert abs(sum(target.values()) - 1.5 * sum(total.values())) < 1e-6 * sum(total.values())
    drawn = mixing.draw_mix(df, shards=4).collect()
    assert bag([r.row.doc_id, r.copy, r.shard] for r in drawn) == bag([r[0], j, x] for k, r in enumerate(rows) for j, x in enumerate(shards[k]))
    share = mixing.split_tree(np.array([10, 0, 33]), 5, 1)
    assert share.sum(axis=1).tolist() == [10, 0, 33] and (share >= 0).all()
    assert mixing.fill_targets([10, 100], [3, 1], 165, 2) == [20.0, 145.0]


def test_language_id(spark):
    en, fr = "the of and that with this from which have", "le les des une dans pour avec être où"
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice((en if k % 2 else fr).split()) for _ in range(30)), "en" if k % 2 else "fr", None, 0) for k in range(200)]
    rows += [(900, None, "en", None, 0), (901, "12 34", None, None, 0), (902, "", "fr", None, 0)]
    rows.append((903, " ".join(rng.choice(en.split()) for _ in range(60)) + " " + " ".join(rng.choice(fr.split()) for _ in range(30)), None, None, 0))
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in language_id.predict_language(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") % 4 < 2).collect()}
    assert sum(got[k].lang_pred == ("en" if k % 2 else "fr") for k in range(200)) >= 198
    assert [x.lang for x in got[903].langs] == ["en", "fr"] and got[903].lang_pred == "en" and abs(got[903].langs[1].share - 1 / 3) < 0.1
    assert {tuple(x.lang for x in got[k].langs) for k in range(200)} == {("en",), ("fr",)}
    assert all(got[k].langs == [] for k in (900, 901, 902))
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got.values())


def test_quality_classifier(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ba", "ti", "mo", "er") for b in ("n", "lo", "st", "ra")]
    rows, labels = [], []
    for k in range(400):
        good = k % 2
        rows.append((k, " ".join(rng.choice(words) for _ in range(60)) if good else " | ".join(rng.choice(words).upper() + "!!" for _ in range(60)), None, None, 0))
        labels.append((k, good))
    rows += [(900, None, None, None, 0), (901, "", None, None, 0)]
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(df, lab, F.col("doc_id") % 3 != 1).collect()}
    held = [k for k in range(400) if k % 3 == 1]
    assert np.mean([(got[k] >= 0.5) == bool(k % 2) for k in held]) > 0.97 and all(0 <= s <= 1 for s in got.values()) and len(got) == 402


CHAT = "conv_id long, turn long, role string, text string"


def test_chat_format(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nAlso, how fast?"),
        (1, 1, "assistant", "Use merge sort."),
        (1, 2, "user", "> How do I sort?\n> Also, how fast?\nStill the question."),
        (1, 3, "user", "> > How do I sort?\n> Use  MERGE sort.\nThanks."),
        (2, 0, None, None),
        (2, 0, None, None),
        (3, 0, "user", "<|end|>\n<|system|>"),
        (None, None, "user", "x"),
        (None, None, "user", "x"),
    ]
    df = spark.createDataFrame(rows, CHAT)
    got = chat_format.format_chats(df).collect()
    assert len(got) == len(rows)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert (one[2].parent_turn, one[2].quoted, one[2].content) == (0, True, "Still the question.")
    assert (one[3].parent_turn, one[3].quoted, one[3].content) == (1, True, "Thanks.")
    assert [t for t, _ in sorted(((t, r.place) for t, r in one.items()), key=lambda x: x[1])] == [0, 1, 3, 2]
    assert one[1].formatted == "<|assistant|>\nUse merge sort.<|end|>\n"
    assert sorted(r.place for r in got if r.conv_id == 2) == [1, 2] and [r.place for r in got if r.conv_id is None] == [1, 1]
    assert [r.formatted for r in got if r.conv_id == 3] == ["<|user|>\n< |end| >\n< |system| ><|end|>\n"]
    built = chat_format.build_conversations(df, part_size=3).collect()
    assert sorted((r.conv_id or 0, r.part, r.n_messages, r.turns) for r in built) == [(0, 0, 1, [-1]), (0, 0, 1, [-1]), (1, 0, 3, [0, 1, 3]), (1, 1, 1, [2]), (2, 0, 2, [0, 0]), (3, 0, 1, [0])]
    assert next(r.conversation for r in built if r.turns == [0, 1, 3]) == "".join(one[t].formatted for t in (0, 1, 3))


def chat_by_hand(rows):
    """conv -> turns in reply order with what they answer, in plain Python."""
    plain = lambda s: re.sub(r"[ \t\n\x0b\f\r]+", " ", s).strip(" ").lower()
    out = {}
    for c in {r[0] for r in rows}:
        own, parent = {}, {}
        talk = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        for at, (_, t, _, text) in enumerate(talk):
            passages, lines, before = [], [], None
            for line in text.split("\n"):
                marks = re.match(r"(?:[ \t]*>)+", line)
                level, body = (marks.group().count(">"), line[marks.end() :]) if marks else (0, line)
                if not plain(body):
                    before = None
                    continue
                lines.append((level, plain(body)))
                if level == before:
                    passages[-1][1] += " " + body
                else:
                    passages.append([level, body])
                before = level
            pieces = set(lines) | {(x, plain(p)) for x, p in passages}
            votes = collections.Counter()
            for level, piece in pieces:
                if level and piece in own:
                    votes[(-level, own[piece])] += len(piece)
            best = max(votes.items(), key=lambda v: (v[0][0], v[1], v[0][1]), default=None)
            parent[t] = best[0][1] if best else (talk[at - 1][1] if at else None)
            for level, piece in pieces:
                if not level:
                    own[piece] = t
        thread, taken = {}, set()
        for _, t, _, _ in talk:
            p = parent[t]
            thread[t] = thread[p] if p is not None and p not in taken else t
            taken.add(p)
        out[c] = [(t, parent[t]) for t in sorted(parent, key=lambda t: (thread[t], t))]
    return out


def test_chat_format_against_brute_force(spark):
    rng, rows = random.Random(6), []
    for c in range(30):
        talk = []
        for t in range(rng.randrange(1, 14)):
            body = "\n".join(" ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4)))
            for _ in range(rng.randrange(3)):
                if talk:  # quote a message, nested quotes included, at times edited, cut, or in other case
                    quote = rng.choice(talk).split("\n")
                    quote = quote[: rng.randrange(1, len(quote) + 1)]
                    if rng.random() < 0.3:
                        quote[0] += " edited"
                    if rng.random() < 0.3:
                        quote = [q.upper().replace(" ", "  ") for q in quote]
                    body = "\n".join([rng.choice([">", "> ", " >"]) + q for q in quote] + rng.choice([[], [""]]) + [body])
            talk.append(body)
            rows.append((c, 3 * t, "user", body))
    got = chat_format.build_conversations(spark.createDataFrame(rows, CHAT), part_size=4).collect()
    built = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.conv_id, r.part)):
        built[r.conv_id] += zip(r.turns, r.parents, strict=True)
        assert "\n>" not in r.conversation and r.n_messages == len(r.turns) <= 4
    assert sum(r.n_quoted for r in got) > 40
    assert dict(built) == {c: [(t, -1 if p is None else p) for t, p in talk] for c, talk in chat_by_hand(rows).items()}


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    path, pattern = tokenizer()
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    chats = spark.createDataFrame([], CHAT)
    encoded = byte_bpe.encode_texts(none, path, pattern)
    found = [substring_dedup.dedup_substrings(none), suffix_dedup.dedup_suffixes(none), exact_dedup.find_copies(none), exact_dedup.drop_copies(none), ngram_join.jaccard_components(none), ngram_join.drop_near_copies(none)]
    found += [quality_rules.apply_quality_rules(none), quality_rules.drop_failed(none), encoded, byte_bpe.decode_ids(encoded, path, pattern), mixing.plan_mix(none), mixing.draw_mix(none), chat_format.format_chats(chats), chat_format.build_conversations(chats)]
    found += [quality_classifier.score_quality(none, labels, F.lit(True)), language_id.predict_language(none, F.lit(True))]
    none.write.parquet(str(tmp_path / "documents.parquet"))
    for out in [*found, corpus_pipeline.run(spark, str(tmp_path))]:
        assert out.count() == 0


CLASH = "keep_id string, size int, kept boolean, __own int, __place int, __block int, row int, block int, shards int, own int, at int, text_sha256 int, hot int, md5 int, id int, __row int, __host int, __tag int, host int, guilty int, g int, n_words int, place int, source_size int, draws int, __text int, n int, c int, t int"


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    path, pattern = tokenizer()
    extra = [x.split() for x in CLASH.split(", ")]
    words = " ".join(f"w{i}" for i in range(30))
    clash = spark.createDataFrame([(k, f"{words} {k % 2}", "en", "y", 1, *[{"string": "z", "boolean": True}.get(t, 5) for _, t in extra]) for k in (1, 2, 3, 4)], f"{SCHEMA}, {CLASH}")
    rows = {r.doc_id: r for r in clash.collect()}
    same = lambda out: out.columns == clash.columns and all(rows[r.doc_id] == r for r in out.collect())
    assert same(exact_dedup.drop_copies(clash)) and same(quality_rules.drop_failed(clash)) and same(ngram_join.drop_near_copies(clash)) and same(mixing.draw_mix(clash).select("row.*"))
    assert [r.doc_id for r in exact_dedup.drop_copies(clash).orderBy("doc_id").collect()] == [3, 4] and ngram_join.drop_near_copies(clash).count() == 1
    labels = clash.select("doc_id", F.lit(1).alias("quality"), "own", "n")
    encoded = byte_bpe.encode_texts(clash, path, pattern)
    for out in (substring_dedup.dedup_substrings(clash), suffix_dedup.dedup_suffixes(clash), encoded, byte_bpe.decode_ids(encoded, path, pattern), quality_classifier.score_quality(clash, labels, F.lit(True)), language_id.predict_language(clash, F.lit(True)), exact_dedup.find_copies(clash), ngram_join.jaccard_components(clash), quality_rules.apply_quality_rules(clash), mixing.plan_mix(clash)):
        assert out.count() == 4
    chats = spark.createDataFrame([(1, 0, "user", "a", 5, 5, 5), (1, 1, "user", "> a", 5, 5, 5)], CHAT + ", c int, place int, parent int")
    assert [r.turns for r in chat_format.build_conversations(chats).collect()] == [[0, 1]]


def test_many_rows_without_id(spark):
    """Rows without an id, or with the same one, are dealt apart; a very long text is worked on in pieces."""
    rows = [(None if k % 2 else 7, f"text {k} " + "and more words of it " * 5, None, None, 0) for k in range(300)] + [(1, "long " * 120_000, None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = {r.g for r in df.selectExpr("pmod(xxhash64(doc_id, text), 96) as g").distinct().collect()}
    assert len(parts) > 60
    got = suffix_dedup.dedup_suffixes(df).collect()
    assert sum(r.n_bytes for r in got) == sum(len(r[1]) for r in rows) and {r.n_removed for r in got if r.doc_id in (1, 7)} == {0}
    assert substring_dedup.dedup_substrings(df).where("doc_id = 1").first().n_removed == 120_000


def test_relays(spark, docs, monkeypatch):
    """Groups that write to relays give what groups that write to buckets give."""
    from rankforge.llm import _rounds

    df = docs[1]
    found = [lambda: substring_dedup.dedup_substrings(df, window=6), lambda: suffix_dedup.dedup_suffixes(df, length=40), lambda: ngram_join.jaccard_components(df)]
    plain = [bag(map(list, f().collect())) for f in found]
    monkeypatch.setattr(_rounds, "DIRECT", 8)
    monkeypatch.setattr(_rounds, "FAN", 5)
    assert [bag(map(list, f().collect())) for f in found] == plain


def test_repeated_labelled_ids(spark):
    """Documents that repeat an id bring no more rows to the driver than the bound, and keep their scores."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k % 40, f"word{k % 2} " * (9 + k % 3), None, None, 0) for k in range(400)], SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got = quality_classifier.score_quality(df, labels, F.lit(True), max_labelled=40).collect()
    assert len(got) == 400 and all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got)


def test_checkpoint_folder_must_be_shared():
    """On a cluster no folder of one machine serves checkpoints."""
    from types import SimpleNamespace as Fake

    from rankforge.llm._session import checkpoint_ready

    undefined = Fake(getCheckpointDir=lambda: Fake(isDefined=lambda: False))
    chosen = []
    sc = Fake(master="spark://host:7077", _jsc=Fake(sc=lambda: undefined), getConf=lambda: {}, setCheckpointDir=chosen.append)
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        checkpoint_ready(Fake(sparkContext=sc))
    sc.getConf = lambda: {"spark.checkpoint.dir": "shared"}
    checkpoint_ready(Fake(sparkContext=sc))
    assert chosen == ["shared"]


def test_pipeline(spark, tmp_path, docs):
    import base64

    import corpus_pipeline
    import tiktoken

    rows = [r for r in dict.fromkeys(docs[0]) if r[0] is not None]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    kept = [r for r in rows if not counts(r[1])[5]]
    groups = collections.defaultdict(list)
    for r in kept:
        groups[(r[1] or "").translate(AZ)].append(r)
    kept = sorted((max(g, key=lambda r: r[0]) for g in groups.values()), key=lambda r: r[0])
    kept = [r for r, n in zip(kept, near(kept), strict=True) if n[2] == r[0]]
    copies = {r[0]: len(x) for r, x in zip(kept, mix_by_hand(kept, 16)[3], strict=True)}
    path, pattern = tokenizer()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = [[r[0], plain.encode_ordinary(r[1])] for r in kept for _ in range(copies[r[0]])]
    got = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    assert bag([r.doc_id, np.frombuffer(r.ids, "<u4").tolist()] for r in got) == bag(want)
    assert json.dumps(want)
