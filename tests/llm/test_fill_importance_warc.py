"""Fill-in-the-middle, importance resampling and WARC against brute force, on nulls, ties, repeats, long texts and empty tables."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rankforge.llm import fill_middle, importance, warc

SCHEMA = "doc_id long, text string, n long, form string, rank long, key string"


def corpus():
    rng = random.Random(11)
    parts = ["word", "Été", "naïve", " ", "\n", "<", ">", "P", "S", "x" * 40, "12", "日本", "😀", "<P", "a<M>b"]
    texts = ["".join(rng.choices(parts, weights=[9, 3, 3, 9, 3, 1, 1, 1, 1, 2, 2, 2, 2, 0.3, 0.1], k=rng.choice([0, 1, 2, 9, 40, 400]))) for _ in range(150)]
    texts += [None, "", "<P>", "abc", "-", "word " * 9000, "x" * 50_000, "é" * 20_000, texts[5], "a<", "S>"]
    rows = [(k, t, 1, "f", 2, "k") for k, t in enumerate(texts)]
    return rows + [rows[3], rows[155], (None, "some words here", None, None, None, None), (None, None, 1, "a", 1, "")]


def h(seed, i, k):
    return int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16)


def filled(i, text):
    t = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    a, b = sorted((h(1, i, 0) % (len(u) + 1), h(1, i, 1) % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in fill_middle.SENTINELS) or h(1, i, 2) % 100 >= 90:
        return (i, len(u), "plain", None, None, t, t)
    spm = h(1, i, 3) % 100 < 20
    return (i, len(u), "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}", t)


@pytest.mark.parametrize("chunk", [fill_middle.CHUNK, 3, 100])
def test_fill_in_middle(spark, chunk):
    rows = [r for r in corpus() if chunk > 50 or len(r[1] or "") < 3000]
    out = fill_middle.fill_in_middle(spark.createDataFrame(rows, SCHEMA), chunk=chunk)
    out = out.withColumn("restored", fill_middle.restore(out.output, out.form))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(filled(r[0], r[1])) for r in rows)


def test_fill_in_middle_of_nothing(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_automaton_functions_compose():
    """Functions of any parts compose to the function of the whole, for each entry state."""
    rng = random.Random(3)
    for _ in range(30):
        text = "".join(rng.choices("<>PSMab 1é", k=rng.randrange(1, 300)))
        marks = sorted(rng.sample(range(1, len(text)), k=min(5, len(text) - 1)))
        parts = [text[a:b] for a, b in zip([0, *marks], [*marks, len(text)], strict=True)]
        whole, scan = fill_middle.Scan([text]), fill_middle.Scan(parts)
        after, count = fill_middle.prefixes(scan.after, scan.count)
        assert (after[-1] == whole.after[0]).all() and (count[-1] == whole.count[0]).all()
        assert count[-1, 0] & 0xFFFFFFFF == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text)) and count[-1, 0] >> 32 == len(re.findall("<[PSM]>", text))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))


def grams(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(rows, target):
    s, t = Counter(g for r in rows for g in grams(r[1])), Counter(g for x in target for g in grams(x))
    sn, tn = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (sn + 10000.0) / ((s[b] + 1.0) * (tn + 10000.0)))) for b in range(10000)}
    out = []
    for r in rows:
        g, x = grams(r[1]), h(42, r[0], 0)
        weight = sum(gain[b] for b in g)
        out.append([r[0], len(words(r[1])), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296)))])
    can = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(can):
        r.append(k + 1 if k < len(can) * 20 // 100 else None)
    return [r if len(r) == 6 else [*r, None] for r in out]


def test_importance_resampling(spark, monkeypatch):
    rows = corpus() + [(700 + k, f"the {'quick ' * (k % 4)}brown fox {k % 7} jumps over the lazy dog " * 3, 1, "f", 2, "k") for k in range(80)]
    rows += [(800, "w" * 70 + " " + "v" * 1000 + " the fox", 1, "f", 2, "k")]
    target = ["The quick brown fox", None, "", "the lazy dog jumps"]
    docs, goal = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, goal, percent=20).collect()
    assert sorted(map(str, map(list, got))) == sorted(map(str, resampled(rows, target)))


def test_importance_resampling_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert importance.resample(none, none).collect() == []
    one = importance.resample(spark.createDataFrame([(1, "a b", 1, "", 1, "")], SCHEMA), none).first()
    assert one.rank is None and one.n_features == 3


def test_runs_over_blocks(monkeypatch):
    """A text of many blocks has the features of one block, and sums follow from words' sums."""
    monkeypatch.setattr(importance, "_WORDS", 5)
    monkeypatch.setattr(importance, "_BYTES", 16)
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "bb", "Éc", "d" * 90], k=rng.randrange(0, 40))) for _ in range(30)]
    got = [Counter() for _ in texts]
    read = np.zeros(len(texts), int)
    for owner, sums, seen in importance.features(iter(texts)):
        for o, x in zip(owner.tolist(), sums.tolist(), strict=True):
            got[o][x % 10000] += 1
        read += np.bincount(seen, minlength=len(texts))
    assert got == [Counter(grams(t)) for t in texts] and read.tolist() == [len(words(t)) for t in texts]


PAGES = "page_id long, url string, html string, type string, payload string"


def pages():
    rng = random.Random(7)
    long_ = ["".join(rng.choices("abé日\r\n <>", k=k)) for k in (99, 100, 5000, 20_000, 60_000)]
    rows = [(k, f"http://h/{k}", rng.choice([*long_, "", "short", None]), "x", "y") for k in range(120)]
    rows += [(500, None, long_[2], "x", "y"), (None, "http://n", long_[3], "x", "y"), (None, None, None, "x", "y"), (501, "http://a\r\nX: 1", "only " * 9000, "x", "y")]
    return rows + [rows[-1], rows[0], (-3, "u", long_[4], "x", "y"), (-3, "u", long_[4], "x", "y")]


def archived(rows):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[2] or ""] = min(first.get(r[2] or "", r[0]), r[0])
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and first.get(html, i) != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return out


@pytest.mark.parametrize("how", ["none", "gzip"])
def test_warc_round_trip(spark, tmp_path, how):
    rows = pages()
    path = str(tmp_path / "warc")
    warc.write_warc(spark.createDataFrame(rows, PAGES), path, archive=100_000, segment=3000, frame=700, compression=how)
    got = warc.read_warc(spark, path).cache()
    assert got.where("problem is not null").count() == 0
    held = Counter((r.page_id, bytes(r.payload)) for r in got.where("type = 'response'").collect())
    assert held == Counter((None if i is None else str(i), (html or "").encode()) for (i, _, html, *_), a in zip(rows, archived(rows), strict=True) if a[3] == "response")
    narrow = got.selectExpr("record_id", "type", "page_id", "refers_to", "cast(octet_length(payload) as long) payload_bytes", "sha2(payload, 256) payload_digest")
    out = [(None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in warc.resolve_revisits(narrow).collect()]
    assert sorted(map(str, out)) == sorted(map(str, archived(rows)))


def test_warc_of_nothing(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_warc_faults(spark, tmp_path):
    """A lost segment, a wrong total, changed bytes, cut files and orphans each name their fault; other records are read all the same."""
    html = "text " * 2000
    digest = hashlib.sha256(html.encode()).hexdigest()
    make = lambda i: list(warc._records_of(i, "u", html.encode(), digest, None, None, False, "d", 3000, 700))
    ok, lost, total, orphan = make(1), make(2), make(3), make(4)
    total[-1] = re.sub(rb"Segment-Total-Length: \d+", b"Segment-Total-Length: 7", total[-1])
    changed = next(warc._records_of(5, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None, None, False, "d", 3000, 700)).replace(b"abc", b"abd")
    unended = make(6)[:-1]
    parts = [*ok, lost[0], *lost[2:], *total, *orphan[1:], changed, *unended]
    random.Random(1).shuffle(parts)
    (tmp_path / "a").mkdir()
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi"
    (tmp_path / "a/1.warc").write_bytes(b"\r\n\r\n".join([info, *parts, b""]))
    cut = next(warc._records_of(7, "u", b"cut short", hashlib.sha256(b"cut short").hexdigest(), None, None, False, "d", 3000, 700))
    (tmp_path / "a/2.warc.gz").write_bytes(gzip.compress(info + b"\r\n\r\n") + gzip.compress(cut[:-4]))
    got = {(r.page_id, r.problem): r for r in warc.read_warc(spark, str(tmp_path / "a")).collect()}
    assert {k for k in got} == {("1", None), ("2", "missing segment"), ("3", "wrong total length"), (None, "no first segment"), ("5", "wrong block digest"), ("6", "no last segment"), ("7", "truncated record")}
    assert bytes(got["1", None].payload) == html.encode() and got["2", "missing segment"].payload is None


def test_transfer_framing():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, chunked\r\n\r\n"
    assert warc.unframed(head + b"3;x=y\r\nabc\r\nA\r\n0123456789\r\n0\r\nTrailer: x\r\n\r\n") == b"abc0123456789"
    assert warc.unframed(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nrest\r\n\r\n") == b"rest\r\n\r\n"
    for bad in (b"no header", head + b"x\r\nabc\r\n0\r\n\r\n", head + b"5\r\nabc\r\n0\r\n\r\n", head + b"3\r\nabc\r\n"):
        with pytest.raises(ValueError, match="chunk|header"):
            warc.unframed(bad)
