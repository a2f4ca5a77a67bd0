"""Quality classifier: random-indexing vectors, pooled, and a small calibrated network.

Each token has a sparse random index vector. A token's word vector is the sum
of the index vectors of its neighbours over the whole corpus, damped and scaled
to length one. Tokens are words (hashed into ``WORDS`` = 8,192 buckets at every
input size, so words of a bucket share a vector) and their shapes: what they are made
of, their case and length, whether they repeat the one before. A text is the
mean of its tokens' vectors. A two-layer network in numpy turns it into a
probability, and a temperature fitted on rows set apart calibrates it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._names import LOWER, mix
from .language_id import pieces

#: Hashed words, shapes, dimensions of a vector, neighbours on each side.
WORDS, SHAPES, DIM, REACH = 1 << 13, 1 << 10, 32, 2
#: Bound on the labelled rows that the network is fitted on.
MAX_LABELLED = 20_000
_CLASS = np.full(256, 2, np.uint8)  # 0 space, 1 letter, 2 other, 3 digit, 4 line end
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 4
_CLASS[48:58] = 3
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and shape of each token, and where each text's tokens start."""
    kind = _CLASS[raw]
    doc_start = np.zeros(len(raw) + 1, bool)
    doc_start[offs] = True
    new = doc_start[:-1].copy()
    if len(raw):
        new[0] = True
        new[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 4)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(raw))
    keep = kind[at] != 0
    spaced = np.concatenate([[True], ~keep[:-1]])[keep] if len(at) else keep
    at, end = at[keep], end[keep]
    if not len(at):
        return at, at, np.zeros(len(offs), np.int64)
    size = end - at
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    flat = np.repeat(at, size) + inner
    byte = LOWER[raw[flat]].astype(np.uint64)
    name = mix(np.add.reduceat(mix(byte + (np.minimum(inner, 63).astype(np.uint64) << np.uint64(8)) + np.uint64(1)), np.cumsum(size) - size))
    upper = (raw >= 65) & (raw <= 90)
    ups = np.concatenate([[0], np.cumsum(upper)])
    case = np.where(ups[end] - ups[at] == 0, 0, np.where((ups[end] - ups[at] == 1) & upper[at], 1, 2))
    same = np.concatenate([[False], name[1:] == name[:-1]])
    twice = np.concatenate([[False, False], name[2:] == name[:-2]])[: len(name)]
    shape = ((kind[at].astype(np.int64) % 5 * 3 + case) * 8 + np.minimum(size, 8) - 1) * 8 + same * 4 + twice * 2 + spaced
    first = np.searchsorted(at, offs)
    return (name & np.uint64(WORDS - 1)).astype(np.int64), shape % SHAPES, first


def _index(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs of each token's index vector."""
    h = mix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 32))
    place = np.stack([h & np.uint64(DIM - 1), (h >> np.uint64(8)) & np.uint64(DIM - 1)]).astype(np.int64)
    sign = np.stack([(h >> np.uint64(20)) & np.uint64(1), (h >> np.uint64(21)) & np.uint64(1)]).astype(np.float64) * 2 - 1
    return place, sign


def _add_contexts(table: np.ndarray, token: np.ndarray, first: np.ndarray, index) -> None:
    place, sign = index
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for step in range(1, REACH + 1):
        near = doc[step:] == doc[:-step]
        for own, other in ((token[step:], token[:-step]), (token[:-step], token[step:])):
            own, other = own[near], other[near]
            for k in range(2):
                table += np.bincount(own * DIM + place[k][other], sign[k][other], minlength=table.size)


def word_vectors(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all word buckets and shapes, from all of ``text``. What a task sends is of fixed size."""

    def collect(batches):
        words, shapes = np.zeros(WORDS * DIM), np.zeros(SHAPES * DIM)
        for batch in batches:
            for _, raw, offs in pieces(batch, 0):
                w, s, first = tokens(raw, offs)
                _add_contexts(words, w, first, _index(WORDS, 1))
                _add_contexts(shapes, s, first, _index(SHAPES, 2))
        both = np.concatenate([words, shapes]).reshape(16, -1)
        if both.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([x.astype("<f8").tobytes() for x in both], pa.binary())], ["part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<f8") for x in table["sums"])
        return pa.table({"part": table["part"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    rows = texts.select("text").mapInArrow(collect, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").collect()
    out = np.zeros((16, (WORDS + SHAPES) * DIM // 16))
    for r in rows:
        out[r.part] = np.frombuffer(r.sums, "<f8")
    flat = out.reshape(-1, DIM)
    flat = np.sign(flat) * np.log1p(np.abs(flat))
    flat /= np.linalg.norm(flat, axis=1, keepdims=True) + 1e-9
    flat = flat.astype(np.float32)
    for part, n, seed in ((flat[:WORDS], WORDS, 1), (flat[WORDS:], SHAPES, 2)):
        place, sign = _index(n, seed)
        for k in range(2):  # a token's own index vector tells it from others in like company
            part[np.arange(n), place[k]] += sign[k]
    return flat[:WORDS], flat[WORDS:]


def pool(raw: np.ndarray, offs: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Mean word and shape vector of each text, and its logarithmic length."""
    w, s, first = tokens(raw, offs)
    n = np.diff(first)
    out = np.zeros((len(n), 2 * DIM + 1), np.float32)
    full = np.flatnonzero(n > 0)
    if len(full):
        at = first[:-1][full]
        out[full, :DIM] = np.add.reduceat(words[w], at, axis=0) / n[full][:, None]
        out[full, DIM : 2 * DIM] = np.add.reduceat(shapes[s], at, axis=0) / n[full][:, None]
    out[:, -1] = np.log1p(n) / 8
    return out


class Network:
    """Two layers, fitted by Adam with balanced classes; then a temperature."""

    def __init__(self, hidden: int = 32, epochs: int = 60, seed: int = 4):
        self.hidden, self.epochs, self.seed = hidden, epochs, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        aside = rng.random(len(y)) < 0.2
        if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
            aside[:] = False
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, 0.1, self.hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        zs, ys = z[~aside], y[~aside]
        for _ in range(self.epochs):
            order = rng.permutation(len(ys))
            for k in range(0, len(ys), 64):
                a, b = zs[order[k : k + 64]], ys[order[k : k + 64]]
                h = np.maximum(a @ p[0] + p[1], 0)
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - b) / len(b)
                back = np.outer(d, p[2]) * (h > 0)
                t += 1
                for i, g in enumerate([a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d, d.sum(keepdims=True)]):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if aside.any():
            logit, target = self.logit(x[aside]), y[aside]
            grid = np.geomspace(0.5, 8, 41)
            loss = [np.mean(np.logaddexp(0, np.where(target == 1, -logit, logit) / c)) for c in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``: the probability of label 1.

    Word vectors come from all texts. Labels come from the rows of ``labels``
    (``id_col``, ``label_col``) for which ``train``, a condition on the id
    column named ``doc_id``, holds: all of them up to ``max_labelled``, else
    those with the least hashes; of documents that share a labelled id one is
    learned from. Null labels and ids are left out; without
    labels of both kinds every score is the share of label 1, or 0.5. Null and
    empty texts are scored like any others, repeated rows each by itself; other
    columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    words, shapes = word_vectors(own)
    shared = spark.sparkContext.broadcast((words, shapes))
    seen = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(train)
    picked = seen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def vectors(batches):
        for batch in batches:
            for part, raw, offs in pieces(batch, 2):
                x = pool(raw, offs, *shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], ["doc_id", "label", "vector"])

    known = own.join(picked, "doc_id").select("doc_id", "label", "text").mapInArrow(vectors, f"doc_id {kind}, label int, vector binary")
    # one row of fixed size for each picked id comes to the driver
    rows = known.groupBy("doc_id").agg(F.max(F.struct("label", "vector")).alias("x")).select("x.*").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.vector)))
    y = np.array([r.label for r in rows], np.float64)
    x = np.array([np.frombuffer(r.vector, "<f4") for r in rows]).reshape(len(rows), 2 * DIM + 1)
    net = Network().fit(x, y) if len(set(y)) == 2 else None
    flat = float(y.mean()) if len(y) else 0.5

    def run(batches):
        for batch in batches:
            for part, raw, offs in pieces(batch, 1):
                x = pool(raw, offs, *shared.value)
                score = net.score(x) if net else np.full(len(x), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score.astype(np.float64))], ["doc_id", "score"])

    return own.mapInArrow(run, f"doc_id {kind}, score double")
