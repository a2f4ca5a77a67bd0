"""Language ID by multilingual mixture inference.

Each language is a smoothed distribution of hashed byte trigrams, counted over
all labelled texts. A text's words get a likelihood under each language from
their trigrams; expectation-maximisation then estimates the proportions of
languages in the text. Sets of its likeliest languages, one larger each time,
are compared by log-likelihood less a penalty for each language more; the
prediction is the language with the largest proportion in the best set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._names import SPACE, mix

BUCKETS = 1 << 14
#: Bytes of text that are worked on at a time.
_STEP = 1 << 20
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LANGS = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def pieces(batch, text: int):
    """Slices of a batch with about ``_STEP`` bytes, as (slice, bytes, offsets)."""
    col = batch.column(text).cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + _STEP)))
        hi = min(hi, len(col))
        yield batch.slice(lo, hi - lo), raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Bucket of the folded trigram around each byte; non-letters are one space."""
    x = _FOLD[raw].astype(np.uint64)
    pad = np.concatenate([[np.uint64(32)], x, [np.uint64(32)]])
    return (mix(pad[:-2] << np.uint64(16) | x << np.uint64(8) | pad[2:]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def count_languages(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Trigram counts of each language over all of ``lang, text``: BUCKETS numbers a language on the driver."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, raw, offs in pieces(batch, 1):
                gram, letter = trigrams(raw), _FOLD[raw] != 32
                names, code = np.unique(np.array(part.column(0).to_pylist(), object).astype(str), return_inverse=True)
                lang = np.repeat(code, np.diff(offs))
                table = np.bincount(lang[letter] * BUCKETS + gram[letter], minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names.tolist()):
                    held[name] = held.get(name, 0) + table[k]
        for name, t in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([t.astype("<i8").tobytes()], pa.binary())], ["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        t = sum(np.frombuffer(x.as_py(), "<i8") for x in table["counts"])
        return pa.table({"lang": table["lang"][:1], "counts": pa.array([t.tobytes()], pa.binary())})

    found = rows.select("lang", "text").mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()
    found.sort(key=lambda r: r.lang)
    return [r.lang for r in found], np.array([np.frombuffer(r.counts, "<i8") for r in found]).reshape(len(found), BUCKETS)


def infer(like: np.ndarray, offs: np.ndarray, steps: int = 8, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the best language, its proportion, and the proportions of the chosen set, from words' log-likelihoods (word, language)."""
    n_docs, n_lang = len(offs) - 1, like.shape[1]
    best, score, mixture = np.full(n_docs, -1), np.zeros(n_docs), np.zeros((n_docs, n_lang))
    size = np.diff(offs)
    full = np.flatnonzero(size > 0)
    if not len(full) or not n_lang:
        return best, score, mixture
    doc, at = np.repeat(np.arange(len(full)), size[full]), offs[:-1][full]
    top = like.max(axis=1, keepdims=True)
    p = np.exp(like - top, dtype=np.float64)

    def em(share: np.ndarray, times: int) -> np.ndarray:
        for _ in range(times):
            r = p * share[doc]
            r /= r.sum(axis=1, keepdims=True) + 1e-300
            share = np.add.reduceat(r, at, axis=0) / size[full][:, None]
        return share

    share = em(np.full((len(full), n_lang), 1 / n_lang), steps)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    best_value, chosen, proportion = np.full(len(full), -np.inf), order[:, 0].copy(), share[np.arange(len(full)), order[:, 0]]
    for k in range(1, n_lang + 1):
        part = np.where(rank < k, np.maximum(share, 1e-9), 0)
        part /= part.sum(axis=1, keepdims=True)
        if 1 < k < n_lang:
            part = em(part, 2)
        value = np.add.reduceat(np.log((p * part[doc]).sum(axis=1) + 1e-300), at) - penalty * (k - 1) * np.log(size[full] + 1)
        better = value > best_value
        mixture[full[better]] = part[better]
        best_value[better] = value[better]
        lead = part.argmax(axis=1)
        chosen[better] = lead[better]
        if k > 1:
            proportion[better] = part[np.arange(len(full)), lead][better]
    best[full], score[full] = chosen, np.clip(proportion, 0, 1)
    return best, score, mixture


def predict_language(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, lang_pred, score, langs`` for each row of ``docs``.

    ``langs`` is the chosen set: an array of ``lang, share``, largest share first.

    Languages are learned from all rows for which ``train`` holds and whose
    text and language are not null; nothing but the text enters a prediction.
    ``und``, 0 and an empty set go to null texts, texts without letters, and all texts if
    nothing could be learned. The counts of each language, 128 KB, are held by
    the driver and every worker; languages are few by nature. Repeated rows
    count each time and are answered each; other columns are not read; an empty
    table gives an empty result.
    """
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    seen = docs.where(train).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text).where("lang is not null and text is not null")
    names, counts = count_languages(seen)
    table = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32).T.copy()
    shared = docs.sparkSession.sparkContext.broadcast((names, table))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        names, table = shared.value
        for batch in batches:
            for part, raw, offs in pieces(batch, 1):
                letter = _FOLD[raw] != 32
                word = ~SPACE[raw]
                start = word.copy()
                start[1:] &= ~word[:-1]
                at = offs[:-1][np.diff(offs) > 0]
                start[at] = word[at]
                number = np.cumsum(start) - 1
                use = np.flatnonzero(letter & word)
                gram, owner = trigrams(raw)[use], number[use]
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(use) else use
                like = np.add.reduceat(table[gram], first, axis=0) if len(use) else np.zeros((0, len(names)), np.float32)
                words = np.searchsorted(use[first], offs)
                best, score, mixture = infer(like, words)
                texts = part.column(1)
                pred, sets = [], []
                for k, b in enumerate(best.tolist()):
                    ok = b >= 0 and (bool(((raw[offs[k] : offs[k + 1]] | 32) - 97 < 26).any()) or any(c.isalpha() for c in texts[k].as_py()))
                    pred.append(names[b] if ok else "und")
                    score[k] = score[k] if ok else 0.0
                    held = np.flatnonzero(mixture[k]) if ok else []
                    sets.append([{"lang": names[j], "share": float(mixture[k, j])} for j in sorted(held, key=lambda j: -mixture[k, j])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(sets, _LANGS)], ["doc_id", "lang_pred", "score", "langs"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, langs array<struct<lang:string,share:double>>")
