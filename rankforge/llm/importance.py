"""Importance resampling towards a target distribution, in two Arrow passes over hashed n-grams.

The first pass counts each partition's features with ``np.bincount`` into one
vector of 10,000 buckets, and ``treeReduce`` merges the vectors. The second pass
gathers the broadcast gain of each feature's bucket and sums them up by document,
with ``bincount`` weights. A draw without replacement by weight is then the largest
sums of weight and Gumbel noise; their ranks come from a range sort.

A feature's bucket is its CRC-32. Only words are hashed as bytes: the sum of a
run follows from its words' sums, because appending n bytes is a linear map of the
32 bits before them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import cut

BUCKETS = 10_000
#: Words held at once, and bytes of a text that are split at once.
_WORDS, _BYTES = 1 << 18, 1 << 22

_NOT_WORD = bytes(i if i >= 0x80 or chr(i).isascii() and chr(i).isalnum() else 0x20 for i in range(256))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What 0 to 64 more bytes, and 2 ** k more bytes, make of each byte of a sum."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    near = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(64):
        near.append((near[-1] >> 8) ^ one[near[-1] & 255])
    far = [near[1]]
    for _ in range(31):
        far.append(_through(far[-1], far[-1]))
    return np.stack(near).reshape(65, 1024), np.stack(far)


def _through(table: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return table[0][sums & 255] ^ table[1][(sums >> 8) & 255] ^ table[2][(sums >> 16) & 255] ^ table[3][sums >> 24]


_NEAR, _FAR = _tables()


def appended(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sums of byte strings as they stand in a sum with ``size`` bytes after them."""
    base, flat = np.minimum(size, 64) * 1024, _NEAR.ravel()
    out = flat[base + (sums & 255)] ^ flat[base + 256 + ((sums >> 8) & 255)] ^ flat[base + 512 + ((sums >> 16) & 255)] ^ flat[base + 768 + (sums >> 24)]
    for i in np.flatnonzero(size > 64):
        got = sums[i : i + 1]
        for k in range(32):
            if int(size[i]) >> k & 1:
                got = _through(_FAR[k], got)
        out[i] = got[0]
    return out


def _words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_NOT_WORD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def features(texts: Iterator[str | None], order: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``owner, sums, words``: features' texts by number and their CRC-32, and the texts of the words read, in blocks.

    A block may end within a text: its last words stay for the runs that go on.
    """
    gap = np.uint32(zlib.crc32(b" "))
    sums, sizes, owner, held = [], [], [], 0  # the first ``held`` words were counted before

    def block():
        nonlocal held, sums, sizes, owner
        s, n, o = np.array(sums, np.uint32), np.array(sizes, np.int64), np.array(owner, np.int64)
        spaced = appended(np.full(len(s), gap), n) ^ s
        run, found, whose = s, [s[held:]], [o[held:]]
        for k in range(1, order):
            run = np.concatenate([run[:1], appended(run[:-1], n[1:] + 1) ^ spaced[1:]])  # run[i] ends in word i and has k + 1 words
            there = np.arange(len(o)) >= max(held, k)
            there[k:] &= o[k:] == o[:-k]
            found.append(run[there])
            whose.append(o[there])
        words = o[held:]
        held = min(order - 1, len(sums))
        sums, sizes, owner = (x[len(x) - held :] for x in (sums, sizes, owner))
        return np.concatenate(whose), np.concatenate(found), words

    for number, text in enumerate(texts):
        for words in _words(text):
            sums += map(zlib.crc32, words)
            sizes += map(len, words)
            owner += [number] * len(words)
            if len(sums) >= _WORDS:
                yield block()
    if len(sums) > held:
        yield block()


def bucket_counts(texts: DataFrame, text_col: str = "text", order: int = 3, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. Driver and tasks hold a few vectors of ``buckets`` numbers, at any input size."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, sums, _ in features((x.as_py() for x in batch.column(0)), order):
                total += np.bincount(sums % buckets, minlength=buckets)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda r: np.frombuffer(bytes(r[0]), np.int64)).treeReduce(lambda a, b: a + b, 3)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: a thousand times the logarithm of its smoothed target share over its smoothed source share, rounded down."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def sum_up(batches):
        gain = shared.value
        for batch in batches:
            n = batch.num_rows
            words, count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for owner, sums, read in features((x.as_py() for x in batch.column(1)), order):
                words += np.bincount(read, minlength=n)
                count += np.bincount(owner, minlength=n)
                weight += np.bincount(owner, weights=gain[sums % len(gain)], minlength=n)  # whole numbers: exact
            yield pa.record_batch([batch.column(0), pa.array(words), pa.array(count), pa.array(weight.astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(sum_up, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def draw_ranks(scored: DataFrame, drawable: str, percent: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3, … for the ``percent`` of the drawable rows with the highest ``score``, ties to the smaller ``doc_id``, else null.

    A range sort of the narrow rows; a rank is the number of rows in the
    partitions before, and the place in its own. Rows alike in score and id
    are ordered by their place in the written table, so none is hot.
    """
    spark = scored.sparkSession
    rows = cut(scored).withColumn("__can", F.coalesce(F.expr(drawable), F.lit(False))).withColumn("__tag", F.monotonically_increasing_id())
    most = rows.agg(F.count_if("__can")).first()[0] * percent // 100
    order = [F.desc("__can"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__tag")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    sizes = sorted((r.part, r.n) for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(starts, "__part int, __before long"))
    rank = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    out = dealt.withColumn("__part", part).join(starts, "__part")
    return out.select(*scored.columns, F.when(rank <= most, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = 5, least_words: int = 20, order: int = 3, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for each row of ``docs``.

    Words are runs of ASCII letters (A-Z lower-cased), digits and all characters
    beyond ASCII; features are runs of 1 to ``order`` words, repeats counted. The
    weight sums the gains of a document's features, the score adds Gumbel noise
    drawn by hash of seed and id, and ``rank`` numbers the rows drawn: ``percent``
    of those with ``least_words`` words or more.

    A null text has no words, and a null id is hashed as an empty one and comes
    last among ties. Rows that share an id share their noise; repeated rows are
    each counted, scored and returned. Columns beside id and text are not looked
    at. With an empty table all gains are those of no features, or no row is
    returned. Texts are read in blocks, so a very long one takes its own size and
    one block's arrays.
    """
    gain = gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, target_text_col, order, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weigh(docs, gain, id_col, text_col, order).withColumn("score", F.col("weight") + noise)
    return draw_ranks(scored, f"n_words >= {least_words}", percent)
