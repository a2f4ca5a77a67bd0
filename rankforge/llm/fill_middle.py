"""Fill-in-the-middle transformation by a parallel automaton scan.

A text's units and its sentinels are read by one small automaton. A stretch of
text is summed up by what it does to each state that it may be entered in: the
state it is left in, and what is counted on the way. Such functions compose
associatively, so stretches are scanned side by side, before anyone knows their
entry states: lanes of 64 characters within a task, chunks of 16,384 characters
of a giant document over the cluster. Composition then gives the entry states
and the counts before each stretch, and the unit where a cut falls is looked for
in its stretch alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk; a longer text is a giant, whose chunks are dealt over the cluster.
CHUNK = 1 << 14
_LANE = 64
#: Characters that a task scans at once.
_TURN = 1 << 20

SENTINELS = ("<P>", "<S>", "<M>")

# the automaton: classes of characters, its states, the state after each class, and what is counted
_OTHER, _LETTER, _MARK, _OPEN, _CLOSE, _PAD = range(6)
_OUT, _WORD, _LT, _TAG = range(4)  # between words; in a word; after "<"; after "<" and P, S or M, in a word
_STEP = np.array([[_OUT, _WORD, {_LT: _TAG}.get(s, _WORD), _LT, _OUT, s] for s in range(4)])
#: Unit begins count 1, sentinels 2**32.
_COUNT = np.array([[1, s in (_OUT, _LT), s in (_OUT, _LT), 1, 1 + ((s == _TAG) << 32), 0] for s in range(4)], np.int64)
_CLASS = np.full(129, _OTHER, np.uint8)
for _c in range(128):
    _CLASS[_c] = _LETTER if chr(_c).isalpha() else _OTHER
for _c, _k in {"P": _MARK, "S": _MARK, "M": _MARK, "<": _OPEN, ">": _CLOSE}.items():
    _CLASS[ord(_c)] = _k
_UNITS = (1 << 32) - 1


class Scan:
    """Texts in lanes, each lane's function, and the functions of whole texts: ``after`` and ``count``, a column for each entry state."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        per = -(-self.lengths // _LANE)
        self.first = np.concatenate([[0], np.cumsum(per)])
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        grid = np.full((int(self.first[-1]), _LANE), _PAD, np.uint8)
        starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        grid.ravel()[np.arange(len(code)) + np.repeat(self.first[:-1] * _LANE - starts, self.lengths)] = _CLASS[np.minimum(code, 128)]
        self.columns = np.ascontiguousarray(grid.T).astype(np.int64)
        after, count = self._run(self.columns[:, :, None], np.tile(np.arange(4), (len(grid), 1)))
        # lanes of a text compose one after another, all texts side by side
        self.entry, self.before = np.zeros((len(grid), 4), np.int64), np.zeros((len(grid), 4), np.int64)
        self.after, self.count = np.tile(np.arange(4), (len(texts), 1)), np.zeros((len(texts), 4), np.int64)
        for j in range(int(per.max(initial=0))):
            live = np.flatnonzero(per > j)
            lane = self.first[live] + j
            at = self.after[live]
            self.entry[lane], self.before[lane] = at, self.count[live]
            self.count[live] += np.take_along_axis(count[lane], at, 1)
            self.after[live] = np.take_along_axis(after[lane], at, 1)

    @staticmethod
    def _run(columns: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step, count, total = _STEP.ravel(), _COUNT.ravel(), np.zeros(state.shape, np.int64)
        for column in columns:
            at = state * 6 + column
            total += count[at]
            state = step[at]
        return state, total

    def find(self, text: np.ndarray, state: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Where in each of the texts (by number, entered in ``state``, none of them empty) unit number ``unit`` begins; at its end, if it has no more units."""
        lane = np.array([self.first[t] + np.searchsorted(self.before[self.first[t] : self.first[t + 1], s] & _UNITS, u, "right") - 1 for t, s, u in zip(text, state, unit, strict=True)], np.int64)
        at, left = self.entry[lane, state], unit - (self.before[lane, state] & _UNITS)
        place = np.full(len(lane), -1)
        for j in range(_LANE):
            k = at * 6 + self.columns[j, lane]
            left = left - (_COUNT.ravel()[k] & _UNITS)
            place[(left < 0) & (place < 0)] = j
            at = _STEP.ravel()[k]
        return np.where(place < 0, self.lengths[text], (lane - self.first[text]) * _LANE + place)


def prefixes(after: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of the first 1, 2, 3, … of a row of functions, by doubling."""
    after, count, step = after.copy(), count.copy(), 1
    while step < len(after):
        at = after[:-step]
        count[step:], after[step:] = count[:-step] + np.take_along_axis(count[step:], at, 1), np.take_along_axis(after[step:], at, 1)
        step *= 2
    return after, count


def _turns(texts: list[str]):
    """Slices of the texts of about ``_TURN`` characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size + len(t) > _TURN and k > at:
            yield slice(at, k)
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def _cut_units(units: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = a % (units + 1), b % (units + 1)
    return np.minimum(a, b), np.maximum(a, b)


_CUTS, _FUNCTION = "n long, marks long, first long, second long", "after array<int>, count array<long>, chars long"


def _cut_short(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Units, sentinels and the characters before the two cuts of whole texts."""
    texts, rows = text.tolist(), []
    for turn in _turns(texts):
        scan = Scan(texts[turn])
        units, marks = scan.count[:, _OUT] & _UNITS, scan.count[:, _OUT] >> 32
        found = [units, marks]
        for unit in _cut_units(units, a.to_numpy()[turn], b.to_numpy()[turn]):
            place, some = np.zeros(len(units), np.int64), np.flatnonzero(units)
            place[some] = scan.find(some, np.zeros(len(some), np.int64), unit[some])
            found.append(place)
        rows.append(np.stack(found, 1))
    return pd.DataFrame(np.concatenate(rows) if rows else np.zeros((0, 4), np.int64), columns=["n", "marks", "first", "second"])


def _scan_piece(piece: pd.Series) -> pd.DataFrame:
    texts, out = piece.tolist(), []
    for turn in _turns(texts):
        scan = Scan(texts[turn])
        out.append(pd.DataFrame({"after": scan.after.astype(np.int32).tolist(), "count": scan.count.tolist(), "chars": scan.lengths}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"after": [], "count": [], "chars": []})


def _find_in_piece(piece: pd.Series, state: pd.Series, unit: pd.Series) -> pd.Series:
    texts, out = piece.tolist(), []
    for turn in _turns(texts):
        out.append(Scan(texts[turn]).find(np.arange(len(texts[turn])), state.to_numpy()[turn], unit.to_numpy()[turn]))
    return pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))


def _resolve(chunks: pd.DataFrame) -> pd.DataFrame:
    """From one giant's chunk functions: its units and sentinels, and the chunk, entry state and unit of each cut. At most 2**31 / ``CHUNK`` chunks."""
    chunks = chunks.sort_values("k")
    after, count = prefixes(np.stack(chunks["after"]).astype(np.int64), np.stack(chunks["count"]).astype(np.int64))
    state, total = after[:, _OUT], count[:, _OUT]
    units, marks, ends = int(total[-1] & _UNITS), int(total[-1] >> 32), np.cumsum(chunks["chars"].to_numpy())
    rows = []
    for which, unit in enumerate(_cut_units(np.array([units]), *(chunks[c].to_numpy()[:1] for c in "ab"))):
        unit = int(unit[0])
        j = min(int(np.searchsorted(total & _UNITS, unit, "right")), len(chunks) - 1)  # the first chunk by whose end more units have begun
        rows.append((chunks["key"].iloc[0], units, marks, which, int(chunks["k"].iloc[j]), int(state[j - 1]) if j else 0, unit - int(total[j - 1] & _UNITS) if j else unit, int(ends[j - 1]) if j else 0))
    return pd.DataFrame(rows, columns=["key", "n", "marks", "which", "k", "state", "unit", "before"])


def _cut_giants(giants: DataFrame, chunk: int) -> DataFrame:
    """``key`` and the cuts of each giant: its chunks are scanned and searched wherever they are dealt to; equal giants are told apart by nothing and counted once."""
    pieces = giants.select("key", "a", "b", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{chunk}}}"), F.lit(0))).alias("k", "piece"))
    tasks = int(giants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(tasks)  # round robin: no key is hot
    functions = dealt.select("key", "a", "b", "k", F.pandas_udf(_scan_piece, _FUNCTION)("piece").alias("f")).groupBy("key", "k").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("f").alias("f"))
    by_giant = functions.select("key", "k", "a", "b", "f.*").repartition(tasks, "key")  # few bytes, much work: not to be merged into one task
    cuts = by_giant.groupBy("key").applyInPandas(_resolve, "key string, n long, marks long, which int, k int, state int, unit long, before long")
    both = cuts.join(pieces.select("key", "k", "piece"), ["key", "k"])
    places = both.select("key", "n", "marks", "which", (F.col("before") + F.pandas_udf(_find_in_piece, "long")("piece", "state", "unit")).alias("place"))
    return places.groupBy("key").agg(F.struct(F.max("n").alias("n"), F.max("marks").alias("marks"), F.max(F.when(F.col("which") == 0, F.col("place"))).alias("first"), F.max(F.when(F.col("which") == 1, F.col("place"))).alias("second")).alias("cuts"))


def _hash(id_col: Column, seed: int, k: int) -> Column:
    """The ``k``-th group of eight digits of the hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row of ``docs``.

    Units are words of ASCII letters and single other characters. Two cuts
    between units, drawn by hash of seed and id, part prefix, middle and suffix.
    The form is ``plain`` (the text as it is) for a share of the rows, for an empty
    text and for one that holds a sentinel; else ``spm`` or ``psm``.

    A null text is empty; a null id is hashed as an empty one. Rows that share an
    id draw alike; repeated rows are each returned. Columns beside id and text
    are not looked at. An empty table gives no row. A text is one cell, so its
    output is assembled where it lies; scans and searches of texts beyond
    ``chunk`` characters are dealt over the cluster.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", *[_hash(F.col("doc_id"), seed, k).alias(c) for k, c in enumerate("abcd")])
    giant = F.length("text") > chunk
    short = rows.where(~giant).withColumn("cuts", F.pandas_udf(_cut_short, _CUTS)("text", "a", "b"))
    giants = rows.where(giant).withColumn("key", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "text"), 256))
    long_ = giants.join(_cut_giants(giants, chunk), "key").select(*short.columns)
    both = short.unionAll(long_).select("doc_id", "text", "c", "d", "cuts.*")
    form = F.when((F.col("text") == "") | (F.col("marks") > 0) | (F.col("c") % 100 >= 100 - plain_percent), "plain").when(F.col("d") % 100 < spm_percent, "spm").otherwise("psm")
    cut = lambda lo, n: F.substring("text", lo, n)
    prefix, middle, suffix = cut(F.lit(1), F.col("first")), cut(F.col("first") + 1, F.col("second") - F.col("first")), cut(F.col("second") + 1, F.length("text"))
    p, s, m = map(F.lit, SENTINELS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    made = F.col("form") != "plain"
    return both.withColumn("form", form).select("doc_id", "n", "form", F.when(made, F.col("first")).alias("prefix_chars"), F.when(made, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))
