"""Question rounds between groups of documents and buckets of names.

Documents are dealt once into groups of a few MB. In each round a group asks
about the 64-bit names it holds; a name goes to the bucket of its leading
bits, which sees who else asked and answers in the same order. Names travel
sorted, delta-coded and packed, one message for a group and bucket, so a name
that is very frequent costs a group one entry a round whatever its count: a
hot name can't make a bucket large.

Groups and buckets both grow with the input. Beyond ``DIRECT`` buckets a group
writes to ``FAN`` relays only, whatever the input; a relay merges what ``FAN``
groups said about its range of names, asks the range's buckets, and parts the
replies. Messages stay of some hundred names then, for one exchange more each way.

The whole dialogue is one lazy plan. The exchange that deals the documents is
the same in every round, so Spark reuses it; lost executors only cost the
stages that they held.
"""

from __future__ import annotations

import ctypes
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._names import Texts, pack, pack_near, pack_sorted, unpack, unpack_near, unpack_sorted

MESSAGE = "g long, b long, kind int, n long, names binary, more binary"
_SCHEMA = pa.schema([("g", pa.int64()), ("b", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("names", pa.binary()), ("more", pa.binary())])
_ASK, _STATE, _REPLY = 0, 1, 2
#: Most buckets that groups write to themselves.
DIRECT = 4096
#: Rows alike in id and text that may meet in one group; of more, each is dealt by its place too.
ALIKE = 1024
#: Where there are more: ranges of names, each a relay's, that a group writes to, and groups that share their relays.
FAN = 1024


def give_back() -> None:
    """Return free memory to the system, so that a reused Python worker keeps none of its largest group."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Ask:
    """Sorted distinct names, and columns of unsigned numbers beside them."""

    def __init__(self, names: np.ndarray, columns: tuple[np.ndarray, ...] = ()):
        self.names, self.columns = names, columns


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)] if rows else [pa.array([], t) for t in _SCHEMA.types], schema=_SCHEMA)


class Way:
    """Who reads the names of a group: buckets, or relays where buckets are many."""

    def __init__(self, buckets: int, relayed: bool):
        self.relayed, self.parts, self.fan = relayed, FAN if relayed else buckets, FAN

    def reader(self, g: int, part: int) -> int:
        return g // self.fan * self.fan + part if self.relayed else part


def _asks(sender: int, ask: Ask, parts: int, reader) -> list[tuple]:
    """A message for each of ``parts`` ranges of names that has any."""
    part = (ask.names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist() if len(part) else []
    rows = []
    for i, j in itertools.pairwise(edge):
        more = b"".join(len(c).to_bytes(8, "little") + c for c in (pack_near(c[i:j]) for c in ask.columns))
        rows.append((sender, reader(int(part[i])), _ASK, j - i, pack_sorted(ask.names[i:j]), more))
    return rows


def _say(g: int, ask: Ask, state: bytes, way: Way) -> pa.Table:
    rows = [(g, way.reader(g, g % way.parts), _STATE, 0, state, b"")]
    out = _rows(rows + _asks(g, ask, way.parts, lambda part: way.reader(g, part)))
    give_back()
    return out


def _columns(more: bytes) -> list[np.ndarray]:
    parts, at = [], 0
    while at < len(more):
        n = int.from_bytes(more[at : at + 8], "little")
        parts.append(unpack_near(more[at + 8 : at + 8 + n]))
        at += 8 + n
    return parts


class Heap:
    """All names that one reader was sent: those of a sender stand together, in the order of senders."""

    def __init__(self, table: pa.Table):
        kinds = np.asarray(table["kind"])
        g, n = table["g"].to_pylist(), table["n"].to_pylist()
        asks = sorted(np.flatnonzero(kinds == _ASK).tolist(), key=lambda k: g[k])
        self.senders, self.sizes = [g[k] for k in asks], [n[k] for k in asks]
        self.names = np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(table["names"][k].as_py(), n[k]) for k in asks)])
        columns = [_columns(table["more"][k].as_py()) for k in asks]
        self.columns = [np.concatenate(c) for c in zip(*columns, strict=True)]
        #: States pass through.
        self.states = [(g[k], table["b"][k].as_py(), _STATE, 0, table["names"][k].as_py(), b"") for k in np.flatnonzero(kinds == _STATE).tolist()]

    def replies(self, reader: int, values: np.ndarray) -> list[tuple]:
        """``values`` of the names, as a message to each sender."""
        parts = np.split(values, np.cumsum(self.sizes)[:-1]) if self.sizes else []
        return [(g, reader, _REPLY, n, pack(part), b"") for g, n, part in zip(self.senders, self.sizes, parts, strict=True)]


def _answer(judge):
    """``judge(names, columns)`` gives a number for each name; the names of one sender stand together, in the order of senders."""

    def answer(table: pa.Table) -> pa.Table:
        heap = Heap(table)
        rows = heap.states
        if heap.senders:
            rows = rows + heap.replies(table["b"][0].as_py(), judge(heap.names, heap.columns))
        out = _rows(rows)
        give_back()
        return out

    return answer


def _relay_asks(buckets: int):
    """A relay's names, of all its groups, as a message to each of its buckets."""

    def up(table: pa.Table) -> pa.Table:
        heap = Heap(table)
        order = np.argsort(heap.names, kind="stable")
        out = _rows(_asks(table["b"][0].as_py(), Ask(heap.names[order], tuple(c[order] for c in heap.columns)), buckets, lambda b: b))
        give_back()
        return out

    return up


def _relay_replies(table: pa.Table, replies: pa.Table) -> pa.Table:
    """What buckets answered to a relay, as a message to each of its groups."""
    heap, (_, heard) = Heap(table), _heard(replies)
    values = np.empty(len(heap.names), np.uint64)
    values[np.argsort(heap.names, kind="stable")] = heard
    out = _rows(heap.states + heap.replies(table["b"][0].as_py(), values))
    give_back()
    return out


def _heard(table: pa.Table) -> tuple[bytes, np.ndarray]:
    """The group's own state, and the replies in the order of its names."""
    state, parts = b"", []
    for kind, b, body in zip(table["kind"].to_pylist(), table["b"].to_pylist(), table["names"], strict=True):
        if kind == _STATE:
            state = body.as_py()
        else:
            parts.append((b, body.as_py()))
    return state, np.concatenate([np.zeros(0, np.uint64), *(unpack(p) for _, p in sorted(parts))])


def runs(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal names together, and where each run of them starts."""
    order = np.argsort(names, kind="stable")
    s = names[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def spread(order: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A value of each run, back in the order of the names."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(starts, len(order))))
    return out


def holders(names: np.ndarray, columns) -> np.ndarray:
    """0: nobody else has the name; 1: others do, and this is the first; 2: others do."""
    order, starts = runs(names)
    many = np.diff(np.append(starts, len(order))) > 1
    out = spread(order, starts, np.where(many, 2, 0).astype(np.uint64))
    out[order[starts[many]]] = 1
    return out


def totals(names: np.ndarray, columns) -> np.ndarray:
    """The sum of the first column over all who have the name."""
    order, starts = runs(names)
    return spread(order, starts, np.add.reduceat(columns[0][order], starts))


def earlier(names: np.ndarray, columns) -> np.ndarray:
    """1 if some holder of the name (and of the same second column) has a smaller first column than this one."""
    own, second = columns
    order = np.lexsort((second, names))
    s, e = names[order], second[order]
    starts = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])]))
    least = np.minimum.reduceat(own[order], starts)
    return (own > spread(order, starts, least)).astype(np.uint64)


def _next(step, way: Way):
    def then(table: pa.Table, replies: pa.Table) -> pa.Table:
        ask, state = step(Texts(table), *_heard(replies))
        return _say(table["g"][0].as_py(), ask, state, way)

    return then


def rounds(docs: DataFrame, id_col: str, text_col: str, asks: list, judges: list, finish, schema: str, group_bytes: int = 4 << 20, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Run ``asks[k](texts, state, replies) -> (Ask, state)`` and ``finish(texts, state, replies) -> pa.Table``.

    ``judges[k]`` answers the k-th ask. ``group_bytes`` and ``bucket_bytes`` are
    the text that a group, and the names of the text that a bucket stands for;
    the numbers of both grow with the input.
    """
    text, own = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    # one pass over the texts, and a narrow exchange: how much there is, and whether rows are alike in masses
    kinds = docs.groupBy(own.alias("id"), F.md5(F.coalesce(text, F.lit(""))).alias("md5")).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes"))
    total, most = kinds.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    groups = max(96, math.ceil(total / group_bytes))
    buckets = max(48, math.ceil(total / bucket_bytes))
    way = Way(buckets, buckets > DIRECT)
    # dealt by id and text, so that rows without an id, or with the same one, do not meet in one group
    base = docs.select(own.alias("doc_id"), text.alias("text"))
    deal = [F.col("doc_id"), F.col("text")]
    if most > ALIKE:
        masses = kinds.where(F.col("n") > ALIKE).select("id", "md5", F.lit(True).alias("mass"))
        base = base.withColumn("place", F.monotonically_increasing_id())
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("md5"))
        base = base.join(masses, same, "left")
        deal.append(F.when(F.col("mass"), F.floor(F.col("place") / ALIKE)))
    base = base.select(F.pmod(F.xxhash64(*deal), F.lit(groups)).alias("g"), "doc_id", "text")

    def first(table: pa.Table) -> pa.Table:
        ask, state = asks[0](Texts(table), b"", None)
        return _say(table["g"][0].as_py(), ask, state, way)

    said = base.groupBy("g").applyInArrow(first, MESSAGE)
    for k, judge in enumerate(judges):
        asked = said.groupBy("b").applyInArrow(_relay_asks(buckets), MESSAGE) if way.relayed else said
        heard = asked.groupBy("b").applyInArrow(_answer(judge), MESSAGE)
        if way.relayed:
            heard = said.groupBy("b").cogroup(heard.groupBy("g")).applyInArrow(_relay_replies, MESSAGE)
        if k + 1 < len(asks):
            said = base.groupBy("g").cogroup(heard.groupBy("g")).applyInArrow(_next(asks[k + 1], way), MESSAGE)

    def last(table: pa.Table, replies: pa.Table) -> pa.Table:
        out = finish(Texts(table), *_heard(replies))
        give_back()
        return out

    return base.groupBy("g").cogroup(heard.groupBy("g")).applyInArrow(last, schema)


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names, the place of each name among them, and their counts."""
    return np.unique(names, return_inverse=True, return_counts=True)
