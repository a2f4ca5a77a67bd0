"""N-gram Jaccard self-join by a size-aware split into light and heavy sets.

A text's set holds its distinct word shingles. Texts with equal sets form one
class, and only classes are compared. An exchange of the shingles' document
frequencies settles most texts: two sets can only link if both hold enough
shingles that other texts hold as well.

* Light pairs (smaller set of at most ``boundary`` shingles): sets enumerate
  their subsets of the exact size that a link between the two sizes needs. Sets
  with a common subset are linked, so each subset gives a star, not pairs.
* Heavy pairs: inverted lists of each set's rarest shingles are scanned. Lists
  with the same members are scanned once. All members of a long list are first
  compared with its head, the member that shares most of its shingles; those
  that link form a star and needn't meet each other, so a large group of near
  copies costs its size, not its square. The others meet all in pairs of blocks. A
  scan counts overlaps with one member at a time against those that aren't
  reached yet, and gives a spanning forest of the links.

``boundary`` minimises the rows enumerated plus the list entries scanned, from
the counts of the data at hand.
"""

from __future__ import annotations

import hashlib
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._names import Texts, Words, mix, pair
from ._rounds import Ask, distinct, give_back, rounds, totals
from ._session import cut
from .components import connected_components

SETS = "doc_id long, n_shingles long, md5 string, set_id binary, prefix int, shared array<long>"
#: Boundaries that the cost is worked out for, and the most subsets that a light set may have of one size: sets of more are heavy.
BOUNDARIES, SUBSETS = 64, 1 << 17
#: Subsets that a task holds at once.
TURN = 1 << 14
#: Rows of inverted lists that a group of the scan holds, and members of a list that meet in it.
BLOCK = 1024


def least_overlap(n: int, m: int, percent: int) -> int:
    """Least i with 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


class Shingles:
    """The distinct shingles of each text of a group, sorted within the text."""

    def __init__(self, texts: Texts, width: int):
        w = Words(texts, lower=True)
        level, size = w.names(), 1
        words = level
        while size * 2 <= width:
            level = pair(level[:-size], level[size:], size)
            size *= 2
        every = pair(level[: len(level) - (width - size)], level[width - size :], width) if len(level) > width - size else level[:0]
        sets = []
        for k in range(texts.n):
            i, j = int(w.first[k]), int(w.first[k + 1])
            if j - i >= width:
                sets.append(np.unique(every[i : j - width + 1]))
            elif j > i:
                name = words[i : i + 1]
                for t in range(i + 1, j):
                    name = pair(name, words[t : t + 1], 0)
                sets.append(mix(name + np.uint64(j - i)))
            else:
                sets.append(words[:0])
        self.size = np.array([len(s) for s in sets], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.name = np.concatenate([np.zeros(0, np.uint64), *sets])
        full = self.size > 0
        self.id = np.zeros((texts.n, 2), np.uint64)
        if full.any():
            self.id[full, 0] = mix(np.add.reduceat(mix(self.name), self.first[full]) + self.size[full].astype(np.uint64))
            self.id[full, 1] = np.add.reduceat(mix(self.name ^ np.uint64(0xA5A5A5A5)), self.first[full])

    def once(self) -> np.ndarray:
        """Names of the group's distinct sets, cut to 48 bits: a false merge only raises a frequency."""
        _, at = np.unique(self.id, axis=0, return_index=True)
        keep = np.zeros(len(self.size), bool)
        keep[at] = True
        return self.name[np.repeat(keep, self.size)] >> np.uint64(16) << np.uint64(16)


class Frequencies:
    def __init__(self, width: int, percent: int):
        self.width, self.percent = width, percent

    def ask(self, texts: Texts, state: bytes, replies):
        names, _, count = distinct(Shingles(texts, self.width).once())
        return Ask(names, (count.astype(np.uint64),)), b""

    def finish(self, texts: Texts, state: bytes, replies: np.ndarray) -> pa.Table:
        s = Shingles(texts, self.width)
        names = np.unique(s.once())
        often = replies[np.searchsorted(names, s.name >> np.uint64(16) << np.uint64(16))] if len(names) else replies[:0]
        shared, prefix = [], []
        for i, n in zip(s.first.tolist(), s.size.tolist(), strict=True):
            f = often[i : i + n]
            least, common = -(-self.percent * n // 100), int((f > 1).sum())
            if n and common >= least:
                order = np.lexsort((s.name[i : i + n], f))[n - common :]
                shared.append(s.name[i : i + n][order].view(np.int64))
                prefix.append(common - least + 1)
            else:
                shared.append(None)
                prefix.append(0)
        ids = [i.tobytes() if n else None for i, n in zip(s.id, s.size.tolist(), strict=True)]
        md5 = [hashlib.md5(texts.raw[i:j].tobytes(), usedforsecurity=False).hexdigest() for i, j in zip(texts.offs[:-1].tolist(), texts.offs[1:].tolist(), strict=True)]
        return pa.table({"doc_id": texts.doc_id, "n_shingles": pa.array(s.size), "md5": pa.array(md5, pa.string()), "set_id": pa.array(ids, pa.binary()), "prefix": pa.array(prefix, pa.int32()), "shared": pa.array(shared, pa.list_(pa.int64()))})


def _choose_boundary(sets: DataFrame, postings: DataFrame, percent: int) -> int:
    """The boundary with the least rows enumerated by light sets plus entries scanned for heavy ones."""
    size = F.least("n", F.lit(BOUNDARIES + 1)).alias("n")
    lists = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    scan = {r.n: r.c for r in postings.join(lists, "token").groupBy(size).agg(F.sum("c").alias("c")).collect()}
    many = {r.n: r.c for r in sets.where(F.col("n") <= BOUNDARIES * 100 // percent).groupBy("n").agg(F.count("*").alias("c")).collect()}

    def cost(x: int) -> int:
        rows = sum(c * comb(n, least_overlap(n, m, percent)) for n, c in many.items() for m in range(-(-percent * n // 100), n * 100 // percent + 1) if min(n, m) <= x)
        return rows + sum(c for n, c in scan.items() if n > x)

    return min(range(most_light(percent) + 1), key=lambda x: (cost(x), x))


def most_light(percent: int) -> int:
    """The largest boundary at which no set has more than ``SUBSETS`` subsets of a size that it needs."""
    for x in range(1, BOUNDARIES + 1):
        if any(comb(n, least_overlap(n, m, percent)) > SUBSETS for n in range(x, x * 100 // percent + 1) for m in range(-(-percent * n // 100), n * 100 // percent + 1) if min(n, m) == x):
            return x - 1
    return BOUNDARIES


def _light_links(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Stars between sets with a common subset of the size that their sizes need. A subset is known by 128 bits."""
    kinds = {"lo": pa.int32(), "hi": pa.int32(), "key": pa.int64(), "more": pa.int64(), "n": pa.int32(), "set_id": pa.binary()}

    def subsets(batches):
        for batch in batches:
            for sid, n, shared in zip(*(batch.column(k).to_pylist() for k in ("set_id", "n", "shared")), strict=True):
                names = np.array(shared, np.int64).view(np.uint64)
                both = mix(names), mix(names ^ np.uint64(0x5BD1E995))
                for m in range(-(-percent * n // 100), n * 100 // percent + 1):
                    need = least_overlap(n, m, percent)
                    if min(n, m) > boundary or need > len(names):
                        continue
                    every = combinations(range(len(names)), need)
                    while pick := list(islice(every, TURN)):
                        at = np.array(pick, np.int64)
                        key, more = (mix(x[at].sum(axis=1, dtype=np.uint64)).view(np.int64) for x in both)
                        k = len(pick)
                        columns = [np.full(k, min(n, m)), np.full(k, max(n, m)), key, more, np.full(k, n), [sid] * k]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    rows = sets.where((F.col("n") <= boundary * 100 // percent)).mapInArrow(subsets, "lo int, hi int, key long, more long, n int, set_id binary")
    same = ["lo", "hi", "key", "more"]
    buckets = rows.groupBy(*same).agg(F.min("set_id").alias("v"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.count("*").alias("c")).where("c > 1 and n0 = lo and n1 = hi")
    # members of unequal sizes all link to the other size, so a star of them is connected by links
    return rows.join(buckets.select(*same, "v"), same).select(F.col("set_id").alias("u"), "v")


class Scan:
    """Links among some sets, found list by list; a pair is compared once, and not at all if links join it already."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray, offs: np.ndarray, percent: int):
        self.sizes, self.first, self.count, self.percent = sizes, offs[:-1], np.diff(offs), percent
        _, self.dense = np.unique(values, return_inverse=True)
        self.mark = np.zeros(self.dense.max() + 1 if len(values) else 1, bool)
        self.root = np.arange(len(sizes))
        self.tested: dict[int, np.ndarray] = {}
        self.links: list[tuple[int, int]] = []

    def list(self, members: np.ndarray, joined: np.ndarray) -> None:
        """Compare the members of a list, of which the ``joined`` ones are linked already."""
        near = members[joined]
        if len(near):
            self.root[np.isin(self.root, self.root[near])] = self.root[near[0]]
        for k in members.tolist():
            other = members[self.root[members] != self.root[k]]
            if not len(other):
                if (self.root[members] == self.root[members[0]]).all():
                    return
                continue
            tested = self.tested.setdefault(k, np.zeros(len(self.sizes), bool))
            a, b = self.sizes[other], self.sizes[k]
            other = other[~tested[other] & (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b))]
            if not len(other):
                continue
            tested[other] = True
            own = self.dense[self.first[k] : self.first[k] + self.count[k]]
            self.mark[own] = True
            n = self.count[other]
            at = np.cumsum(n) - n
            hit = self.mark[self.dense[np.repeat(self.first[other] - at, n) + np.arange(n.sum())]]
            both = np.add.reduceat(hit.astype(np.int64), at)
            self.mark[own] = False
            for j in other[100 * both >= self.percent * (self.sizes[other] + b - both)].tolist():
                if self.root[j] != self.root[k]:
                    self.links.append((k, j))
                    self.root[self.root == self.root[j]] = self.root[k]


def _stars(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``set_id, head`` for the members of long lists that link to the head of their list."""
    pairs = rows.where((F.col("c") > BLOCK) & (F.col("set_id") != F.col("head"))).select("set_id", "head").distinct()
    # a head may have very many members: it is copied, so that none of its groups is large
    copies = pairs.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("copies"))
    heads = copies.join(sets.select(F.col("set_id").alias("head"), F.col("n").alias("m"), F.col("shared").alias("other")), "head")
    dealt = pairs.join(copies, "head").withColumn("copy", F.pmod(F.xxhash64("set_id"), "copies").cast("int")).drop("copies")
    dealt = dealt.join(sets.select("set_id", "n", "shared"), "set_id")
    heads = heads.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    both = F.size(F.array_intersect("shared", "other"))
    return dealt.join(heads, ["head", "copy"]).where(100 * both >= percent * (F.col("n") + F.col("m") - both)).select("set_id", "head")


def _cells(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """``set_id, token, head, lo, hi, part, joined``: the cells in which the members of each list meet.

    A list of at most ``BLOCK`` members is one cell. Longer lists with one head
    have nearly the same members, and are taken together; the members in the
    head's star, and the others, are cut into blocks; others meet everyone, members
    of the star meet others only.
    """
    short = rows.where(F.col("c") <= BLOCK)
    # lists with the same head go together, where each set is needed once, as far as they fit
    parts = short.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    short = short.join(parts, "head").select("set_id", "token", "head", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.pmod(F.xxhash64("token"), "parts").alias("part"), F.lit(False).alias("joined"))
    long = rows.where(F.col("c") > BLOCK).select("set_id", "head").distinct().join(stars.withColumn("joined", F.lit(True)), ["set_id", "head"], "left")
    long = long.withColumn("joined", F.coalesce("joined", F.col("set_id") == F.col("head")))
    blocks = lambda which: F.ceil(F.count_if(which) / BLOCK).cast("int")
    counts = long.groupBy("head").agg(blocks(F.col("joined")).alias("near"), blocks(~F.col("joined")).alias("far"))
    long = long.join(counts, "head").where("far > 0")
    own = F.when(F.col("joined"), F.pmod(F.xxhash64("set_id"), "near")).otherwise(F.col("near") + F.pmod(F.xxhash64("set_id"), "far")).cast("int")
    first = F.when(F.col("joined"), F.col("near")).otherwise(0)
    long = long.select("set_id", "head", "joined", own.alias("own"), F.explode(F.sequence(first, F.col("near") + F.col("far") - 1)).alias("other"))
    long = long.select("set_id", F.lit(0).cast("long").alias("token"), "head", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.lit(-1).cast("long").alias("part"), "joined")
    return short.unionAll(long)


def _heavy_links(sets: DataFrame, postings: DataFrame, boundary: int, percent: int) -> DataFrame:
    heavy = postings.where(F.col("n") > boundary)
    head = F.min(F.struct("missing", "set_id"))["set_id"]
    lists = heavy.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y"), head.alias("head"), F.min("n").alias("least"), F.max("n").alias("most"))
    # two sets whose sizes differ too much can't link
    lists = lists.where((F.col("c") > 2) | ((F.col("c") == 2) & (100 * F.col("least") >= percent * F.col("most"))))
    chosen = lists.groupBy("c", "x", "y").agg(F.min("token").alias("token"), F.min("head").alias("head"))
    rows = cut(heavy.join(chosen.select("token", "c", "head"), "token").select("set_id", "token", "c", "head"))
    stars = cut(_stars(rows, sets, percent))
    cell = cut(_cells(rows, stars))
    buckets = max(64, -(-cell.count() // BLOCK))
    cell = cell.select("set_id", "token", "head", "lo", "hi", "joined", F.pmod(F.xxhash64("head", "lo", "hi", "part"), F.lit(buckets)).alias("bucket"))
    needed = cell.select(F.col("bucket").alias("at"), F.col("set_id").alias("sid")).distinct()
    full = needed.join(sets.select(F.col("set_id").alias("sid"), "n", "shared"), "sid")

    def scan(cells: pa.Table, full: pa.Table) -> pa.Table:
        if not cells.num_rows:
            return pa.table({"u": pa.array([], pa.binary()), "v": pa.array([], pa.binary())})
        full = full.sort_by("sid")
        sid = full["sid"].to_pylist()
        place = {x: k for k, x in enumerate(sid)}
        shared = full["shared"].combine_chunks()
        shared = shared.chunk(0) if isinstance(shared, pa.ChunkedArray) else shared
        scanner = Scan(np.asarray(full["n"]).astype(np.int64), np.asarray(shared.values), np.asarray(shared.offsets), percent)
        cells = cells.sort_by([("head", "ascending"), ("token", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("set_id", "ascending")])
        token, lo, hi, joined = (cells[k].to_numpy() for k in ("token", "lo", "hi", "joined"))
        at = np.fromiter((place[x] for x in cells["set_id"].to_pylist()), np.int64, cells.num_rows)
        head = np.fromiter((hash(x) for x in cells["head"].to_pylist()), np.int64, cells.num_rows)
        edge = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        parts = zip(np.split(at, edge[1:]), np.split(joined, edge[1:]), strict=True)
        for members, near in sorted(parts, key=lambda x: len(x[0]), reverse=True):  # long lists join most sets at once
            scanner.list(members, near)
        out = pa.table({"u": pa.array([sid[a] for a, _ in scanner.links], pa.binary()), "v": pa.array([sid[b] for _, b in scanner.links], pa.binary())})
        give_back()
        return out

    found = cell.groupBy("bucket").cogroup(full.groupBy("at")).applyInArrow(scan, "u binary, v binary")
    return found.unionAll(stars.select(F.col("set_id").alias("u"), F.col("head").alias("v")))


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, md5, root``: ``root`` names the component, null where the text has no words."""
    talk = Frequencies(width, percent)
    rows = cut(rounds(docs, id_col, text_col, [talk.ask], [totals], talk.finish, SETS, bucket_bytes=16 << 20))
    sets = cut(rows.where("shared is not null").groupBy("set_id").agg(F.first("n_shingles").cast("int").alias("n"), F.first("prefix").alias("prefix"), F.first("shared").alias("shared")))
    missing = (F.col("n") - F.size("shared")).alias("missing")
    postings = sets.select("set_id", "n", missing, F.explode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("token"))
    boundary = _choose_boundary(sets, postings, percent)
    small = sets.select("set_id", "n", "shared")
    edges = _light_links(small, boundary, percent).unionAll(_heavy_links(small, postings, boundary, percent))
    roots = connected_components(edges).withColumnRenamed("node", "set_id")
    return rows.select("doc_id", "n_shingles", "md5", "set_id").join(roots, "set_id", "left").select("doc_id", "n_shingles", "md5", F.coalesce("root", "set_id").alias("root"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``: groups of texts linked by Jaccard similarity of word shingles.

    Texts are lower-cased (A-Z) and split at ASCII white space; a text of fewer
    than ``width`` words is one shingle; one without words, or null, is linked
    with nothing. Two texts link if ``100 * |A & B| >= percent * |A | B|``, and
    ``component_id`` is the smallest id reachable, the own one included. One
    row for each input row; rows with equal sets, repeated rows too, share a
    component; null ids count as largest; other columns are not read; an empty
    table gives an empty result.
    """
    rows = cut(_components(docs, id_col, text_col, width, percent))
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: that with the smallest id, then the smallest MD5 of its text.

    A null id is largest. Of repeated rows, same id and same text, one stays. Rows
    whose text is null or has no words are linked with nothing and all stay; an empty
    table gives an empty result.
    """
    rows = _components(docs, id_col, text_col, width, percent).where("root is not null")
    own = F.col(f"`{id_col}`").cast("long")
    # the id as a string that is never null, so that one exchange serves the join and the aggregation
    name = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "md5")).alias("x"))
    stay = first.select(name(F.col("x.doc_id")).alias("id"), F.col("x.md5").alias("md5"))
    text = F.col(f"`{text_col}`").cast("string")
    # only the id, the digest and the row, as a struct in which no name clashes
    named = docs.select(name(own).alias("id"), F.md5(F.coalesce(text, F.lit(""))).alias("md5"), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = named.where("worded").join(stay, ["id", "md5"], "left_semi").groupBy("id", "md5").agg(F.first("row").alias("row"))
    return found.select("row").unionAll(named.where("not worded").select("row")).select("row.*")
