"""Re-ranking of pools: one shuffle by query, then a procedure in each group.

Sort procedures depend on the answers they get, so they run in grouped Arrow
functions; pools are a few hundred rows at most. Rankings, telemetry and
comparison logs leave the group as one tagged row set, so that a comparator
answers each request once. Pointwise and all-pairs re-ranking need no loop and
are plain relational plans.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import procedures
from .comparators import Comparator, Doc, ScoreComparator

OUTPUT = (
    "kind string, qid string, docid string, rank int, score double, type string, positions array<string>, selected string, docids array<string>, "
    "llm_calls long, non_llm_bypasses long, retries long, prompt_tokens long, completion_tokens long, retry_prompt_tokens long, retry_completion_tokens long, wall_seconds double, retry_seconds double, status string, error string"
)
_ARROW = pa.schema(
    [("kind", pa.string()), ("qid", pa.string()), ("docid", pa.string()), ("rank", pa.int32()), ("score", pa.float64()), ("type", pa.string()), ("positions", pa.list_(pa.string())), ("selected", pa.string()), ("docids", pa.list_(pa.string()))]
    + [(c, pa.int64()) for c in ("llm_calls", "non_llm_bypasses", "retries", "prompt_tokens", "completion_tokens", "retry_prompt_tokens", "retry_completion_tokens")]
    + [("wall_seconds", pa.float64()), ("retry_seconds", pa.float64()), ("status", pa.string()), ("error", pa.string())]
)


def validate(method: str, k: int, hits: int, c: int = 2, output_depth: int | None = None, shuffle: bool = False, reverse: bool = False, permutations: int = 1) -> None:
    """Rules that settings must meet together; the first one broken is an error."""
    whole = method.startswith("whole_")
    rules = [
        (method in procedures.METHODS, f"unknown method {method}"),
        (k >= 1 and hits >= 1 and c >= 1, "k, hits and c must be positive"),
        (output_depth is None or 1 <= output_depth <= min(hits, k), "output_depth must be between 1 and both hits and k"),
        (not (shuffle and reverse), "shuffle and reverse exclude each other"),
        (whole or not (shuffle or reverse), "shuffle and reverse are for whole-pool methods"),
        (not whole or hits == k, "whole-pool methods need hits equal to k"),
        (not whole or permutations == 1, "whole-pool methods take one permutation"),
        (method != "whole_bottomup" or output_depth in (None, k), "whole_bottomup gives full depth only"),
    ]
    for holds, why in rules:
        if not holds:
            raise ValueError(why)


def rerank(pool: DataFrame, method: str, k: int, comparator: Comparator | Callable[[], Comparator] | None = None, c: int = 2, how: str | None = None, **options) -> DataFrame:
    """Tagged rows (``kind`` is ranking, telemetry or comparison) for ``qid, pos, docid, score, hidden[, query, text]``.

    An error in one query gives a telemetry row with status ``error`` and no
    ranking; other queries go on. Pools of one document or none need no call.
    ``comparator`` may be an instance or a function that makes one for each query.
    """
    validate(method, k, k, c, reverse=how == "reverse", shuffle=how == "shuffle")
    make = comparator if callable(comparator) else (lambda: comparator or ScoreComparator())
    extra = [x for x in ("query", "text") if x in pool.columns]

    def group(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        qid, query = rows[0]["qid"], rows[0].get("query") or rows[0]["qid"]
        docs = [Doc(r["docid"], r["score"], r.get("text"), i, r["hidden"]) for i, r in enumerate(rows)]
        began, judge, out = time.perf_counter(), make(), []
        try:
            if len(docs) > 1:
                prefix, trace = procedures.run(procedures.build(method, qid, docs, k, c, **options), judge, query, docs, qid, how)
            else:
                prefix, trace = list(range(len(docs))), procedures.Trace()
            final = procedures.materialise(prefix, len(docs))
            out += [{"kind": "ranking", "qid": qid, "docid": docs[i].docid, "rank": r + 1, "score": -float(r + 1)} for r, i in enumerate(final)]
            out += [{"kind": "comparison", "qid": qid, **row} for row in trace.log]
            status, error = "ok", None
        except Exception as e:  # the row says so; a final assertion decides what it means
            trace, status, error = procedures.Trace(), "error", f"{type(e).__name__}: {e}"
        cost = getattr(judge, "cost", None)
        tokens = {"retries": cost.retries, "prompt_tokens": cost.nominal_prompt, "completion_tokens": cost.nominal_completion, "retry_prompt_tokens": cost.retry_prompt, "retry_completion_tokens": cost.retry_completion, "retry_seconds": cost.retry_seconds} if cost else dict.fromkeys(("retries", "prompt_tokens", "completion_tokens", "retry_prompt_tokens", "retry_completion_tokens"), 0) | {"retry_seconds": 0.0}
        out.append({"kind": "telemetry", "qid": qid, "llm_calls": trace.calls, "non_llm_bypasses": trace.bypasses, "wall_seconds": time.perf_counter() - began, "status": status, "error": error, **tokens})
        return pa.Table.from_pylist(out, schema=_ARROW)

    return pool.select("qid", "pos", "docid", "score", "hidden", *extra).groupBy("qid").applyInArrow(group, OUTPUT)


def rerank_batched(pool: DataFrame, method: str, k: int, answer_many: Callable[[list], list], c: int = 2, batch_queries: int = 64, **options) -> DataFrame:
    """As ``rerank``, with the requests of about ``batch_queries`` queries answered in one batch a round.

    ``answer_many`` is given ``(kind, query, docs)`` for each open query and gives as many answers: places in
    the window, or an exception that ends its query. A batch is one Arrow group, so that a backend
    that serves batches is kept busy; queries are dealt to batches by hash.
    """
    validate(method, k, k, c)
    batches = max(1, -(-pool.select("qid").distinct().count() // batch_queries))

    def group(table: pa.Table) -> pa.Table:
        pools: dict[str, list[Doc]] = {}
        for i, r in enumerate(sorted(table.to_pylist(), key=lambda r: (r["qid"], r["pos"]))):
            pools.setdefault(r["qid"], []).append(Doc(r["docid"], r["score"], None, i, r["hidden"]))
        began = time.perf_counter()
        steps = {q: procedures.build(method, q, docs, k, c, **options) for q, docs in pools.items() if len(docs) > 1}
        ask = lambda asked: answer_many([(r[0], q, [pools[q][i] for i in r[1]]) for q, r in asked])
        found = procedures.run_rounds(steps, ask) | {q: ([0], procedures.Trace(), None) for q, docs in pools.items() if len(docs) == 1}
        seconds, out = (time.perf_counter() - began) / max(1, len(pools)), []
        for q, (prefix, trace, error) in found.items():
            if error is None:
                out += [{"kind": "ranking", "qid": q, "docid": pools[q][i].docid, "rank": r + 1, "score": -float(r + 1)} for r, i in enumerate(procedures.materialise(prefix, len(pools[q])))]
            none = dict.fromkeys(("retries", "prompt_tokens", "completion_tokens", "retry_prompt_tokens", "retry_completion_tokens"), 0)
            out.append({"kind": "telemetry", "qid": q, "llm_calls": trace.calls, "non_llm_bypasses": trace.bypasses, "wall_seconds": seconds, "retry_seconds": 0.0, "status": "ok" if error is None else "error", "error": error, **none})
        return pa.Table.from_pylist(out, schema=_ARROW)

    dealt = pool.select("qid", "pos", "docid", "score", "hidden", F.pmod(F.xxhash64("qid"), F.lit(batches)).alias("batch"))
    return dealt.groupBy("batch").applyInArrow(group, OUTPUT)


def answer_by_score(asked: list) -> list:
    """A batched backend that reads hidden scores, as ``ScoreComparator`` does."""
    judge, out = ScoreComparator(), []
    for kind, query, docs in asked:
        out.append(judge.prefers(query, *docs) if kind == "prefers" else getattr(judge, kind)(query, docs))
    return out


def ensemble(pool: DataFrame, k: int, comparator=None, sort: str = "heapsort", how: str = "rrf", c: int = 2, alpha: float = 0.5) -> DataFrame:
    """``qid, docid, rank, score``: the pool ranked top-down and bottom-up, and the two fused."""
    down, up = (rankings(rerank(pool, f"{way}_{sort}", k, comparator, c)) for way in ("topdown", "bottomup"))
    return fuse(down, up, how, alpha)


def rankings(out: DataFrame, depth: int | None = None) -> DataFrame:
    got = out.where("kind = 'ranking'").select("qid", "docid", "rank", "score")
    return got if depth is None else got.where(F.col("rank") <= depth)


def telemetry(out: DataFrame, method: str, depth: int, hits: int) -> DataFrame:
    """Telemetry with its identities: steps = calls + bypasses, actual = nominal + retry, totals = prompt + completion."""
    t, f = out.where("kind = 'telemetry'"), F.col
    cols = [F.lit(1).alias("schema_version"), f("qid"), F.lit(method).alias("method"), F.lit("top10" if depth == 10 and depth < hits else "full").alias("output_objective"), F.lit(depth).alias("output_depth")]
    cols += [f("llm_calls"), (f("llm_calls") + f("retries")).alias("retry_inclusive_llm_calls"), (f("llm_calls") + f("non_llm_bypasses")).alias("selection_steps"), f("non_llm_bypasses")]
    parts = {"nominal": (f("prompt_tokens"), f("completion_tokens")), "retry": (f("retry_prompt_tokens"), f("retry_completion_tokens"))}
    parts["actual"] = tuple(a + b for a, b in zip(parts["nominal"], parts["retry"], strict=True))
    for name, (p, c) in parts.items():
        cols += [p.alias(f"{name}_prompt_tokens"), c.alias(f"{name}_completion_tokens"), (p + c).alias(f"{name}_total_tokens")]
    cols += [f("wall_seconds"), f("retry_seconds"), F.greatest(F.lit(0.0), f("wall_seconds") - f("retry_seconds")).alias("retry_excluded_wall_seconds"), f("status"), f("error")]
    return t.select(cols)


def comparisons(out: DataFrame) -> DataFrame:
    return out.where("kind = 'comparison'").select("qid", "type", "positions", "selected", "docids", F.lit("numeric_1_based").alias("label_scheme"))


def pointwise(pool: DataFrame, score: Column, depth: int | None = None) -> DataFrame:
    """Order by a score of each document; ties keep the first-stage order. No Python, one window."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("new_score"), "pos"))
    got = pool.withColumn("new_score", score).select("qid", "docid", rank.alias("rank"), F.col("new_score").alias("score"))
    return got if depth is None else got.where(F.col("rank") <= depth)


def allpair_points(pool: DataFrame, prefers: Callable[[str, str], Column]) -> DataFrame:
    """``qid, docid, points, rank`` from all pairs of a query's pool.

    ``prefers(a, b)`` says whether side ``a`` wins shown first and second alike.
    Pairs are made inside one query's pool, whose size the top-k cut bounds.
    """
    side = lambda s: pool.select("qid", *[F.col(x).alias(f"{s}_{x}") for x in pool.columns if x != "qid"])
    pairs = side("a").join(side("b"), "qid").where("a_pos < b_pos")
    won = F.when(prefers("a", "b"), 1.0).when(prefers("b", "a"), 0.0).otherwise(0.5)
    scored = pairs.select("qid", F.inline(F.array(F.struct(F.col("a_docid").alias("docid"), F.col("a_pos").alias("pos"), won.alias("p")), F.struct(F.col("b_docid").alias("docid"), F.col("b_pos").alias("pos"), (1 - won).alias("p")))))
    total = scored.groupBy("qid", "docid", "pos").agg(F.sum("p").alias("points"))
    return total.select("qid", "docid", "points", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("points"), "pos")).alias("rank"))


def fuse(one: DataFrame, two: DataFrame, how: str = "rrf", alpha: float = 0.5, k: int = 60) -> DataFrame:
    """``qid, docid, rank, score`` of two rankings; ties keep the first one's order."""
    a = one.select("qid", "docid", F.col("rank").alias("r1"))
    b = two.select("qid", "docid", F.col("rank").alias("r2"))
    both = a.join(b, ["qid", "docid"], "full")
    n = F.greatest(F.max("r1").over(Window.partitionBy("qid")), F.max("r2").over(Window.partitionBy("qid")))
    part = {"rrf": lambda r, w: 1 / (k + r), "combsum": lambda r, w: (n - r + 1) / n, "weighted": lambda r, w: w * (n - r + 1) / n}[how]
    score = F.coalesce(part(F.col("r1"), alpha), F.lit(0.0)) + F.coalesce(part(F.col("r2"), 1 - alpha), F.lit(0.0))
    scored = both.withColumn("score", score)
    return scored.select("qid", "docid", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("r1"), "docid")).alias("rank"), "score")


def resume(pool: DataFrame, checkpoint: DataFrame, protocol_hash: str) -> tuple[DataFrame, DataFrame]:
    """The pool rows still to do, and the checkpoint rows of this protocol that are done."""
    done = checkpoint.where(F.col("protocol_hash") == protocol_hash)
    return pool.join(done.select("qid").distinct(), "qid", "left_anti"), done


def uncertainty_thresholds(pool: DataFrame, c: int, p: float = 0.15) -> DataFrame:
    """``qid, window, threshold``: the percentile of relative score spreads over all windows of each length 2..c+1."""
    out = None
    for w in range(2, c + 2):
        frame = Window.partitionBy("qid").orderBy("pos").rowsBetween(0, w - 1)
        s = pool.select("qid", F.max("score").over(frame).alias("hi"), F.min("score").over(frame).alias("lo"), F.count("*").over(frame).alias("n")).where(F.col("n") == w)
        rel = (F.col("hi") - F.col("lo")) / F.greatest(F.abs("hi"), F.abs("lo"), F.lit(1e-6))
        part = s.groupBy("qid").agg(F.percentile(rel, F.lit(p)).alias("threshold")).select("qid", F.lit(w).alias("window"), "threshold")
        out = part if out is None else out.unionAll(part)
    return out
