"""Sinks: run files, JSON lines, CSV and Markdown reports, summaries. Spark's committer makes each directory whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_lines(ranking: DataFrame, tag: str, depth: int | None = None, by_rank: bool = False) -> DataFrame:
    """``qid, rank, value``: six tab-separated columns. ``by_rank`` writes minus the rank as score and rejects duplicates."""
    rows = ranking if depth is None else ranking.where(F.col("rank") <= depth)
    score = (-F.col("rank")).cast("string") if by_rank else F.col("score").cast("string")
    docid = F.col("docid")
    if by_rank:
        n = rows.groupBy("qid", "docid").agg(F.count("*").alias("__n"))
        rows = rows.join(n, ["qid", "docid"])
        docid = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate docid in "), "qid")).cast("string")).otherwise(docid)
    return rows.select("qid", "rank", F.concat_ws("\t", "qid", F.lit("Q0"), docid, F.col("rank").cast("string"), score, F.lit(tag)).alias("value"))


def write_run(ranking: DataFrame, path: str, tag: str = "rankforge", depth: int | None = None, by_rank: bool = False, single_file: bool = False) -> None:
    """Lines ordered by query and rank; range partitions keep that order over the part files."""
    lines = run_lines(ranking, tag, depth, by_rank)
    lines = lines.repartition(1) if single_file else lines.repartitionByRange("qid")
    lines.sortWithinPartitions("qid", "rank").select("value").write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """``value`` of each row as a line, in the order of the columns ``order`` over all part files."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select("value").write.text(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def write_report_csv(rows: DataFrame, path: str) -> None:
    """Numbers with six decimals, null and NaN empty; for small report tables."""
    cell = lambda c, t: F.when(F.col(c).isNull() | F.isnan(F.col(c)), "").otherwise(F.format_string("%.6f", F.col(c))) if t in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows.select([cell(c, t).alias(c) for c, t in rows.dtypes]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a report; a report of more rows than ``limit`` is an error."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    say = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(say, r)) + " |" for r in got)]) + "\n"


def latex(rows: DataFrame, limit: int = 1000) -> str:
    body = markdown(rows, limit).splitlines()
    cells = [" & ".join(x.strip() for x in line.strip("|").split("|")) + r" \\" for line in (body[0], *body[2:])]
    return "\n".join([r"\begin{tabular}{" + "l" * len(rows.columns) + "}", cells[0], r"\hline", *cells[1:], r"\end{tabular}"]) + "\n"


def summary(telemetry: DataFrame) -> DataFrame:
    """One row of totals over successful queries."""
    ok = telemetry.where("status = 'ok'")
    sums = ["llm_calls", "retry_inclusive_llm_calls", "actual_prompt_tokens", "actual_completion_tokens", "actual_total_tokens", "wall_seconds"]
    return ok.agg(F.count("*").alias("queries"), *[F.sum(c).alias(c) for c in sums])
