"""Attempts as folders of files: pointers, markers, manifests and telemetry, found by name and joined by path."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of an attempt's files.
LATEST, DONE, MANIFEST, TELEMETRY = "LATEST", "DONE", "protocol_manifest.json", "*_telemetry.jsonl"


def _below(spark: SparkSession, root: str, pattern: str):
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def small_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``folder, value``: the whole text of each file of that name below ``root``, for files of a few KB."""
    return _below(spark, root, pattern).text(root, wholetext=True).select(_folder(F.col("_metadata.file_path")).alias("folder"), "value")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """``attempt, manifest``: a VARIANT for each attempt folder; one that is no JSON is an error."""
    return small_files(spark, root, MANIFEST).select(F.col("folder").alias("attempt"), F.parse_json("value").alias("manifest"))


def hashed_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, sha256`` of the files below ``root``."""
    files = _below(spark, root, pattern).format("binaryFile").load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("sha256"))


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole, by one rename; an older one is replaced."""
    jvm = spark.sparkContext._jvm
    target, draft = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.draft"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"can't write {path}")


def publish(spark: SparkSession, condition: str, attempt: str, manifest: str) -> None:
    """Makes the attempt named ``attempt`` below ``condition`` the latest: manifest, then ``DONE``, then the pointer."""
    write_small(spark, f"{condition}/{attempt}/{MANIFEST}", manifest)
    write_small(spark, f"{condition}/{attempt}/{DONE}", "ok\n")
    write_small(spark, f"{condition}/{LATEST}", f"{attempt}\n")


def _first_key(column: str, kind: str, *names: str, otherwise: Column | None = None) -> Column:
    """The value of the first of the keys that is there, null if it is null there; ``otherwise`` where none is."""
    out = None
    for name in names:
        there = F.variant_get(column, f"$.{name}", "variant").isNotNull()
        value = F.try_variant_get(column, f"$.{name}", kind)
        out = F.when(there, value) if out is None else out.when(there, value)
    return out if otherwise is None else out.otherwise(otherwise)


def collect_attempts(spark: SparkSession, root: str, include_smoke: bool = False) -> tuple[DataFrame, DataFrame]:
    """Telemetry rows of the attempts that ``LATEST`` pointers below ``root`` name, and ``attempt, reason`` of those that can't be taken.

    An attempt is taken if its pointer is one name, and its folder has a
    manifest, a ``DONE`` file and telemetry. Pointers below a folder ``smoke-q…``
    are passed over unless asked for. Telemetry of three schemas is read as
    VARIANT: a field is that of the first key that a row has, then the manifest's. A
    line that is no JSON is an error; blank ones are passed over.
    """
    pointers = small_files(spark, root, LATEST).select("folder", F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("name"))
    if not include_smoke:
        pointers = pointers.where(~F.exists(F.split("folder", "/"), lambda part: part.startswith("smoke-q")))
    valid = (F.col("name") != "") & (F.col("name") != ".") & ~F.col("name").contains("/")
    pointers = pointers.select("folder", valid.alias("valid"), F.when(valid, F.concat_ws("/", "folder", "name")).alias("attempt"))
    done = small_files(spark, root, DONE).select(F.col("folder").alias("attempt"), F.lit(True).alias("done"))
    lines = _below(spark, root, TELEMETRY).text(root).select(_folder(F.col("_metadata.file_path")).alias("attempt"), "value")
    told = lines.select("attempt").distinct().withColumn("told", F.lit(True))
    judged = pointers.join(read_manifests(spark, root), "attempt", "left").join(done, "attempt", "left").join(told, "attempt", "left")
    reason = F.when(~F.col("valid"), "invalid_LATEST_pointer").when(F.col("manifest").isNull(), "missing_manifest").when(F.col("done").isNull(), "incomplete_no_DONE").when(F.col("told").isNull(), "missing_telemetry")
    judged = judged.withColumn("reason", reason)
    left_out = judged.where("reason is not null").select(F.coalesce("attempt", "folder").alias("attempt"), "reason")
    rows = lines.where(F.trim("value") != "").select("attempt", F.parse_json("value").alias("row")).join(judged.where("reason is null").select("attempt", "manifest"), "attempt")

    def field(kind, *names, manifest=None, otherwise=None):
        if manifest:
            otherwise = F.try_variant_get("manifest", f"$.{manifest}", kind)
        return _first_key("row", kind, *names, otherwise=otherwise)

    calls, zero = field("bigint", "llm_calls", "total_calls"), F.lit(0)
    wall = field("double", "wall_seconds", "query_wall_seconds")
    out = rows.select(
        "attempt",
        F.lit(True).alias("done"),
        _first_key("manifest", "string", "baseline_category", otherwise=F.lit("native")).alias("baseline_category"),
        field("string", "dataset", manifest="dataset").alias("dataset"),
        field("string", "method", manifest="baseline").alias("method"),
        field("string", "model", manifest="model").alias("model"),
        field("string", "qid").alias("qid"),
        field("string", "output_objective", manifest="output_objective").alias("output_objective"),
        field("bigint", "output_depth", manifest="output_depth").alias("output_depth"),
        calls.alias("llm_calls"),
        field("bigint", "retry_inclusive_llm_calls", otherwise=F.coalesce(calls, zero) + F.coalesce(field("bigint", "retry_calls"), zero)).alias("retry_inclusive_llm_calls"),
        field("bigint", "actual_prompt_tokens", "prompt_tokens").alias("actual_prompt_tokens"),
        field("bigint", "actual_completion_tokens", "completion_tokens").alias("actual_completion_tokens"),
        wall.alias("wall_seconds"),
        field("double", "retry_seconds", otherwise=F.lit(0.0)).alias("retry_seconds"),
        field("double", "retry_excluded_wall_seconds", otherwise=wall).alias("retry_excluded_wall_seconds"),
        field("double", "batch_wall_seconds").alias("batch_wall_seconds"),
        field("string", "status").alias("status"),
    )
    return out, left_out
