"""Integrity of an attempt's artefacts: contents against manifests, prompt templates, and the accounting of repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Manifest fields that name a file of the attempt, and those with its hash.
ARTEFACTS = {
    "run": ("run_file", "output_run_sha256"),
    "telemetry": ("telemetry_file", "telemetry_sha256"),
    "summary": ("summary_file", "summary_sha256"),
    "first_stage": ("first_stage_run", "first_stage_sha256"),
}


def artefact_mismatches(manifests: DataFrame, files: DataFrame, artefacts: dict[str, tuple[str, str]] = ARTEFACTS) -> DataFrame:
    """``attempt, artefact, reason`` from ``attempt, manifest`` (a VARIANT) and hashes ``path, sha256`` of files.

    A name without a slash is a file of the attempt's folder, others are paths.
    Reasons: ``no_hash`` (none, or not 64 hexadecimal digits), ``missing_file``,
    ``changed_file``. An artefact that the manifest doesn't name is passed over;
    one of two manifests for an attempt can fail alone.
    """
    text = lambda name: F.try_variant_get("manifest", f"$.{name}", "string")
    cells = [F.struct(F.lit(kind).alias("artefact"), text(name).alias("file"), text(digest).alias("said")) for kind, (name, digest) in artefacts.items()]
    named = manifests.select("attempt", F.explode(F.array(*cells)).alias("x")).select("attempt", "x.*").where("file is not null")
    named = named.withColumn("path", F.when(F.col("file").contains("/"), F.col("file")).otherwise(F.concat_ws("/", "attempt", "file")))
    got = named.join(files.groupBy("path").agg(F.first("sha256").alias("sha256")), "path", "left")
    why = F.when(~F.coalesce(F.col("said").rlike("^[0-9a-f]{64}$"), F.lit(False)), "no_hash").when(F.col("sha256").isNull(), "missing_file").when(F.col("sha256") != F.col("said"), "changed_file")
    return got.select("attempt", "artefact", why.alias("reason")).where("reason is not null")


def template_mismatches(manifests: DataFrame) -> DataFrame:
    """``attempt, reason``: whole-pool attempts without a rendered prompt template (``missing_template``), and templates whose hash isn't theirs (``stale_template_hash``)."""
    text = lambda path: F.try_variant_get("manifest", path, "string")
    rendered, said = text("$.prompt_template_contract.rendered_chat_prompt"), text("$.prompt_template_contract.rendered_chat_prompt_sha256")
    whole = F.coalesce(F.startswith(text("$.prompt_contract.direction"), F.lit("maxcontext_")), F.lit(False))
    lacks = F.coalesce(rendered, F.lit("")) == ""
    why = F.when(whole & lacks, "missing_template").when(whole & ~said.eqNullSafe(F.sha2(rendered, 256)), "stale_template_hash")
    return manifests.select("attempt", why.alias("reason")).where("reason is not null")


#: Generations of an event, as its log has them.
GENERATION = (
    "struct<attempt_index:int,attempt_kind:string,raw_output:string,content_output:string,parser_input:string,special_tokens_removed:boolean,format_valid:boolean,status:string,"
    "parser_input_policy:string,no_document_policy:string,generation_budget:int,rendered_prompt_sha256:string,prompt_tokens:bigint,completion_tokens:bigint,duration_seconds:double>"
)
EVENT = (
    f"qid string, event int, format_repair_policy string, generation_attempts array<{GENERATION}>, generation_attempt_count int, retry_calls bigint, retry_seconds double, format_repair_triggered boolean, "
    "format_repair_succeeded boolean, initial_format_valid boolean, prompt_tokens bigint, completion_tokens bigint, duration_seconds double, rendered_prompt_sha256 string, raw_output string, content_output string, "
    "parser_input string, special_tokens_removed boolean, format_valid boolean, parser_input_policy string, no_document_policy string"
)
_FINAL = ("rendered_prompt_sha256", "raw_output", "content_output", "parser_input", "special_tokens_removed", "format_valid", "parser_input_policy", "no_document_policy")


def _text(value) -> str:
    return "null" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def repair_rules(policy: str | None, parser_policy: str | None, no_document_policy: str | None, budget: int | None) -> dict[str, str]:
    """What must be true of an event, by name: with no ``policy`` that it declares no repair, else that its generations and its totals tell the same."""
    if policy is None:
        return {"legacy_policy": "format_repair_policy is null", "legacy_generations": "generation_attempts is null", "legacy_retries": "coalesce(retry_calls, 0) = 0"}
    every = {
        "attempt_index": "x.attempt_index = i",
        "attempt_kind": "x.attempt_kind = if(i = 0, 'initial', 'format_repair')",
        "views": "x.raw_output is not null and x.content_output is not null and x.parser_input is not null",
        "parser_input": "x.parser_input = x.content_output",
        "control_tokens": "x.special_tokens_removed = (x.raw_output <> x.content_output)",
        "format_flag": "x.format_valid = contains(x.parser_input, 'Document')",
        "attempt_status": "x.status = if(x.format_valid, 'ok', 'format_invalid')",
        "parser_policy": f"x.parser_input_policy <=> {_text(parser_policy)}",
        "no_document_policy": f"x.no_document_policy <=> {_text(no_document_policy)}",
        "generation_budget": f"x.generation_budget <=> {_text(budget)}",
        "prompt_hash": "x.rendered_prompt_sha256 rlike '^[0-9a-f]{64}$'",
        "attempt_tokens": "x.prompt_tokens >= 0 and x.completion_tokens >= 0",
        "attempt_seconds": "x.duration_seconds >= 0",
    }
    rules = {"policy": f"format_repair_policy = {_text(policy)}", "attempts": "size(generation_attempts) in (1, 2)", "attempt_count": "generation_attempt_count = size(generation_attempts)"}
    rules |= {name: f"forall(transform(generation_attempts, (x, i) -> coalesce({rule}, false)), y -> y)" for name, rule in every.items()}
    first, final, later = "try_element_at(generation_attempts, 1)", "try_element_at(generation_attempts, -1)", "slice(generation_attempts, 2, greatest(size(generation_attempts), 1))"
    total = lambda field, of="generation_attempts", zero="0L": f"aggregate({of}, {zero}, (a, x) -> a + x.{field})"
    more = "(size(generation_attempts) > 1)"
    rules |= {
        "repair_after_valid": f"not {more} or {first}.format_valid = false",
        "invalid_in_the_end": f"{final}.format_valid",
        "retry_calls": "retry_calls = size(generation_attempts) - 1",
        "retry_seconds": f"abs(retry_seconds - {total('duration_seconds', later, '0D')}) <= 1e-9",
        "triggered": f"format_repair_triggered = {more}",
        "succeeded": f"format_repair_succeeded = {more}",
        "initial_flag": f"initial_format_valid = {first}.format_valid",
        "prompt_tokens": f"prompt_tokens = {total('prompt_tokens')}",
        "completion_tokens": f"completion_tokens = {total('completion_tokens')}",
        "seconds": f"abs(duration_seconds - {total('duration_seconds', zero='0D')}) <= 1e-9",
    }
    return rules | {f"final_view:{name}": f"{name} <=> {final}.{name}" for name in _FINAL}


def repair_violations(events: DataFrame, policy: str | None, parser_policy: str | None = None, no_document_policy: str | None = None, budget: int | None = None) -> DataFrame:
    """``qid, event, reason`` for every rule that an event (columns of ``EVENT``) breaks; what is null where a rule needs it breaks the rule."""
    rules = repair_rules(policy, parser_policy, no_document_policy, budget)
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return events.select("qid", "event", F.explode(broken).alias("reason"))


#: Totals of a telemetry row that its events must add up to.
CHARGES = ("calls", "retry_calls", "retry_seconds", "prompt_tokens", "completion_tokens", "duration_seconds", "generations", "initial_format_failures", "format_repair_successes")


def charge_violations(telemetry: DataFrame, events: DataFrame) -> DataFrame:
    """``qid, reason`` (``charge:<total>``) where a telemetry row's totals, named as ``CHARGES``, aren't the sums over its events.

    Events count themselves: their generations, the retries among them and
    what those took. A query of events without a row is ``uncharged``. Sums are
    made before the shuffle, so a query of many events is no hot one.
    """
    one = events.select(
        "qid",
        F.lit(1).alias("calls"),
        F.coalesce(F.expr("size(generation_attempts) - 1"), F.lit(0)).alias("retry_calls"),
        F.expr("coalesce(aggregate(slice(generation_attempts, 2, greatest(size(generation_attempts), 1)), 0D, (a, x) -> a + x.duration_seconds), 0D)").alias("retry_seconds"),
        "prompt_tokens",
        "completion_tokens",
        "duration_seconds",
        F.coalesce(F.expr("size(generation_attempts)"), F.lit(1)).alias("generations"),
        F.expr("coalesce(generation_attempts[0].format_valid, format_valid) <=> false").cast("int").alias("initial_format_failures"),
        F.coalesce(F.expr("size(generation_attempts) - 1"), F.lit(0)).alias("format_repair_successes"),
    )
    sums = one.groupBy("qid").agg(*[F.sum(c).alias(f"__{c}") for c in CHARGES], F.lit(True).alias("__told"))
    both = telemetry.withColumn("__row", F.lit(True)).join(sums, "qid", "full")
    same = lambda c: F.abs(F.col(c) - F.coalesce(F.col(f"__{c}"), F.lit(0))) <= (1e-9 if c.endswith("seconds") else 0)
    broken = [F.when(F.col("__row") & ~F.coalesce(same(c), F.lit(False)), F.lit(f"charge:{c}")) for c in CHARGES]
    broken.append(F.when(F.col("__row").isNull(), F.lit("uncharged")))
    return both.select("qid", F.explode(F.array_compact(F.array(*broken))).alias("reason"))


def all_reasons(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
