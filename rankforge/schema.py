"""Schemas of the tables that the engine reads and writes."""

RUN = "qid string, docid string, rank int, score double, tag string, pos long"
QUERY = "qid string, text string"
DOC = "docid string, title string, text string"
POOL = "qid string, pos int, docid string, score double, text string"
QRELS = "qid string, docid string, rel int, iteration string"
EVAL = "metric string, qid string, value double"
ATTEMPT = "struct<attempt_index:int,raw_output:string,prompt_tokens:bigint,completion_tokens:bigint,accepted:boolean,parse_result:string,parse_reason:string>"
COMPARISON = f"qid string, type string, positions array<string>, selected string, docids array<string>, label_scheme string, parse_status string, parse_fallback_reason string, raw_output string, raw_attempts array<{ATTEMPT}>"
RANKING = "qid string, docid string, rank int, score double"
TELEMETRY = (
    "schema_version int, qid string, method string, output_objective string, output_depth int, llm_calls long, retry_inclusive_llm_calls long, selection_steps long, non_llm_bypasses long, "
    "nominal_prompt_tokens long, nominal_completion_tokens long, nominal_total_tokens long, retry_prompt_tokens long, retry_completion_tokens long, retry_total_tokens long, "
    "actual_prompt_tokens long, actual_completion_tokens long, actual_total_tokens long, wall_seconds double, retry_seconds double, retry_excluded_wall_seconds double, status string, error string"
)
