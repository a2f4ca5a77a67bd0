"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, exact_dedup, fill_middle, importance, language_id, mixing, ngram_join, quality_classifier, quality_rules, substring_dedup, suffix_dedup, warc
from ._session import cut, shared_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(parts: int, part: int):
    """Whether a document is in that part; one without an id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_read(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    return byte_bpe.encode_and_decode(_read(spark, sf_dir, "documents"), path, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_suffixes(_read(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), ~_fold(3, 1))
    return out.select("doc_id", _fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_read(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"), width=5, percent=80)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.predict_language(_read(spark, sf_dir, "documents"), ~_fold(4, 2))
    return out.select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score", "langs")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    planned = mixing.plan_mix(cut(docs), size_col="size")
    return planned.select("row.doc_id", "row.size", "source_size", "target", (F.col("row.size") * F.size("shards")).alias("taken"), "block", "shards")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.build_conversations(_read(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_quality_rules(_read(spark, sf_dir, "documents")).drop("host_rate_short", "host_rate_repeat")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_read(spark, sf_dir, "documents"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("n_words")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_warc(_read(spark, sf_dir, "pages"), path)
    read = warc.read_warc(spark, path)
    found = F.struct(F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    narrow = read.select("record_id", "type", "page_id", "refers_to", found.alias("found")).select("record_id", "type", "page_id", "refers_to", "found.*")
    out = warc.resolve_revisits(cut(narrow))
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_substring_dedup, op2_byte_bpe, op3_suffix_dedup, op4_quality_classifier, op5_exact_dedup, op6_ngram_jaccard_join, op7_language_id, op8_source_mix, op9_chat_format, op10_quality_rules, op11_fill_middle, op12_importance_resampling, op13_warc]
    return {f.__name__: f for f in found}


_WORDS = r"[^\x20\x09-\x0D]+"

#: DuckDB SQL for the rows of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 33, 1))) AS t(i)),
rep AS (SELECT doc_id, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(35) AS r(j)),
word AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)""",
    "op5_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op6_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)""",
    "op10_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(source, '-') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 6, 1))) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(8) AS r(j) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
b AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
 FROM w JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeat FROM b),
h AS (SELECT host, count(*) AS d, count(*) FILTER (WHERE short) AS ks, count(*) FILTER (WHERE repeat) AS kr FROM f GROUP BY host),
p AS (SELECT sum(ks) / sum(d) AS ms, var_pop(ks / d) AS vs, sum(kr) / sum(d) AS mr, var_pop(kr / d) AS vr, avg(1 / d) AS u FROM h),
q AS (SELECT ms, mr, least(greatest(ms * (1 - ms) / greatest(vs - ms * (1 - ms) * u, 1e-6) - 1, 2), 1e6) AS ws, least(greatest(mr * (1 - mr) / greatest(vr - mr * (1 - mr) * u, 1e-6) - 1, 2), 1e6) AS wr FROM p),
r AS (SELECT host, d, ms, mr, ws, wr, (ks + ms * ws) / (d + ws) AS rs, (kr + mr * wr) / (d + wr) AS rr FROM h, q),
v AS (SELECT host, rs - 3 * sqrt(rs * (1 - rs) / (d + ws + 1)) > greatest(0.5, ms) AS gs, rr - 3 * sqrt(rr * (1 - rr) / (d + wr + 1)) > greatest(0.5, mr) AS gr FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeat AS base_failed, NOT (short OR repeat OR gs OR gr) AS kept,
 concat_ws(',', CASE WHEN gs THEN 'short' END, CASE WHEN gr THEN 'repeat' END) AS host_guilty
FROM f JOIN v USING (host)""",
    "op11_fill_middle": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
x AS (SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(s, k::INT, 8))::BIGINT) AS g FROM h),
c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS lo, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS hi,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_importance_resampling": r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)),
w AS MATERIALIZED (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
 UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS MATERIALIZED (SELECT kind, id, array_to_string(ws[i:i + k], ' ') AS g, count(*) AS n FROM w, range(3) AS o(k), unnest(range(1, len(ws) - k + 1)) AS t(i) GROUP BY ALL),
s AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM f)),
crc AS MATERIALIZED (SELECT g, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM s, tab),
c AS (SELECT bucket, sum(n) FILTER (WHERE kind = 'd') AS s, sum(n) FILTER (WHERE kind = 'b') AS t FROM f JOIN crc USING (g) GROUP BY bucket),
z AS (SELECT sum(s) AS sn, sum(t) AS tn FROM c),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce(sn, 0) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(tn, 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM c, z),
d AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN crc USING (g) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY id),
v AS (SELECT w.id AS doc_id, coalesce(len(ws), 0) >= 20 AS can, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d ON d.doc_id = w.id WHERE kind = 'd'),
r AS (SELECT *, row_number() OVER (ORDER BY can DESC, score DESC, doc_id) AS k, (count(*) FILTER (WHERE can) OVER ()) * 5 // 100 AS most FROM v)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= most THEN k END AS rank FROM r""",
    "op13_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
}
