"""Text and name projections, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(text: Column, tokens: int) -> Column:
    """The first ``tokens`` white-space tokens."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, tokens), " ")


def cap_words(text: Column, words: int = 300) -> Column:
    return truncate(text, words)


def normal_hash(text: Column) -> Column:
    """sha256 of the text with runs of (Unicode) white space as one space."""
    return F.sha2(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 256)


def model_tag(model: Column) -> Column:
    return F.lower(F.translate(F.element_at(F.split(model, "/"), -1), "./", "--"))


# fixed values: beginnings of model tags and their families; in the dashed form dots were written as dashes
_FAMILIES = [("qwen3-5-", "qwen3.5"), ("meta-llama-", "llama3.1"), ("ministral-3-", "mistral3"), ("qwen3-", "qwen3")]
_FAMILIES_DASHED = [("qwen3-5-", "qwen3.5"), ("meta-llama-3-1-", "llama3.1"), ("llama-3-1-", "llama3.1"), ("ministral-3-", "mistral3"), ("mistral-3-", "mistral3"), ("qwen3-", "qwen3")]


def _family(tag: Column, table: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(tag.startswith(k), F.lit(v)) for k, v in table], F.lit("unknown"))


def model_family(tag: Column) -> Column:
    return _family(F.lower(tag), _FAMILIES)


def model_family_dashed(tag: Column) -> Column:
    return _family(F.translate(F.lower(tag), ".", "-"), _FAMILIES_DASHED)


def natural_key(text: Column) -> Column:
    """Sort key: the number at the end, those without one last, then the text."""
    n = F.expr("1") * F.nullif(F.regexp_extract(text, r"(\d+)$", 1), F.lit("")).cast("long")
    return F.struct(n.isNull().alias("none"), n.alias("number"), text.alias("text"))


def permutation(response: Column, n: Column) -> Column:
    """0-based order of ``n`` documents from a model's text: numbers once each, out-of-range ones dropped, the rest appended."""
    named = F.transform(F.regexp_extract_all(response, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int") - 1)
    named = F.array_distinct(F.filter(named, lambda x: (x >= 0) & (x < n)))  # a number too long is null, hence out of range
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(named, F.array_except(every, named))
