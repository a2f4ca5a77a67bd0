"""Model families of tags."""

from pyspark.sql import functions as F

from rankforge.functions import text


def test_families(spark):
    tags = ["qwen3-5-9b", "qwen3-8b", "meta-llama-3-1-8b", "ministral-3-8b", "Llama-3.1-8b", "x"]
    got = spark.createDataFrame([(t,) for t in tags], "t string").select(text.model_family(F.col("t")), text.model_family_dashed(F.col("t"))).collect()
    assert [r[0] for r in got] == ["qwen3.5", "qwen3", "llama3.1", "mistral3", "unknown", "unknown"]
    assert [r[1] for r in got] == ["qwen3.5", "qwen3", "llama3.1", "mistral3", "llama3.1", "unknown"]
