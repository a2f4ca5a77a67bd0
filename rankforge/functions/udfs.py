"""Arrow UDFs around the label grammar."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from . import labels

# type objects, not DDL strings: the module can be imported before a session exists
DUAL = StructType().add("best", StringType()).add("worst", StringType())
_ROW = StructType().add("pos", IntegerType()).add("idx", IntegerType())


@F.pandas_udf(StringType())
def parse_single(raw: pd.Series, scheme: pd.Series, n: pd.Series, strict: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else labels.parse_single(r, s, int(k), bool(t)) for r, s, k, t in zip(raw, scheme, n, strict, strict=True)], dtype=object)


@F.pandas_udf(DUAL)
def parse_dual(raw: pd.Series, scheme: pd.Series, n: pd.Series, strict: pd.Series) -> pd.DataFrame:
    got = [None if r is None else labels.parse_dual(r, s, int(k), bool(t)) for r, s, k, t in zip(raw, scheme, n, strict, strict=True)]
    return pd.DataFrame([g or (None, None) for g in got], columns=["best", "worst"])


@F.pandas_udf(StringType())
def noop_reason(raw: pd.Series, scheme: pd.Series, n: pd.Series) -> pd.Series:
    first = lambda r, s, k: labels.out_of_window(r, s, k) or labels.numeric_noop(r, s, k) or labels.exhausted_noop(r, s, k)
    return pd.Series([None if r is None else first(r, s, int(k)) for r, s, k in zip(raw, scheme, n, strict=True)], dtype=object)


@F.udtf(returnType=_ROW)
class PermutationTable:
    def eval(self, text: str, n: int):
        for pos, idx in enumerate(labels.parse_permutation(text or "", n)):
            yield pos, idx
