"""One vector per example out of one vector per token."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("first", "last", "last_token", "mean")


def pool_tokens(df: DataFrame, mode: str, key: str = "example_num", pos: str = "pos", vec: str = "vec", is_pad: str = "is_pad") -> DataFrame:
    """Pool token vectors: ``first``, ``last`` (padding included), ``last_token`` (padding excluded) or ``mean``."""
    if mode == "first":
        pooled = F.min_by(vec, pos)
    elif mode == "last":
        pooled = F.max_by(vec, pos)
    elif mode == "last_token":
        pooled = F.max_by(vec, F.when(~F.col(is_pad), F.col(pos)))
    elif mode == "mean":
        pooled = vector_to_array(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))))
    else:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    return df.groupBy(key).agg(pooled.alias("pooled"))
