"""Stored redundancy results, partitioned by model, data name, solver and threshold."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ("model", "data_name", "solver", "threshold")


class RedundantSetMissing(LookupError):
    """No stored redundant set for the model, data, solver and threshold asked for."""


def save_redundant_set(results: DataFrame, root: str, model: str, data_name: str, solver: str, threshold: float) -> None:
    """Write (example_num, is_redundant) of every example, replacing only this result's partition."""
    table = results.select(
        "example_num",
        "is_redundant",
        F.lit(model).alias("model"),
        F.lit(data_name).alias("data_name"),
        F.lit(solver).alias("solver"),
        F.lit(str(threshold)).alias("threshold"),
    )
    (
        table.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(root)
    )


def lookup_redundant_set(
    spark: SparkSession, root: str, model: str, data_name: str, solver: str, threshold: float
) -> DataFrame:
    """(example_num, is_redundant) of one stored result; only its partition is read."""
    wanted = f"{model} / {data_name} / {solver} / {threshold}"
    try:
        table = spark.read.option("recursiveFileLookup", False).parquet(root)
    except AnalysisException as missing:
        raise RedundantSetMissing(wanted) from missing
    stored = table.where(
        (F.col("model") == model)
        & (F.col("data_name") == data_name)
        & (F.col("solver") == solver)
        & (F.col("threshold").cast("double") == float(threshold))
    ).select("example_num", "is_redundant")
    if stored.isEmpty():
        raise RedundantSetMissing(wanted)
    return stored
