"""Stored scores and feature vectors, partitioned by model and section."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import checksum
from ..functions.vectors import as_float, difference
from ..operators.metrics import correct_pairs

FEATURE_COLUMNS = ("score_chosen", "score_rejected", "f_chosen", "f_rejected", "f_diff")


def inputs_id(inputs: DataFrame, scorer: str) -> str:
    """What scores and features are computed from: the scorer's name and a checksum of all columns of the inputs, in any order of rows."""
    return f"{scorer}|{inputs.agg(checksum(*inputs.columns).alias('c')).first()['c']}"


def save_features(scored: DataFrame, root: str, model: str, section: str, inputs: str | None = None) -> None:
    """Write one model's scores, both feature vectors and their difference for one section.

    Only the (model, section) partition is replaced. Each row says what it was computed from (``inputs_id``), so rows and
    statement cannot come apart.
    """
    table = scored.select(
        "example_num",
        "subset",
        F.col("score_chosen").cast("double"),
        F.col("score_rejected").cast("double"),
        as_float("f_chosen").alias("f_chosen"),
        as_float("f_rejected").alias("f_rejected"),
        difference("f_chosen", "f_rejected").alias("f_diff"),
        F.lit(model).alias("model"),
        F.lit(section).alias("section"),
        F.lit(inputs).cast("string").alias("inputs"),
    )
    (
        table.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "section")
        .parquet(root)
    )


def _stored(spark: SparkSession, root: str, model: str, section: str) -> DataFrame:
    # Partitions written before ``inputs`` was kept have no such column.
    table = spark.read.option("mergeSchema", True).parquet(root)
    return table.where((F.col("model") == model) & (F.col("section") == section))


def read_features(spark: SparkSession, root: str, model: str, section: str, correct_only: bool = False) -> DataFrame:
    """One (model, section) partition; the filter prunes the others."""
    df = _stored(spark, root, model, section).drop("inputs")
    return correct_pairs(df) if correct_only else df


def load_matrix(spark: SparkSession, path: str, column: str = "features") -> DataFrame:
    """A feature matrix as (example_num, features ARRAY<FLOAT>). A row of another length is an error when read."""
    df = spark.read.parquet(path)
    head = df.select(F.size(column).alias("d")).limit(1).collect()
    if not head:
        raise ValueError(f"{path}: no rows")
    d = head[0]["d"]
    wrong = F.concat(F.lit(f"expected {d} components, found "), F.size(column).cast("string"))
    checked = F.when(F.size(column) == d, as_float(column)).otherwise(
        F.raise_error(wrong).cast("array<float>")
    )
    return df.select("example_num", checked.alias("features"))


def usable_features(spark: SparkSession, root: str, model: str, section: str, inputs: str | None = None) -> DataFrame | None:
    """Stored features if they exist and every row has its scores and vectors; otherwise ``None``.

    With ``inputs`` (from ``inputs_id``) every row must also have been computed from just these.
    """
    try:
        stored = _stored(spark, root, model, section)
    except AnalysisException:
        return None
    said = F.col("inputs") if "inputs" in stored.columns else F.lit(None).cast("string")
    counts = stored.agg(
        F.count_if(said.eqNullSafe(F.lit(inputs))).alias("own"),
        F.count("f_diff").alias("features"),
        F.count("score_chosen").alias("chosen"),
        F.count("score_rejected").alias("rejected"),
    ).first()
    if counts["features"] == 0 or len({counts["features"], counts["chosen"], counts["rejected"]}) != 1:
        return None
    if inputs is not None and counts["own"] != counts["features"]:
        return None
    return stored.drop("inputs")


def reuse_or_compute(
    spark: SparkSession,
    root: str,
    model: str,
    section: str,
    compute: Callable[[], DataFrame],
    force: bool = False,
    skip_cache: bool = False,
    inputs: str | None = None,
) -> DataFrame:
    """Stored features where usable, else the result of ``compute``, saved first unless ``skip_cache``.

    ``force`` computes and overwrites; ``skip_cache`` computes and leaves the store alone. With ``inputs`` (from ``inputs_id``)
    features of other texts or of another scorer are computed again, however many rows they have.
    """
    if not (force or skip_cache):
        stored = usable_features(spark, root, model, section, inputs)
        if stored is not None:
            return stored
    computed = compute()
    if skip_cache:
        return computed
    save_features(computed, root, model, section, inputs)
    return read_features(spark, root, model, section)
