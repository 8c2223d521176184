"""Record files by extension, preference datasets, reports and failure lists."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import CHOSEN, REJECTED, misranked_pairs


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = True) -> DataFrame:
    """Read ``.csv`` (header, every column a string), ``.json`` (array), ``.jsonl`` or ``.parquet``.

    ``multiline=False`` lets Spark split a CSV file whose records hold no line breaks; otherwise each file is one task, so
    files should be of bounded size, as ``write_csv`` makes them. Without a ``schema`` JSON takes one extra pass to infer it.
    """
    kind = PurePosixPath(path.rstrip("/")).suffix
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == ".csv":
        # Quotes are doubled inside quoted fields and an empty field is an empty string, as in RFC 4180.
        raw = (
            reader.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", multiline)
            .option("maxCharsPerColumn", -1)
            .csv(path)
        )
        return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])
    if kind == ".json":
        return reader.option("multiLine", True).json(path)
    if kind == ".jsonl":
        return reader.json(path)
    if kind == ".parquet":
        return reader.parquet(path)
    raise ValueError(f"{path}: unrecognised file extension {kind!r}")


def write_csv(df: DataFrame, path: str, rows_per_file: int = 200_000) -> None:
    """Quoted CSV files of bounded size: a file whose records may hold line breaks is read by one task."""
    (
        df.write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", True)
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_preferences(spark: SparkSession, root: str, split: str, columns: Mapping[str, str]) -> DataFrame:
    """A stored dataset split with its columns renamed: ``columns`` maps our name to the stored one."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{split}")
    return df.select(*[F.col(theirs).alias(ours) for ours, theirs in columns.items()])


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object per line, in as many files as there are partitions."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report_json(report: DataFrame) -> DataFrame:
    """Each report row as one JSON string; keys with NULL are written."""
    return report.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report")
    )


def write_failures(scored: DataFrame, path: str, texts: tuple[str, str] = ("preferred", "dispreferred")) -> None:
    """Misranked pairs with both scores, both texts and the score difference."""
    failures = misranked_pairs(scored).select("diff", CHOSEN, texts[0], REJECTED, texts[1])
    write_records(failures, path)
