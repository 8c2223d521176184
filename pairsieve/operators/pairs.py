"""Shaping preference pairs: sections, positions, label noise, joins between sides, labels and sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_uniform
from ..session import materialise

# ---- fixed values: sections of the evaluation set and their subsets ----
SECTION_SUBSETS = {
    "chat": ["alpacaeval-easy", "alpacaeval-length", "alpacaeval-hard", "mt-bench-easy", "mt-bench-medium"],
    "chat_hard": [
        "mt-bench-hard",
        "llmbar-natural",
        "llmbar-adver-neighbor",
        "llmbar-adver-GPTInst",
        "llmbar-adver-GPTOut",
        "llmbar-adver-manual",
    ],
    "safety": [
        "refusals-dangerous",
        "refusals-offensive",
        "xstest-should-refuse",
        "xstest-should-respond",
        "donotanswer",
    ],
    "reasoning": ["math-prm", "hep-cpp", "hep-go", "hep-java", "hep-js", "hep-python", "hep-rust"],
}
# ---- fixed values: columns of the two supported correction datasets ----
CORRECTION_COLUMNS = {
    "Owishiboo/grammar-correction": {"preferred": "target", "dispreferred": "input"},
    "jhu-clsp/jfleg": {"preferred": "corrections", "dispreferred": "sentence"},
}
ANNOTATIONS_PER_SENTENCE = 4


def section_table(spark, mapping: Mapping[str, Sequence] = SECTION_SUBSETS) -> DataFrame:
    """The (section, subset) dimension table."""
    return spark.createDataFrame([(s, x) for s, subsets in mapping.items() for x in subsets], ["section", "subset"])


def keep_section(df: DataFrame, sections: DataFrame, section: str = "") -> DataFrame:
    """Rows whose subset belongs to ``section``; the empty name keeps every row."""
    if not section:
        return df
    wanted = sections.where(F.col("section") == section).select("subset").distinct()
    return df.join(wanted, "subset", "left_semi")


def attach_section(df: DataFrame, sections: DataFrame) -> DataFrame:
    """Add the section of each row's subset."""
    return df.join(sections, "subset", "inner")


def assign_positions(df: DataFrame, order_by: Sequence[str], name: str = "example_num") -> DataFrame:
    """0-based position of every row in the order of ``order_by``, which must identify a row.

    A range-partitioned sort is written to the shared folder, so that the numbering cannot shift if an
    executor is lost; row counts per partition then give each partition its offset. No task sees
    more than its own range.
    """
    ordered = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_rank", F.monotonically_increasing_id())
    )
    ordered = materialise(ordered, "positions")
    # The id holds the partition in its upper bits and the rank inside the partition in the lower 33.
    ranked = ordered.withColumn("_part", F.shiftright("_rank", 33)).withColumn(
        "_rank", F.col("_rank").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        ranked.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_rank"))
        .drop("_part", "_rank", "_offset")
    )


def take_positions(df: DataFrame, index: DataFrame, key: str = "example_num", order: str = "ord") -> DataFrame:
    """Rows at a list of positions, in list order; a position listed twice gives its row twice."""
    return df.join(index, key, "inner").orderBy(order)


def first_annotation(corrections: Column | str) -> Column:
    """First entry of a four-annotator column; another number of entries is an error."""
    c = F.col(corrections) if isinstance(corrections, str) else corrections
    wrong = F.concat(
        F.lit(f"expected {ANNOTATIONS_PER_SENTENCE} corrections, found "), F.size(c).cast("string")
    )
    return F.when(F.size(c) == ANNOTATIONS_PER_SENTENCE, F.element_at(c, 1)).otherwise(
        F.raise_error(wrong).cast("string")
    )


def to_preference(df: DataFrame, dataset: str, keep: Sequence[str] = ()) -> DataFrame:
    """Map a correction dataset's columns to (preferred, dispreferred)."""
    if dataset not in CORRECTION_COLUMNS:
        raise ValueError(f"dataset {dataset!r} is not supported")
    columns = CORRECTION_COLUMNS[dataset]
    preferred = (
        first_annotation("corrections") if columns["preferred"] == "corrections" else F.col(columns["preferred"])
    )
    return df.select(
        *keep, preferred.alias("preferred"), F.col(columns["dispreferred"]).alias("dispreferred")
    )


def swap_with_noise(
    df: DataFrame,
    noise: float,
    key: str = "example_num",
    seed: int = 42,
    first: str = "preferred",
    second: str = "dispreferred",
) -> DataFrame:
    """Swap the two sides with probability ``noise``; adds ``is_swapped``."""
    if not 0.0 <= noise <= 1.0:
        raise ValueError("noise must lie in [0, 1]")
    swap = seeded_uniform(seed, key) < F.lit(float(noise))
    marked = df.withColumn("is_swapped", swap)
    return marked.withColumns(
        {
            first: F.when(F.col("is_swapped"), F.col(second)).otherwise(F.col(first)),
            second: F.when(F.col("is_swapped"), F.col(first)).otherwise(F.col(second)),
        }
    )


def pair_sides(chosen: DataFrame, rejected: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per example out of one row per side: ``v`` becomes ``v_chosen`` and ``v_rejected``."""
    left = chosen.withColumnsRenamed({v: f"{v}_chosen" for v in values})
    right = rejected.select(*on, *[F.col(v).alias(f"{v}_rejected") for v in values])
    return left.join(right, list(on), "inner")


def redundant_part(df: DataFrame, redundant: DataFrame, key: Sequence[str] = ("example_num",)) -> DataFrame:
    """Rows whose key is in the redundant set."""
    return df.join(redundant.select(*key), list(key), "left_semi")


def non_redundant_part(df: DataFrame, redundant: DataFrame, key: Sequence[str] = ("example_num",)) -> DataFrame:
    """Rows whose key is not in the redundant set."""
    return df.join(redundant.select(*key), list(key), "left_anti")


def flag_membership(
    df: DataFrame, members: DataFrame, key: Sequence[str] = ("example_num",), name: str = "is_redundant"
) -> DataFrame:
    """Add a boolean: whether the row's key is in ``members``."""
    marked = members.select(*key).distinct().withColumn(name, F.lit(True))
    return df.join(marked, list(key), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def attach_labels(scored: DataFrame, labels: DataFrame, key: str = "example_num") -> DataFrame:
    """Attach subset labels to scored examples; rows without a label get NULL, which ``label_coverage`` counts."""
    return scored.join(labels.select(key, "subset"), key, "left")


def label_coverage(labelled: DataFrame) -> DataFrame:
    """One row: scored examples, labelled examples, and whether every one has its label."""
    return labelled.agg(
        F.count(F.lit(1)).alias("n_scored"),
        F.count("subset").alias("n_labelled"),
        (F.count(F.lit(1)) == F.count("subset")).alias("is_complete"),
    )


# Positions are cut into so many equal parts, and each label's range meets the parts that it touches.
LABEL_PARTS = 4096


def allocate_labels(df: DataFrame, labels: DataFrame, position: str = "example_num") -> DataFrame:
    """Give rows labels in proportion to ``labels(subset, example_count, ord)`` when their own are lost.

    In label order each label takes ``int(share·n)`` consecutive positions; what rounding leaves over goes
    to the first label. Positions run from 0 to n−1. Rows and ranges meet in an equi-join on parts of the positions.
    """
    n = df.count()
    everything, upto = Window.partitionBy(F.lit(0)), Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("example_count").cast("double") / F.sum("example_count").over(everything)
    sized = labels.select("ord", "subset", F.floor(share * F.lit(n)).alias("_size"))
    ranges = sized.withColumn("_stop", F.sum("_size").over(upto)).withColumn("_start", F.col("_stop") - F.col("_size"))
    first = labels.orderBy("ord").select("subset").first()
    if first is None:
        raise ValueError("there are no labels")
    width = max(1, -(-n // LABEL_PARTS))
    parts = F.sequence(F.floor(F.col("_start") / width), F.floor((F.col("_stop") - 1) / width))
    ranges = ranges.where("_size > 0").select(F.col("subset").alias("_label"), "_start", "_stop", F.explode(parts).alias("_part"))
    placed = df.drop("subset").withColumn("_part", F.floor(F.col(position) / width))
    inside = (F.col(position) >= F.col("_start")) & (F.col(position) < F.col("_stop"))
    joined = placed.alias("p").join(ranges.alias("r"), (F.col("p._part") == F.col("r._part")) & inside, "left")
    return joined.select(
        *[F.col(f"p.`{c}`") for c in df.columns if c != "subset"], F.coalesce("_label", F.lit(first["subset"])).alias("subset")
    )


def union_sections(parts: Sequence[DataFrame]) -> DataFrame:
    """One table out of per-section results with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def subset_names(df: DataFrame) -> DataFrame:
    return df.select("subset").distinct()
