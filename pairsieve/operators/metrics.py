"""Accuracy, ablation, loss and quantile metrics over scored pairs.

``accuracy_pct`` columns are percentages, ``accuracy`` columns fractions. An empty set has NULL accuracy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import pair_loss, wins
from ..functions.vectors import non_zero_sum
from ..session import materialise
from .sampling import mark_sample, random_exclusion_size

CHOSEN, REJECTED = "score_chosen", "score_rejected"


def _correct(tie_policy: str = "gt") -> Column:
    return wins(CHOSEN, REJECTED, tie_policy).cast("int")


def pair_accuracy(df: DataFrame, by: Sequence[str] = (), tie_policy: str = "gt") -> DataFrame:
    """Number of pairs, number correct, accuracy in percent and as a fraction (per group ``by``)."""
    hit = _correct(tie_policy)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.coalesce(F.sum(hit), F.lit(0)).alias("n_correct"),
        (F.avg(hit) * 100).alias("accuracy_pct"),
        F.avg(hit).alias("accuracy"),
    )


def correct_pairs(df: DataFrame, tie_policy: str = "gt") -> DataFrame:
    return df.where(wins(CHOSEN, REJECTED, tie_policy))


def misranked_pairs(df: DataFrame) -> DataFrame:
    """Pairs whose dispreferred side scored higher, with the score difference."""
    return df.where(~wins(CHOSEN, REJECTED, "ge")).withColumn("diff", F.col(CHOSEN) - F.col(REJECTED))


def subset_accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pair_accuracy(df, [*by, "subset"]).drop("accuracy_pct")


def section_scores(per_subset: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Subset accuracies averaged with weights ``(section, subset, example_count)`` over the subsets present."""
    return (
        per_subset.join(weights, "subset")
        .groupBy(*by, "section")
        .agg(
            (F.sum(F.col("accuracy") * F.col("example_count")) / F.sum("example_count")).alias("section_score"),
            F.count(F.lit(1)).alias("n_subsets"),
        )
    )


def ablation(flagged: DataFrame, by: Sequence[str] = (), key: Sequence[str] = ("example_num",), seed: int = 42) -> DataFrame:
    """Accuracy of all pairs, of the non-redundant, of the redundant, and after removing equally many random ones.

    ``flagged`` has the two scores and ``is_redundant``. One aggregate over the flagged rows gives every part.
    """
    redundant = F.col("is_redundant")
    drawn = mark_sample(
        flagged.select(*by, *key, CHOSEN, REJECTED, "is_redundant"),
        random_exclusion_size(),
        key,
        by,
        seed,
        totals={"n_redundant": F.sum(redundant.cast("bigint"))},
        name="is_excluded",
    )
    pct = _correct() * 100.0
    excluded = F.col("is_excluded")
    return drawn.groupBy(*by).agg(
        F.avg(pct).alias("accuracy_full"),
        F.avg(F.when(~redundant, pct)).alias("accuracy_non_redundant"),
        F.avg(F.when(redundant, pct)).alias("accuracy_redundant"),
        F.avg(F.when(~excluded, pct)).alias("accuracy_random"),
        F.struct(
            F.count(F.lit(1)).alias("total"),
            F.count_if(redundant).alias("redundant"),
            F.count_if(~redundant).alias("non_redundant"),
            F.count_if(excluded).alias("random_excluded"),
        ).alias("counts"),
    )


def part_shares(df: DataFrame, part: str, by: Sequence[str] = (), tie_policy: str = "ge") -> DataFrame:
    """Accuracy of each part with its share of all rows, and the size-weighted overall accuracy."""
    parts = pair_accuracy(df, [*by, part], tie_policy).drop("accuracy_pct")
    everything = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return parts.withColumns(
        {
            "share_pct": F.col("n_pairs") / F.sum("n_pairs").over(everything) * 100,
            "overall_accuracy": F.sum(F.col("accuracy") * F.col("n_pairs")).over(everything)
            / F.sum("n_pairs").over(everything),
        }
    )


def redundancy_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, percentage, zero and non-zero redundant rows."""
    redundant, zero = F.col("is_redundant"), F.col("is_zero")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.count_if(redundant).alias("n_redundant"),
        F.count_if(~redundant).alias("n_non_redundant"),
        (F.avg(redundant.cast("int")) * 100).alias("redundant_pct"),
        F.count_if(redundant & zero).alias("n_zero_redundant"),
        F.count_if(redundant & ~zero).alias("n_non_zero_redundant"),
    )


def method_usage(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many rows each solver decided, and their percentage."""
    used = results.groupBy(*by, "method").agg(F.count(F.lit(1)).alias("n_rows"))
    everything = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return used.withColumn("usage_pct", F.col("n_rows") / F.sum("n_rows").over(everything) * 100)


def distinct_sums(df: DataFrame, diff: str = "f_diff", digits: int = 6) -> DataFrame:
    """The distinct sums of the difference vectors' non-zero components, one per row."""
    return df.select(F.round(non_zero_sum(diff), digits).alias("diff_sum")).distinct()


def distinct_sum_total(df: DataFrame, diff: str = "f_diff", digits: int = 6) -> DataFrame:
    """How many distinct sums there are and what they add up to."""
    return distinct_sums(df, diff, digits).agg(
        F.count(F.lit(1)).alias("n_distinct"), F.sum("diff_sum").alias("overall_sum")
    )


def mean_pair_loss(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of −log σ(chosen − rejected) over all pairs."""
    return df.groupBy(*by).agg(
        F.avg(pair_loss(CHOSEN, REJECTED)).alias("mean_loss"), F.count(F.lit(1)).alias("n_pairs")
    )


def best_model(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The epoch with the highest validation accuracy; the later one wins a tie."""
    return metrics.groupBy(*by).agg(
        F.max_by("model", F.struct("accuracy", "epoch")).alias("model"),
        F.max(F.struct("accuracy", "epoch")).alias("_best"),
    ).select(*by, "model", "_best.accuracy", "_best.epoch")


# ---- quantiles ----

# 0.05, 0.10, …, 0.95
QUANTILES = tuple(round(0.05 * i, 2) for i in range(1, 20))


def approximate_quantiles(df: DataFrame, value: str, by: Sequence[str] = (), probs: Sequence[float] = QUANTILES) -> DataFrame:
    """Quantiles from a bounded sketch, one row per group and probability."""
    sketch = F.percentile_approx(value, F.array(*[F.lit(p) for p in probs]), 10_000).alias("_q")
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("prob"), F.col("_q").alias("quantile"))
    return df.groupBy(*by).agg(sketch).select(*by, F.inline(pairs))


SIGN = -(1 << 63)


@F.pandas_udf(T.LongType())
def _ordered_bits(values: pd.Series) -> pd.Series:
    """Doubles as 64-bit integers whose unsigned order is that of the doubles; NaN comes last."""
    bits = values.to_numpy(np.float64, na_value=np.nan).view(np.int64)
    return pd.Series(np.where(bits < 0, ~bits, bits ^ np.int64(SIGN)))


@F.pandas_udf(T.DoubleType())
def _from_bits(ordered: pd.Series) -> pd.Series:
    bits = ordered.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(SIGN), ~bits).view(np.float64))


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str] = (), probs: Sequence[float] = QUANTILES) -> DataFrame:
    """Linearly interpolated quantiles, exact: radix selection, in which nothing is sorted but counts.

    Doubles become 64-bit integers in the same order, of which 16 bits are looked at per round, the highest first. A round is
    one scan that counts, with partial sums, how often each digit follows the prefixes that hold a wanted rank; running sums
    of at most 65,536 counts say which digit each rank goes on with. Four rounds give every rank of every group, at any size and
    however often a value is repeated. NULLs are left out, -0.0 counts as 0.0, NaN is the largest value; a NULL group is one.
    """
    by = list(by)
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_one"))
    known = df.where(F.col(value).isNotNull())
    values = materialise(known.select(group.alias("_g"), _ordered_bits(F.col(value).cast("double") + 0.0).alias("_u")), "values")
    counts = values.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    # 0-based ranks floor(p(n−1)) and the next one.
    wanted = counts.select("_g", "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    wanted = wanted.withColumn("_at", F.col("prob") * (F.col("_n") - 1)).withColumn("_low", F.floor("_at"))
    ranks = F.array_distinct(F.array(F.col("_low"), F.least(F.col("_low") + 1, F.col("_n") - 1)))
    wanted = wanted.withColumn("_rank", F.explode(ranks)).withColumns({"_prefix": F.lit(0).cast("long"), "_need": F.col("_rank")})
    wanted = materialise(wanted.drop("_n"), "ranks")
    for shift in (48, 32, 16, 0):
        digits = values.select(
            "_g",
            (F.shiftrightunsigned("_u", shift + 16) if shift < 48 else F.lit(0).cast("long")).alias("_prefix"),
            F.shiftrightunsigned("_u", shift).bitwiseAND(0xFFFF).alias("_digit"),
        )
        if shift < 48:
            digits = digits.join(wanted.select("_g", "_prefix").distinct(), ["_g", "_prefix"], "left_semi")
        counted = digits.groupBy("_g", "_prefix", "_digit").agg(F.count(F.lit(1)).alias("_c"))
        running = Window.partitionBy("_g", "_prefix").orderBy("_digit")
        counted = counted.withColumn("_before", F.sum("_c").over(running) - F.col("_c"))
        here = (F.col("_need") >= F.col("_before")) & (F.col("_need") < F.col("_before") + F.col("_c"))
        found = wanted.join(counted, ["_g", "_prefix"]).where(here)
        prefix = F.shiftleft("_prefix", 16).bitwiseOR(F.col("_digit"))
        found = found.withColumns({"_need": F.col("_need") - F.col("_before"), "_prefix": prefix})
        wanted = materialise(found.select(*wanted.columns), "ranks")
    number = F.coalesce(_from_bits("_prefix"), F.lit(float("nan")))  # a NaN comes back as NULL
    picked = wanted.withColumn("_v", number).groupBy("_g", "prob", "_at", "_low").agg(
        F.min_by("_v", "_rank").alias("_a"), F.max_by("_v", "_rank").alias("_b")
    )
    share = F.col("_at") - F.col("_low")
    names = [F.col("_g")[c].alias(c) for c in by]
    return picked.select(*names, "prob", (F.col("_a") + share * (F.col("_b") - F.col("_a"))).alias("quantile"))


#: Size of a sketch: ranks are off by about 2.3 / k^0.9 of n, 0.45 % here, with 99 % confidence.
SKETCH_K, SKETCH_ERROR = 1024, 0.01


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, n, sketch``: a KLL sketch of each group's values, to be stored and merged later. NULLs are left out."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: Sequence[str] = (), probs: Sequence[float] = QUANTILES) -> DataFrame:
    """``by, n, prob, quantile`` of unions of stored groups, from their sketches alone: the values are not read again.

    A quantile is one of the values; its rank is that asked for, up to ``SKETCH_ERROR`` times n. Probabilities 0 and 1 give
    the smallest and the largest value. Groups without values give no rows.
    """
    merged = sketches.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("_sketch"))
    merged = merged.where("n > 0")  # without groups there is one row, of nothing
    asked = F.array(*[F.lit(float(p)) for p in probs])
    found = F.arrays_zip(asked.alias("prob"), F.kll_sketch_get_quantile_double("_sketch", asked).alias("quantile"))
    return merged.select(*by, "n", F.inline(found))
