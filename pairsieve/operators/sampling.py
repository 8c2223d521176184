"""Seeded shuffles, exact-size samples and splits.

The order is that of md5(seed|key), so it is reproducible on any cluster. An exact-size sample needs the
k-th smallest digest. Counting digests by their first 16 bits finds the one bucket that holds it, and only
that bucket (n/65,536 rows) is ranked: no global sort, no single-task limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest_prefix, seeded_digest
from .joins import join_per_group

BUCKET_HEX_DIGITS = 4


def _prefixed(df: DataFrame, key: Sequence[str], seed: int | str) -> DataFrame:
    digest = seeded_digest(seed, *key)
    return df.withColumn("_digest", digest).withColumn(
        "_bucket", digest_prefix(F.col("_digest"), BUCKET_HEX_DIGITS)
    )


def mark_sample(
    df: DataFrame,
    size: Column,
    key: Sequence[str] = ("example_num",),
    by: Sequence[str] = (),
    seed: int | str = 42,
    totals: dict[str, Column] | None = None,
    name: str = "is_sampled",
) -> DataFrame:
    """Flag a random sample without replacement of exactly ``size`` rows (per group ``by``).

    ``size`` is an expression over ``n`` (rows of the group) and over ``totals``, extra aggregates of the
    group. The key must identify a row within its group.
    """
    by = list(by)
    prefixed = _prefixed(df, [*by, *key], seed)
    totals = totals or {}
    counted = prefixed.groupBy(*by, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), *[expr.alias(t) for t, expr in totals.items()]
    )
    # One row per (group, 16-bit bucket): at most 65,536 per group from here on.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    running = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = counted.withColumns(
        {
            "_upto": F.sum("_n").over(running),
            "n": F.sum("_n").over(group),
            **{t: F.sum(t).over(group) for t in totals},
        }
    ).withColumn("_size", size.cast("bigint"))
    boundary = sized.where(
        (F.col("_upto") >= F.col("_size")) & (F.col("_upto") - F.col("_n") < F.col("_size"))
    ).select(*by, "_bucket", (F.col("_size") - F.col("_upto") + F.col("_n")).alias("_take"))

    within = Window.partitionBy(*by, "_bucket").orderBy("_digest", *key)
    cut = (
        prefixed.select(*by, *key, "_bucket", "_digest")
        .join(boundary, [*by, "_bucket"])
        .withColumn("_rank", F.row_number().over(within))
        .where(F.col("_rank") == F.col("_take"))
        .select(*by, F.struct("_digest", *key).alias("_cut"))
    )
    own = F.struct("_digest", *key)
    if by:
        joined = join_per_group(prefixed, cut, by)
    else:
        # One cut row in all: an equi-join on a constant, broadcast by its size.
        joined = prefixed.withColumn("_one", F.lit(0)).join(
            F.broadcast(cut.withColumn("_one", F.lit(0))), "_one", "left"
        ).drop("_one")
    return joined.withColumn(name, F.coalesce(own <= F.col("_cut"), F.lit(False))).drop(
        "_digest", "_bucket", "_cut"
    )


def sample_exact(
    df: DataFrame, k: int, key: Sequence[str] = ("example_num",), seed: int | str = 42
) -> DataFrame:
    """Exactly ``min(k, n)`` random rows without replacement."""
    marked = mark_sample(df, F.least(F.lit(k), F.col("n")), key, seed=seed, name="_sampled")
    return marked.where("_sampled").drop("_sampled")


def split_train_validation(
    df: DataFrame, fraction: float, key: Sequence[str] = ("example_num",), seed: int | str = 42
) -> DataFrame:
    """Add ``part``: 'validation' for exactly ceil(n·fraction) random rows, 'train' for the rest."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("the validation fraction must lie strictly between 0 and 1")
    marked = mark_sample(df, F.ceil(F.col("n") * F.lit(float(fraction))), key, seed=seed, name="_held")
    return marked.withColumn("part", F.when(F.col("_held"), F.lit("validation")).otherwise(F.lit("train"))).drop(
        "_held"
    )


def shuffled(df: DataFrame, epoch: int, key: Sequence[str] = ("example_num",), seed: int | str = 42) -> DataFrame:
    """Rows in a random order that differs by epoch (a range-partitioned sort)."""
    return df.orderBy(seeded_digest(f"{seed}|{epoch}", *key), *key)


#: Rounds of the permutation, and the prime below 2^31 in whose arithmetic they mix.
ROUNDS, PRIME = 6, 2_147_483_647


def round_keys(seed: int | str) -> list[tuple[int, int]]:
    """Two numbers below the prime for each round, from md5(seed|round)."""
    digests = [hashlib.md5(f"{seed}|{i}".encode()).hexdigest() for i in range(ROUNDS)]
    return [(int(d[:8], 16) % (PRIME - 1) + 1, int(d[8:16], 16) % PRIME) for d in digests]


def permute(positions: np.ndarray, n: int, seed: int | str) -> np.ndarray:
    """Each position of 0 … n−1 at its new one: a Feistel network over pairs (l, r), l below a = ⌈√n⌉ and r below ⌈n/a⌉.

    The pairs are up to a−1 more than n; a value beyond n−1 goes through the network again until it is below (cycle
    walking), which keeps the whole a bijection of 0 … n−1.
    """
    if len(positions) and (positions.min() < 0 or positions.max() >= n):
        raise ValueError(f"positions must lie in 0 … {n - 1}")
    a = isqrt(max(n - 1, 0)) + 1
    b = -(-n // a)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x // b, x % b
        for i, (times, plus) in enumerate(round_keys(seed)):
            mixed = ((right if i % 2 == 0 else left) * times + plus) % PRIME
            mixed = (mixed * mixed + plus) % PRIME * times % PRIME
            if i % 2 == 0:
                left = (left + mixed) % a
            else:
                right = (right + mixed) % b
        return left * b + right

    out = network(positions.astype(np.int64))
    while (beyond := np.flatnonzero(out >= n)).size:
        out[beyond] = network(out[beyond])
    return out


def permuted(
    df: DataFrame, n: int, epoch: int, partitions: int, position: str = "position", seed: int | str = 42, name: str = "place"
) -> DataFrame:
    """Rows at positions 0 … n−1 in a random order that differs by epoch, with ``name``, the place in that order.

    The place is computed from the position alone, so nothing is sampled and no ranges are found: partition i gets the places
    of the i-th of ``partitions`` equal parts, in one exchange, and sorts them. A position that is NULL or beyond n is an error.
    """

    @F.pandas_udf("long")
    def place(positions: pd.Series) -> pd.Series:
        if positions.isna().any():
            raise ValueError("a position is NULL")
        return pd.Series(permute(positions.to_numpy(np.int64), n, f"{seed}|{epoch}"))

    width = max(1, -(-n // partitions))
    placed = df.withColumn(name, place(F.col(position).cast("long")))
    return placed.repartitionById(partitions, F.floor(F.col(name) / width).cast("int")).sortWithinPartitions(name)


def random_exclusion_size() -> Column:
    """int(n · (r/n)) in doubles, which is sometimes r − 1."""
    n, r = F.col("n").cast("double"), F.col("n_redundant").cast("double")
    return F.floor(n * (r / n))
