"""Joins of a large table with one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Rows that are broadcast at most; beyond this both sides are salted.
BROADCAST_ROWS = 10_000
SALTS = 32


def join_per_group(rows: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row per value of ``by``.

    The groups are counted first. Few are broadcast; many are repeated under every salt, so that no group, however many
    rows it has, meets in one task. Either way the result is the same.
    """
    held = materialise(groups, "groups")
    if held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(held), list(by), how)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    repeated = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(repeated, [*by, "_salt"], how).drop("_salt")
