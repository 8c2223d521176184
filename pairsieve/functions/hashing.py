"""Seeded pseudo-random values that depend only on the row's key, so every run and engine agrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed: int | str, *keys: Column | str) -> Column:
    """md5 hex of ``seed|key|key…``."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def digest_prefix(digest: Column, hex_digits: int) -> Column:
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")


def seeded_uniform(seed: int | str, *keys: Column | str) -> Column:
    """A value in [0, 1) from the first 32 bits of the digest."""
    return digest_prefix(seeded_digest(seed, *keys), 8) / F.lit(4294967296.0)


def checksum(*columns: str) -> Column:
    """An aggregate that says whether two tables have the same rows: their number and two sums of 64-bit hashes, as text.

    The order of the rows does not matter; repeated rows and NULLs do.
    """
    values = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]

    def total(seed: int) -> Column:
        return F.coalesce(F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(28,0)")), F.lit(0)).cast("string")

    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), total(1), total(2))
