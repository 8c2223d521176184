"""Expressions on scores: cleaning, parsing, mixtures of binned reward distributions, pair comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import _col, total

MAX_DOUBLE = 1.7976931348623157e308


def clean_score(c: Column | str, nan: float = 0.0) -> Column:
    """NaN becomes ``nan``; infinities become the largest finite doubles. NULL stays NULL."""
    c = _col(c).cast("double")
    return (
        F.when(F.isnan(c), F.lit(nan))
        .when(c == F.lit(float("inf")), F.lit(MAX_DOUBLE))
        .when(c == F.lit(float("-inf")), F.lit(-MAX_DOUBLE))
        .otherwise(c)
    )


def parse_score(raw: Column | str) -> Column:
    """Score out of a scorer's raw text: a JSON record with ``score``, a plain number, else 0."""
    raw = _col(raw)
    return F.coalesce(
        F.get_json_object(raw, "$.score").try_cast("double"), raw.try_cast("double"), F.lit(0.0)
    )


def wins(chosen: Column | str, rejected: Column | str, tie_policy: str = "gt") -> Column:
    """Whether the chosen score wins. ``gt``: a tie is wrong. ``ge``: a tie is right.

    Spark orders NaN above every number, so NaN on either side is excluded first.
    """
    chosen, rejected = _col(chosen), _col(rejected)
    if tie_policy not in ("gt", "ge"):
        raise ValueError(f"tie_policy must be 'gt' or 'ge', not {tie_policy!r}")
    better = chosen > rejected if tie_policy == "gt" else chosen >= rejected
    comparable = ~F.isnan(chosen) & ~F.isnan(rejected)
    return F.coalesce(comparable & better, F.lit(False))


def softmax(logits: Column | str, temperature: float = 1.0) -> Column:
    logits = _col(logits)
    shifted = F.transform(
        F.array(F.array_max(logits)),
        lambda top: F.transform(logits, lambda x: F.exp((x - top) / F.lit(float(temperature)))),
    ).getItem(0)
    return F.transform(
        F.array(shifted), lambda e: F.transform(e, lambda x: x / total(e))
    ).getItem(0)


def mixture(weights: Column | str, rewards: Column | str) -> Column:
    """Σ_o w_o · p_o: one distribution over the bins out of one per objective."""
    pairs = F.zip_with(
        _col(weights), _col(rewards), lambda w, p: F.transform(p, lambda x: x * w)
    )
    first = F.get(pairs, F.lit(0))
    return F.aggregate(
        F.slice(pairs, F.lit(2), F.greatest(F.size(pairs) - 1, F.lit(0))),
        first,
        lambda acc, p: F.zip_with(acc, p, lambda x, y: x + y),
    )


def expected_reward(distribution: Column | str) -> Column:
    """Σ_k p_k · k/(K−1): bins are spread evenly over [0, 1]."""
    p = _col(distribution)
    return total(F.transform(p, lambda x, k: x * k / (F.size(p) - 1)))


def pair_loss(preferred: Column | str, dispreferred: Column | str) -> Column:
    """−log σ(p − d), in the form that does not overflow."""
    z = _col(preferred) - _col(dispreferred)
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
