"""Fitting a scorer on correction data and reporting on named parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.metrics import best_model, part_shares
from ..operators.pairs import non_redundant_part, redundant_part
from ..operators.sampling import sample_exact, split_train_validation
from ..operators.scoring import LinearScorer, evaluate_parts
from ..operators.trainer import score_difference, training_curve
from pyspark.sql import functions as F


def train(pairs: DataFrame, validation_share: float = 0.1, epochs: Sequence[int] = (1, 3, 10, 30), seed: int = 42) -> tuple[DataFrame, LinearScorer]:
    """Split, fit with growing iteration budgets, keep the best on validation (the later one on a tie)."""
    parts = split_train_validation(pairs, validation_share, seed=seed)
    curve, scorers = training_curve(parts.where("part = 'train'"), parts.where("part = 'validation'"), epochs)
    best = best_model(curve).first()
    return curve, scorers[best["epoch"]]


def introspect(pairs: DataFrame, redundant: DataFrame, scorer: LinearScorer, seed: int = 42) -> dict[str, DataFrame]:
    """A stored scorer on the redundant, the non-redundant and an equally large random part.

    ``shares`` has each part's share and the size-weighted overall accuracy; ``pairs`` has every pair with its part, scores,
    vectors and whatever else ``pairs`` holds.
    """
    scored = score_difference(pairs, scorer)
    inside = redundant_part(scored, redundant).withColumn("part", F.lit("redundant"))
    outside = non_redundant_part(scored, redundant).withColumn("part", F.lit("non_redundant"))
    random = sample_exact(scored, outside.count(), seed=seed).withColumn("part", F.lit("random"))
    return {
        "parts": evaluate_parts(inside.unionByName(outside).unionByName(random)),
        "shares": part_shares(inside.unionByName(outside), "part"),
        "pairs": inside.unionByName(outside),
    }
