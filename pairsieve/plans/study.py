"""The section study: features → redundancy of the gold model (or its stored result) → ablation → report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import ablation, pair_accuracy, section_scores, subset_accuracy
from ..operators.pairs import attach_labels, flag_membership, keep_section, label_coverage
from ..operators.scoring import ScorerRegistry, score_pairs
from ..redundancy.search import find_redundancy
from ..sources.features import reuse_or_compute
from ..sources.redundant_sets import RedundantSetMissing, lookup_redundant_set, save_redundant_set


@dataclass(frozen=True)
class StudySettings:
    gold: str
    solver: str = "nnls"
    threshold: float = 0.95
    components: int | None = None
    seed: int = 42
    force: bool = False
    skip_cache: bool = False


def model_features(
    examples: DataFrame, sections: DataFrame, registry: ScorerRegistry, root: str, model: str, section: str, settings: StudySettings
) -> DataFrame:
    """Scores and features of one model on one section, stored ones reused. The section filter comes first."""
    wanted = keep_section(examples, sections, section)
    return reuse_or_compute(
        examples.sparkSession,
        root,
        model,
        section or "full",
        lambda: score_pairs(wanted, registry.get(model)),
        settings.force,
        settings.skip_cache,
    )


def evaluate(scored: DataFrame, weights: DataFrame) -> dict[str, DataFrame]:
    """The evaluation-only study: overall, per-subset and per-section accuracy."""
    per_subset = subset_accuracy(scored)
    return {
        "overall": pair_accuracy(scored),
        "subsets": per_subset,
        "sections": section_scores(per_subset, weights),
        "coverage": label_coverage(scored),
    }


def relabel(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored scores without labels get the labels of the data set again."""
    return attach_labels(scored.drop("subset"), labels)


def redundant_set(
    spark: SparkSession, features: DataFrame, root: str, model: str, section: str, settings: StudySettings
) -> DataFrame:
    """The gold model's set is computed and stored; every other model looks the stored one up."""
    name = section or "full"
    if model == settings.gold:
        results = find_redundancy(
            features, solver=settings.solver, threshold=settings.threshold, components=settings.components
        )
        save_redundant_set(results, root, model, name, settings.solver, settings.threshold)
    return lookup_redundant_set(spark, root, settings.gold, name, settings.solver, settings.threshold)


def section_study(
    examples: DataFrame,
    sections: DataFrame,
    registry: ScorerRegistry,
    models: Sequence[str],
    section: str,
    roots: Mapping[str, str],
    settings: StudySettings,
) -> DataFrame:
    """One ablation report row per model. ``roots`` names the ``features`` and ``redundant`` stores.

    All models are scored into the feature store, the gold one first finds the redundant set; one plan then
    reports on all of them.
    """
    spark = examples.sparkSession
    ordered = sorted(models, key=lambda m: m != settings.gold)
    members = None
    scored = None
    for model in ordered:
        features = model_features(examples, sections, registry, roots["features"], model, section, settings)
        if members is None:
            found = redundant_set(spark, features, roots["redundant"], model, section, settings)
            members = found.where("is_redundant").select("example_num")
        part = features.select(
            F.lit(model).alias("model"), "example_num", "subset", "score_chosen", "score_rejected"
        )
        scored = part if scored is None else scored.unionByName(part)
    flagged = flag_membership(scored, members)
    return ablation(flagged, ["model"], seed=settings.seed)


__all__ = [
    "RedundantSetMissing",
    "StudySettings",
    "evaluate",
    "model_features",
    "redundant_set",
    "relabel",
    "section_study",
]
