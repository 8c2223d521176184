"""Batch scoring of both sides of a pair with a pluggable scorer, and evaluation of scored parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import clean_score
from ..functions.vectors import as_double, difference, weighted_sum
from .metrics import pair_accuracy

# A scorer takes the texts (or any inputs) of a batch and returns one score and one feature vector for each.
BatchScorer = Callable[[pd.Series], tuple[Sequence[float], Sequence[Sequence[float]]]]


@dataclass(frozen=True)
class LinearScorer:
    """Score = w · features. A column expression: no Python runs in the tasks."""

    weights: tuple[float, ...]

    def score(self, features: str):
        return weighted_sum(features, self.weights)


@dataclass(frozen=True)
class PythonScorer:
    """A scorer that needs Python; ``build`` runs once per task and returns the batch function.

    With ``budget`` the function is called with inputs of similar length, so many that their number times the length of the
    longest (``length``, by default characters) stays within it; a longer input goes alone. Scores come back in the rows' order.
    """

    build: Callable[[], BatchScorer]
    budget: int | None = None
    length: Callable[[object], int] = len


Scorer = LinearScorer | PythonScorer


class ScorerRegistry:
    """Scorers by model id with a default entry."""

    def __init__(self, scorers: Mapping[str, Scorer], default: Scorer | None = None):
        self._scorers = dict(scorers)
        self._default = default

    def get(self, model: str) -> Scorer:
        found = self._scorers.get(model, self._default)
        if found is None:
            raise KeyError(f"no scorer for {model!r} and no default")
        return found


def length_batches(lengths: Sequence[int], budget: int) -> list[np.ndarray]:
    """Positions of the inputs, shortest first, cut where number times longest would exceed ``budget``."""
    order = np.argsort(np.asarray(lengths), kind="stable")
    cuts, start = [], 0
    for i, at in enumerate(order):
        if i > start and (i - start + 1) * lengths[at] > budget:
            cuts.append(i)
            start = i
    return np.split(order, cuts) if len(order) else []


def _score_by_length(score: BatchScorer, inputs: pd.Series, scorer: PythonScorer) -> tuple[Sequence[float], Sequence[Sequence[float]]]:
    if scorer.budget is None:
        return score(inputs)
    lengths = [0 if x is None else scorer.length(x) for x in inputs]
    scores, features = np.empty(len(inputs)), [None] * len(inputs)
    for at in length_batches(lengths, scorer.budget):
        s, f = score(inputs.iloc[at].reset_index(drop=True))
        scores[at] = np.asarray(s, dtype=np.float64)
        for i, vector in zip(at, f):
            features[i] = vector
    return scores, features


def score_pairs(
    df: DataFrame,
    scorer: Scorer,
    inputs: tuple[str, str] = ("f_chosen", "f_rejected"),
    keep: Sequence[str] = ("example_num", "subset"),
) -> DataFrame:
    """Scores and feature vectors of both sides in one pass; NaN scores become 0.

    Apply filters to ``df`` before this: they are not pushed through a Python scorer.
    A Python scorer gets ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows at a time, or fewer by its ``budget``.
    """
    chosen, rejected = inputs
    if isinstance(scorer, LinearScorer):
        scored = df.select(
            *keep,
            scorer.score(chosen).alias("score_chosen"),
            scorer.score(rejected).alias("score_rejected"),
            as_double(chosen).alias("f_chosen"),
            as_double(rejected).alias("f_rejected"),
        )
    else:
        narrow = df.select(*keep, chosen, rejected)
        vector = T.ArrayType(T.DoubleType())
        schema = T.StructType(
            [narrow.schema[c] for c in keep]
            + [T.StructField("score_chosen", T.DoubleType()), T.StructField("score_rejected", T.DoubleType())]
            + [T.StructField("f_chosen", vector), T.StructField("f_rejected", vector)]
        )
        build, kept, names = scorer.build, list(keep), schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = None  # built for the first rows only: a task may have none
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                score = score or build()
                scores, features = [], []
                for column in (chosen, rejected):
                    s, f = _score_by_length(score, batch.column(batch.schema.get_field_index(column)).to_pandas(), scorer)
                    # Arrow, unlike pandas, tells NaN from NULL.
                    scores.append(pa.array(np.asarray(s, dtype=np.float64)))
                    features.append(_list_column(f))
                kept_columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays(kept_columns + scores + features, names=names)

        scored = narrow.mapInArrow(run, schema)
    return scored.withColumns(
        {
            "had_nan": F.isnan("score_chosen") | F.isnan("score_rejected"),
            "score_chosen": clean_score("score_chosen"),
            "score_rejected": clean_score("score_rejected"),
        }
    )


def _list_column(vectors: Sequence[Sequence[float]]) -> pa.Array:
    rows = [np.asarray(v, dtype=np.float64) for v in vectors]
    offsets = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows)))


def nan_report(scored: DataFrame) -> DataFrame:
    """How many pairs had a NaN score replaced."""
    return scored.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("had_nan").alias("n_nan"))


def evaluate_parts(scored: DataFrame, part: str = "part") -> DataFrame:
    """Accuracy of each named part, ties counted right."""
    return pair_accuracy(scored, [part], tie_policy="ge").drop("accuracy_pct")


def with_difference(scored: DataFrame) -> DataFrame:
    return scored.withColumn("f_diff", difference("f_chosen", "f_rejected"))
