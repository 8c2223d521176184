"""A linear pairwise scorer fitted with the loss −log σ(w · (preferred − dispreferred))."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import checksum, digest_prefix, seeded_digest
from ..functions.scores import pair_loss
from ..functions.vectors import as_double, weighted_sum
from ..session import discard, materialise
from .metrics import mean_pair_loss, pair_accuracy
from .scoring import LinearScorer


def pairwise_examples(pairs: DataFrame, diff: str = "f_diff") -> DataFrame:
    """Each difference once with label 1 and once negated with label 0.

    Both rows of a pair come from one scan. Logistic regression without intercept on them has exactly the
    pairwise loss.
    """
    d = as_double(diff)
    sides = F.array(
        F.struct(F.lit(1.0).alias("label"), d.alias("v")),
        F.struct(F.lit(0.0).alias("label"), F.transform(d, lambda x: -x).alias("v")),
    )
    return pairs.select(F.inline(sides)).select("label", array_to_vector("v").alias("features"))


def fit_pairwise(pairs: DataFrame, diff: str = "f_diff", max_iter: int = 50, ridge: float = 0.0) -> LinearScorer:
    """Fit the scorer by distributed L-BFGS."""
    model = LogisticRegression(
        fitIntercept=False, standardization=False, maxIter=max_iter, regParam=ridge, tol=1e-9
    ).fit(pairwise_examples(pairs, diff))
    return LinearScorer(tuple(float(w) for w in model.coefficients))


def score_difference(pairs: DataFrame, scorer: LinearScorer, sides: tuple[str, str] = ("f_chosen", "f_rejected")) -> DataFrame:
    return pairs.withColumns(
        {"score_chosen": scorer.score(sides[0]), "score_rejected": scorer.score(sides[1])}
    )


def training_curve(train: DataFrame, validation: DataFrame, epochs: Sequence[int], ridge: float = 0.0) -> tuple[DataFrame, dict[int, LinearScorer]]:
    """Fit with each iteration budget; one metrics row per budget: training loss, validation accuracy."""
    train, validation = train.cache(), validation.cache()
    scorers: dict[int, LinearScorer] = {}
    rows = []
    try:
        for epoch in epochs:
            scorer = fit_pairwise(train, max_iter=epoch, ridge=ridge)
            scorers[epoch] = scorer
            loss = mean_pair_loss(score_difference(train, scorer)).first()["mean_loss"]
            accuracy = pair_accuracy(score_difference(validation, scorer), tie_policy="ge").first()["accuracy"]
            rows.append((f"epoch-{epoch}", epoch, float(loss), accuracy))
    finally:
        train.unpersist()
        validation.unpersist()
    curve = train.sparkSession.createDataFrame(rows, "model string, epoch int, train_loss double, accuracy double")
    return curve, scorers


# ---- epochs that continue ----

STATE = "epoch int, steps long, train_loss double, accuracy double, weights array<double>, settings string"
#: First-level sums of a gradient: no task merges more vectors than partitions / PARTIAL_SUMS.
PARTIAL_SUMS = 64


def pairwise_step(batch: DataFrame, weights: Sequence[float], diff: str = "f_diff") -> tuple[int, float, np.ndarray]:
    """Number of pairs, summed loss −log σ(w·d) and summed gradient −(1 − σ(w·d))·d: one scan, summed in two levels."""
    margin = weighted_sum(diff, weights)
    parts = batch.select(margin.alias("z"), as_double(diff).alias("d"), (F.spark_partition_id() % PARTIAL_SUMS).alias("part"))
    share = -1.0 / (1.0 + F.exp("z"))
    rows = parts.select("part", pair_loss("z", F.lit(0.0)).alias("loss"), array_to_vector(F.transform("d", lambda x: x * share)).alias("g"))
    first = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"), Summarizer.sum(F.col("g")).alias("g"))
    total = first.agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), Summarizer.sum(F.col("g")).alias("g")).first()
    return (total["n"], total["loss"], total["g"].toArray()) if total["n"] else (0, 0.0, np.zeros(len(weights)))


def train_epochs(
    train: DataFrame,
    validation: DataFrame,
    root: str,
    epochs: int,
    *,
    steps: int = 10,
    rate: float = 1.0,
    clip: float = 1.0,
    max_steps: int | None = None,
    key: Sequence[str] = ("example_num",),
    diff: str = "f_diff",
    seed: int = 42,
) -> DataFrame:
    """``epoch, steps, train_loss, accuracy, weights`` of every epoch; each goes on from the weights of the one before.

    An epoch deals its rows anew into ``steps`` batches by md5(seed|epoch|key) and takes a step after each: the mean gradient,
    cut to norm ``clip``, times ``rate``, which falls linearly to 0 over the epochs. ``train_loss`` is the mean over the
    batches, before their step; ``accuracy`` is that on ``validation`` after the epoch, ties right. ``max_steps`` counts steps over all epochs.

    Each epoch's state is written under ``root``; called again, training goes on behind the last epoch found there, and
    a state of other rows or settings is an error. An epoch's rows are written once, sorted by batch inside their
    partitions, so a step skips the row groups of other batches. Only a gradient per step reaches the driver. An empty training table is an error.
    """
    spark = train.sparkSession
    first = train.select(F.size(diff).alias("d")).first()
    if first is None:
        raise ValueError("there is nothing to train on")
    facts = train.agg(checksum(*key, diff).alias("c")).first()["c"]
    settings = f"{facts}|{epochs}|{steps}|{rate}|{clip}|{max_steps}|{seed}"
    weights, done, rows = np.zeros(first["d"]), 0, []
    for epoch in range(epochs):
        path = f"{root}/epoch-{epoch:05d}"
        state = _stored_state(spark, path)
        if state is not None and state["settings"] != settings:
            raise ValueError(f"{path} was trained on other rows or with other settings")
        if state is None:
            if max_steps is not None and done >= max_steps:
                break
            batch = digest_prefix(seeded_digest(f"{seed}|{epoch}", *key), 8) % steps
            dealt = materialise(train.select(diff, batch.alias("batch")).sortWithinPartitions("batch"), "epoch")
            losses = []
            for b in range(steps):
                if max_steps is not None and done >= max_steps:
                    break
                n, loss, gradient = pairwise_step(dealt.where(F.col("batch") == b), weights.tolist(), diff)
                if n == 0:
                    continue
                gradient = gradient / n
                norm = float(np.linalg.norm(gradient))
                weights = weights - rate * (1 - epoch / epochs) * min(1.0, clip / norm if norm else 1.0) * gradient
                losses.append(loss / n)
                done += 1
            discard(dealt)
            scored = score_difference(validation, LinearScorer(tuple(weights.tolist())))
            accuracy = pair_accuracy(scored, tie_policy="ge").first()["accuracy"]
            row = (epoch, done, float(np.mean(losses)), accuracy, weights.tolist(), settings)
            spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(path)
            state = _stored_state(spark, path)
        weights, done = np.asarray(state["weights"]), state["steps"]
        rows.append(tuple(state)[:-1])
    return spark.createDataFrame(rows, STATE.rsplit(",", 1)[0])


def _stored_state(spark: SparkSession, path: str) -> Row | None:
    try:
        return spark.read.schema(STATE).parquet(path).first()
    except AnalysisException:
        return None


def best_epoch(history: DataFrame) -> Row | None:
    """The epoch with the highest validation accuracy, weights included; the later one wins a tie."""
    return history.orderBy(F.desc("accuracy"), F.desc("epoch")).first()
