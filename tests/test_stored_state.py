"""Training that continues, permuted orders, bitmaps, sketches, checked features and batches by length."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairsieve.catalog import inputs as I
from pairsieve.operators import membership as MB
from pairsieve.operators import metrics as M
from pairsieve.operators import sampling as SA
from pairsieve.operators import scoring as SC
from pairsieve.operators import trainer as TR
from pairsieve.session import scratch_path
from pairsieve.sources import features as FE


def pairs_of(spark, n=400, d=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 0.4
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "example_num bigint, f_diff array<double>")


def validation_of(df):
    zero = F.transform("f_diff", lambda x: x * 0.0)
    return df.select("example_num", F.col("f_diff").alias("f_chosen"), zero.alias("f_rejected"))


def test_step_is_the_gradient(spark):
    x, df = pairs_of(spark)
    w = np.linspace(-1, 1, 5)
    n, loss, gradient = TR.pairwise_step(df, w.tolist())
    z = x @ w
    assert n == 400
    assert loss == pytest.approx(np.log1p(np.exp(-z)).sum())
    assert gradient == pytest.approx(-(x / (1 + np.exp(z))[:, None]).sum(0))


def test_resuming_equals_an_unbroken_run(spark):
    _, df = pairs_of(spark)
    root, other = scratch_path(spark, "train"), scratch_path(spark, "train")
    whole = TR.train_epochs(df, validation_of(df), root, 3, steps=3).orderBy("epoch").collect()
    assert [r.steps for r in whole] == [3, 6, 9]
    assert whole[0].train_loss > whole[1].train_loss > whole[2].train_loss
    # A run that is lost behind its first epoch: only that state is there.
    spark.read.parquet(f"{root}/epoch-00000").write.parquet(f"{other}/epoch-00000")
    again = TR.train_epochs(df, validation_of(df), other, 3, steps=3).orderBy("epoch").collect()
    for a, b in zip(whole, again):
        assert (a.epoch, a.steps, a.accuracy) == (b.epoch, b.steps, b.accuracy)
        assert a.weights == pytest.approx(b.weights, rel=1e-9) and a.train_loss == pytest.approx(b.train_loss, rel=1e-9)
    with pytest.raises(ValueError, match="other rows or with other settings"):
        TR.train_epochs(df.where("example_num > 0"), validation_of(df), root, 3, steps=3)
    best = TR.best_epoch(spark.createDataFrame(whole))
    assert best.accuracy == max(r.accuracy for r in whole)


def test_step_limit_counts_over_epochs(spark):
    _, df = pairs_of(spark, 60)
    got = TR.train_epochs(df, validation_of(df), scratch_path(spark, "train"), 4, steps=3, max_steps=4).orderBy("epoch").collect()
    assert [r.steps for r in got] == [3, 4]
    with pytest.raises(ValueError, match="nothing to train on"):
        TR.train_epochs(df.limit(0), validation_of(df), scratch_path(spark, "train"), 1)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 16, 17, 99, 1000, 65_537])
def test_permutation_is_a_bijection(n):
    orders = [SA.permute(np.arange(n), n, seed) for seed in ("42|0", "42|1")]
    for order in orders:
        assert sorted(order.tolist()) == list(range(n))
    if n > 50:
        assert (orders[0] == orders[1]).mean() < 0.2 and (orders[0] == np.arange(n)).mean() < 0.2
    with pytest.raises(ValueError):
        SA.permute(np.asarray([n]), n, 1)


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_permuted_rows_lie_in_order(spark, partitions):
    df = spark.range(100).select(F.col("id").alias("position"))
    shuffled = SA.permuted(df, 100, 2, partitions)
    plan = shuffled._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    got = [r.place for r in shuffled.collect()]
    assert got == list(range(100)) and shuffled.rdd.getNumPartitions() == partitions
    assert {r.position: r.place for r in shuffled.collect()} == dict(enumerate(SA.permute(np.arange(100), 100, "42|2").tolist()))


def test_bitmaps_flag_what_a_join_flags(spark, monkeypatch):
    keys = [0, 1, 5, -1, -40_000, 32_768, 32_769, 2**40, 5, None, -(2**62)]
    members = spark.createDataFrame([(k,) for k in keys], "example_num bigint")
    asked = [*keys, 2, -2, 32_767, 2**40 + 1, 40_000, -(2**62) + 1]
    df = spark.createDataFrame([(k, "x") for k in asked], "example_num bigint, extra string")
    want = sorted(((k, "x", k is not None and k in keys) for k in asked), key=repr)
    bitmaps = MB.build_bitmaps(members)
    flagged = MB.flag_by_bitmaps(df, bitmaps)
    assert sorted((tuple(r) for r in flagged.collect()), key=repr) == want
    assert "hashpartitioning" not in flagged._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(MB, "BROADCAST_BUCKETS", 1)
    assert sorted((tuple(r) for r in MB.flag_by_bitmaps(df, bitmaps).collect()), key=repr) == want
    assert MB.flag_by_bitmaps(df, MB.build_bitmaps(members.limit(0))).where("is_member").count() == 0


def test_bitmaps_of_many_keys(spark):
    bitmaps = MB.build_bitmaps(spark.range(0, 6_000_000, 3).withColumnRenamed("id", "example_num"))
    df = spark.range(0, 6_000_000, 7).withColumnRenamed("id", "example_num")
    assert MB.flag_by_bitmaps(df, bitmaps).where("is_member").count() == len(range(0, 6_000_000, 21))


def test_merged_sketches_stay_within_their_error(spark):
    df = spark.range(200_000).select((F.col("id") % 5).alias("part"), ((F.col("id") * 7919) % 200_000).cast("double").alias("x"))
    merged = M.merged_quantiles(M.quantile_sketches(df, "x", ["part"]), probs=(0.0, 0.1, 0.5, 0.9, 1.0))
    got = {r.prob: (r.n, r.quantile) for r in merged.collect()}
    assert got[0.0] == (200_000, 0.0) and got[1.0] == (200_000, 199_999.0)
    for p in (0.1, 0.5, 0.9):
        assert abs(got[p][1] / 200_000 - p) <= M.SKETCH_ERROR
    empty = M.quantile_sketches(df.limit(0), "x", ["part"])
    assert M.merged_quantiles(empty).count() == 0


def test_features_of_other_inputs_are_computed_again(spark, small):
    root, calls = scratch_path(spark, "f"), []
    feats = I.feats(spark, small)

    def reuse(rows, scorer):
        def compute():
            calls.append(1)
            return SC.score_pairs(rows, I.FIRST_SCORER if scorer == "first" else I.SECOND_SCORER)

        return FE.reuse_or_compute(spark, root, "m", "all", compute, inputs=FE.inputs_id(rows, scorer))

    reuse(feats, "first")
    assert "inputs" not in reuse(feats.orderBy(F.rand(3)), "first").columns
    assert len(calls) == 1  # the order of the rows does not matter
    changed = feats.withColumn("f_chosen", F.when(F.col("example_num") == 7, F.col("f_rejected")).otherwise(F.col("f_chosen")))
    got = {r.example_num: r.score_chosen - r.score_rejected for r in reuse(changed, "first").collect()}
    assert len(calls) == 2 and got[7] == 0.0
    reuse(changed, "second")
    assert len(calls) == 3
    FE.save_features(SC.score_pairs(feats, I.FIRST_SCORER), root, "m", "all")  # says nothing of its inputs
    reuse(feats, "first")
    assert len(calls) == 4 and FE.usable_features(spark, root, "m", "all") is not None


def test_batches_by_length(spark):
    lengths = [5, 1, 100_000, 3, 3, 0, 9]
    batches = SC.length_batches(lengths, 12)
    assert sorted(int(i) for b in batches for i in b) == list(range(7))
    assert all(len(b) == 1 or len(b) * max(lengths[i] for i in b) <= 12 for b in batches)
    assert [len(b) for b in batches][-1] == 1 and SC.length_batches([], 5) == []

    def build():
        def score(texts: pd.Series):
            assert len(texts) == 1 or len(texts) * max(map(len, texts)) <= 50
            return [float(len(t)) for t in texts], [[float(len(t)), float(t.count("a"))] for t in texts]

        return score

    def loose():
        return lambda texts: ([float(len(t)) for t in texts], [[float(len(t)), float(t.count("a"))] for t in texts])

    rows = [(i, "s", "a" * (i * 7 % 23), "ba" * (100_000 if i == 4 else i)) for i in range(30)]
    df = spark.createDataFrame(rows, "example_num bigint, subset string, c string, r string")
    got = SC.score_pairs(df, SC.PythonScorer(build, budget=50), ("c", "r")).orderBy("example_num").collect()
    assert got == SC.score_pairs(df, SC.PythonScorer(loose), ("c", "r")).orderBy("example_num").collect()
