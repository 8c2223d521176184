import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsieve.functions import scores as S
from pairsieve.functions import tokens as TK
from pairsieve.functions import vectors as V
from pairsieve.operators import metrics as M
from pairsieve.operators import pairs as P
from pairsieve.operators import sampling as SA
from pairsieve.operators import scoring as SC
from pairsieve.operators.pooling import pool_tokens


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---- comparison rules ----


def scored(spark, rows):
    return spark.createDataFrame(
        [(i, "s", float(c), float(r)) for i, (c, r) in enumerate(rows)],
        "example_num bigint, subset string, score_chosen double, score_rejected double",
    )


def test_ties_and_nan(spark):
    nan = float("nan")
    df = scored(spark, [(0.5, 0.5), (1, 0), (0, 1), (nan, 0.1), (0.1, nan), (nan, nan)])
    assert M.pair_accuracy(df).first().n_correct == 1
    assert M.pair_accuracy(df, tie_policy="ge").first().n_correct == 2
    cleaned = df.withColumns({c: S.clean_score(c) for c in ("score_chosen", "score_rejected")})
    assert M.pair_accuracy(cleaned).first().n_correct == 2  # 0.1 > 0.0 as well
    with pytest.raises(ValueError):
        S.wins("a", "b", "le")


def test_clean_score(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (1.5,)], "x double")
    got = [r[0] for r in df.select(S.clean_score("x")).collect()]
    assert got == [S.MAX_DOUBLE, -S.MAX_DOUBLE, 0.0, None, 1.5]


def test_accuracy_of_nothing_is_null(spark):
    empty = M.pair_accuracy(scored(spark, [])).first()
    assert empty.n_pairs == 0 and empty.accuracy is None and empty.n_correct == 0


def test_parse_score(spark):
    df = spark.createDataFrame([('{"label":"LABEL_1","score":0.68}',), ("0.25",), ("1e-3",), ("nothing",), (None,), ('{"label":"x"}',)], "raw string")
    assert [r[0] for r in df.select(S.parse_score("raw")).collect()] == [0.68, 0.25, 0.001, 0.0, 0.0, 0.0]


def test_pair_loss_does_not_overflow(spark):
    df = spark.createDataFrame([(0.0, 0.0), (900.0, -900.0), (-900.0, 900.0), (1.0, 0.5)], "p double, d double")
    got = [r[0] for r in df.select(S.pair_loss("p", "d")).collect()]
    assert got[0] == pytest.approx(math.log(2)) and got[1] == 0.0 and got[2] == 1800.0
    assert got[3] == pytest.approx(-math.log(1 / (1 + math.exp(-0.5))))


def test_mixture_of_distributions(spark):
    df = spark.sql("select array(0.25D, 0.75D) w, array(array(1D,0D,0D), array(0D,0D,1D)) r, array(1D, 3D) g")
    row = df.select(
        S.mixture("w", "r").alias("m"), S.expected_reward(S.mixture("w", "r")).alias("e"), S.softmax("g", 2.0).alias("s")
    ).first()
    assert row.m == [0.25, 0.0, 0.75] and row.e == 0.75
    assert np.allclose(row.s, np.exp([0.5, 1.5]) / np.exp([0.5, 1.5]).sum())


# ---- vectors ----


def test_vector_expressions(spark):
    df = spark.sql("select array(3f, 0f, -4f) a, array(1f, 1f, 1f) b")
    row = df.select(
        V.difference("a", "b").alias("diff"),
        V.l2_normalise(V.as_double("a")).alias("unit"),
        V.non_zero_positions("a").alias("at"),
        V.non_zero_values("a").alias("values"),
        V.truncate("a", 2).alias("cut"),
        V.weighted_sum("a", [1.0, 2.0, 0.5]).alias("dot"),
        V.is_zero("a").alias("zero"),
        V.is_constant("b").alias("constant"),
        V.centred_sum_squares(V.as_double("b")).alias("spread"),
    ).first()
    assert row["diff"] == [2.0, -1.0, -5.0] and np.allclose(row.unit, [0.6, 0, -0.8])
    assert row["at"] == [0, 2] and row["values"] == [3.0, -4.0] and row.cut == [3.0, 0.0]
    assert row["dot"] == 1.0 and not row.zero and row.constant and row.spread == 0.0


def test_pooling(spark):
    rows = [(1, i, [float(i), 10.0 * i], i > 1) for i in range(4)] + [(2, 0, [5.0, 6.0], False)]
    df = spark.createDataFrame(rows, "example_num bigint, pos int, vec array<double>, is_pad boolean")
    want = {"first": [0, 0], "last": [3, 30], "last_token": [1, 10], "mean": [1.5, 15]}
    for mode, v in want.items():
        got = {r.example_num: r.pooled for r in pool_tokens(df, mode).collect()}
        assert got == {1: v, 2: [5.0, 6.0]}
    with pytest.raises(ValueError):
        pool_tokens(df, "max")


# ---- tokens ----


@pytest.mark.parametrize("side,tokens,mask", [("right", ["a", "b"], [1, 1]), ("left", ["c", "d"], [1, 1])])
def test_fit_length_cuts(spark, side, tokens, mask):
    t = F.array(*[F.lit(x) for x in "abcd"])
    got = one(spark, *[c.alias(n) for c, n in zip(TK.fit_length(t, 2, F.lit("_"), side, "right"), ("t", "m"))])
    assert got.t == tokens and got.m == mask


def test_fit_length_pads_either_side(spark):
    t = F.array(F.lit("a"), F.lit("b"))
    left = TK.fit_length(t, 4, F.lit("_"), "left", "left")
    right = TK.fit_length(t, 4, F.lit("_"), "left", "right")
    got = one(spark, left[0].alias("a"), left[1].alias("b"), right[0].alias("c"), right[1].alias("d"))
    assert (got.a, got.b, got.c, got.d) == (["_", "_", "a", "b"], [0, 0, 1, 1], ["a", "b", "_", "_"], [1, 1, 0, 0])


def test_double_start_and_chunks(spark):
    df = spark.createDataFrame([(["s", "s", "x"],), (["s", "x", "s"],), (["s"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(TK.drop_double_start("t", F.lit("s"))).collect()]
    assert got == [["s", "x"], ["s", "x", "s"], ["s"], []]
    t = F.array(*[F.lit(i) for i in range(5)])
    chunks = one(spark, TK.overlapping_chunks(t, 2, F.lit(-1)).alias("c")).c
    assert chunks == [[0, 1, 2, 3], [2, 3, 4, -1], [4, -1, -1, -1]]
    assert one(spark, TK.overlapping_chunks(F.array().cast("array<int>"), 2, F.lit(-1)).alias("c")).c is None


# ---- pairs ----


def test_sections(spark):
    dims = P.section_table(spark)
    assert dims.count() == 23 and dims.select("section").distinct().count() == 4
    df = spark.createDataFrame([(1, "hep-go"), (2, "donotanswer"), (3, "unknown")], "example_num bigint, subset string")
    assert [r.example_num for r in P.keep_section(df, dims, "reasoning").collect()] == [1]
    assert P.keep_section(df, dims).count() == 3


def test_positions_follow_the_order(spark):
    rng = np.random.default_rng(0)
    values = [(int(a), int(b)) for a, b in zip(rng.integers(0, 5, 500), rng.permutation(500))]
    df = spark.createDataFrame(values, "a int, b int").repartition(7)
    got = {(r.a, r.b): r.example_num for r in P.assign_positions(df, ["a", "b"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_take_positions_repeats(spark):
    df = spark.createDataFrame([(i, chr(97 + i)) for i in range(4)], "example_num bigint, x string")
    index = spark.createDataFrame([(2, 0), (0, 1), (2, 2)], "example_num bigint, ord int")
    assert [r.x for r in P.take_positions(df, index).collect()] == ["c", "a", "c"]


def test_first_annotation_checks_the_count(spark):
    df = spark.createDataFrame([("s", ["a", "b", "c", "d"])], "sentence string, corrections array<string>")
    row = P.to_preference(df, "jhu-clsp/jfleg").first()
    assert row.preferred == "a" and row.dispreferred == "s"
    bad = spark.createDataFrame([("s", ["a"])], "sentence string, corrections array<string>")
    with pytest.raises(Exception, match="expected 4 corrections"):
        P.to_preference(bad, "jhu-clsp/jfleg").collect()
    with pytest.raises(ValueError, match="not supported"):
        P.to_preference(df, "another")


def test_noise_bounds(spark):
    df = spark.createDataFrame([(i, "p", "d") for i in range(50)], "example_num bigint, preferred string, dispreferred string")
    assert P.swap_with_noise(df, 0.0).where("is_swapped").count() == 0
    everything = P.swap_with_noise(df, 1.0)
    assert everything.where("is_swapped and preferred = 'd' and dispreferred = 'p'").count() == 50
    with pytest.raises(ValueError):
        P.swap_with_noise(df, 1.5)


def test_label_allocation(spark):
    labels = spark.createDataFrame([("a", 5, 0), ("b", 3, 1), ("c", 2, 2)], "subset string, example_count bigint, ord int")
    for n in (1, 7, 10, 23):
        df = spark.range(n).withColumnRenamed("id", "example_num")
        got = [r.subset for r in P.allocate_labels(df, labels).orderBy("example_num").collect()]
        want = []
        for name, count in (("a", 5), ("b", 3), ("c", 2)):
            want += [name] * int(count / 10 * n)
        want = (want + ["a"] * n)[:n]
        assert got == want


def test_label_coverage(spark):
    df = scored(spark, [(1, 0), (0, 1)]).drop("subset")
    full = spark.createDataFrame([(0, "x"), (1, "y")], "example_num bigint, subset string")
    assert P.label_coverage(P.attach_labels(df, full)).first().is_complete
    assert not P.label_coverage(P.attach_labels(df, full.limit(1))).first().is_complete


# ---- sampling ----


@pytest.mark.parametrize("n,k", [(0, 3), (10, 0), (10, 3), (10, 10), (10, 50), (3000, 777)])
def test_exact_sample_size(spark, n, k):
    df = spark.range(n).withColumnRenamed("id", "example_num")
    picked = [r.example_num for r in SA.sample_exact(df, k).collect()]
    assert len(picked) == min(n, k) == len(set(picked))
    assert sorted(picked) == sorted(r.example_num for r in SA.sample_exact(df.repartition(5), k).collect())


def test_split_fraction_must_be_inside(spark):
    df = spark.range(21).withColumnRenamed("id", "example_num")
    parts = {r.part: r["count"] for r in SA.split_train_validation(df, 0.1).groupBy("part").count().collect()}
    assert parts == {"validation": 3, "train": 18}
    for bad in (0.0, 1.0, -1):
        with pytest.raises(ValueError):
            SA.split_train_validation(df, bad)


def test_shuffles_differ_by_epoch(spark):
    df = spark.range(40).withColumnRenamed("id", "example_num")
    first, again, second = ([r[0] for r in SA.shuffled(df, e).collect()] for e in (0, 0, 1))
    assert first == again != second and sorted(first) == sorted(second) == list(range(40))


# ---- metrics ----


@pytest.mark.parametrize("n,r,removed", [(22, 15, 14), (10, 4, 4), (10, 0, 0), (5, 5, 5)])
def test_ablation_counts(spark, n, r, removed):
    df = scored(spark, [(i % 3, 1) for i in range(n)]).withColumn("is_redundant", F.col("example_num") < r)
    row = M.ablation(df).first()
    assert row.counts.asDict() == {"total": n, "redundant": r, "non_redundant": n - r, "random_excluded": removed}
    hits = [i % 3 > 1 for i in range(n)]
    assert row.accuracy_full == pytest.approx(100 * np.mean(hits))
    assert (row.accuracy_redundant is None) == (r == 0) and (row.accuracy_non_redundant is None) == (r == n)
    if 0 < r < n:
        assert row.accuracy_full * n == pytest.approx(row.accuracy_redundant * r + row.accuracy_non_redundant * (n - r))


def test_overall_accuracy_is_the_weighted_one(spark):
    df = scored(spark, [(i % 4, 1) for i in range(30)]).withColumn("part", F.when(F.col("example_num") < 7, "a").otherwise("b"))
    rows = M.part_shares(df, "part").collect()
    assert all(r.overall_accuracy == pytest.approx(M.pair_accuracy(df, tie_policy="ge").first().accuracy) for r in rows)
    assert sum(r.share_pct for r in rows) == pytest.approx(100)


def test_section_scores_weight_present_subsets_only(spark):
    per = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "subset string, accuracy double")
    weights = spark.createDataFrame([("s", "a", 10), ("s", "b", 30), ("s", "missing", 99)], "section string, subset string, example_count bigint")
    assert M.section_scores(per, weights).first().section_score == pytest.approx(0.625)


def test_best_model_takes_the_later_tie(spark):
    df = spark.createDataFrame([("m0", 0.7, 0), ("m1", 0.9, 1), ("m2", 0.9, 2), ("m3", 0.8, 3)], "model string, accuracy double, epoch int")
    assert M.best_model(df).first().model == "m2"


@pytest.mark.parametrize("kind", ["spread", "hot", "few"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=2001)
    if kind == "hot":
        x[rng.random(len(x)) < 0.4] = 0.25
    if kind == "few":
        x = x[:3]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = {r.prob: r.quantile for r in M.exact_quantiles(df, "x").collect()}
    assert len(got) == 19
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(x, p), abs=1e-12)
    rough = {r.prob: r.quantile for r in M.approximate_quantiles(df, "x").collect()}
    assert set(rough) == set(got)


def test_exact_quantiles_of_odd_values(spark):
    """Groups with NaN, infinities, zeros of both signs, tiny and repeated values, one value, and a NULL group."""
    nan, inf = float("nan"), float("inf")
    groups = {
        "odd": [nan, inf, -inf, 0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, 1.0, 1.0],
        "one": [3.5],
        None: [-2.0, -1.0, 7.0, 7.0],
        "hot": [0.1] * 500 + [0.1 + 2**-55, 0.2],
    }
    rows = [(g, v) for g, own in groups.items() for v in own] + [("none", None)]
    df = spark.createDataFrame(rows, "name string, x double").repartition(5)
    probs = (0.0, 1.0, 4 / 11, 5 / 11, 10 / 11)
    got = {(r["name"], r.prob): r.quantile for r in M.exact_quantiles(df, "x", ["name"], probs).collect()}
    assert {g for g, _ in got} == set(groups)
    for g, own in groups.items():
        for p in probs:
            at = p * (len(own) - 1)
            low = int(at)
            a, b = (np.sort(own)[min(i, len(own) - 1)] for i in (low, low + 1))
            assert got[g, p] == pytest.approx(a + (at - low) * (b - a), rel=1e-12, nan_ok=True), (g, p)
    assert M.exact_quantiles(df.where("false"), "x").count() == 0


# ---- scoring ----


def test_python_scorer_and_registry(spark):
    # Defined here so that it travels to the tasks by value.
    def length_scorer():
        def score(texts):
            return [float("nan") if t == "bad" else float(len(t)) for t in texts], [[float(len(t)), 1.0] for t in texts]

        return score

    df = spark.createDataFrame([(0, "s", "long text", "short"), (1, "s", "bad", "x")], "example_num bigint, subset string, a string, b string")
    registry = SC.ScorerRegistry({"m": SC.PythonScorer(length_scorer)})
    with pytest.raises(KeyError):
        registry.get("other")
    out = SC.score_pairs(df, registry.get("m"), ("a", "b"))
    rows = {r.example_num: r for r in out.collect()}
    assert rows[0].score_chosen == 9.0 and rows[1].score_chosen == 0.0 and rows[1].had_nan
    assert SC.nan_report(out).first().n_nan == 1
    assert SC.with_difference(out).where("example_num = 0").first().f_diff == [4.0, 0.0]


# ---- joins with one row per group ----


def test_many_groups_are_salted_with_the_same_result(spark, monkeypatch):
    from pairsieve.operators import joins as J

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"g{i}") for i in range(300)], "example_num bigint, part string")
    groups = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(map(tuple, J.join_per_group(rows, groups, ["part"]).collect()))
    marked = SA.mark_sample(rows, F.floor(F.col("n") / 4), by=["part"]).where("is_sampled")
    drawn = sorted(r.example_num for r in marked.collect())
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    salted = J.join_per_group(rows, groups, ["part"])
    assert sorted(map(tuple, salted.collect())) == want
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    marked = SA.mark_sample(rows, F.floor(F.col("n") / 4), by=["part"]).where("is_sampled")
    assert sorted(r.example_num for r in marked.collect()) == drawn


def test_labels_in_any_number(spark):
    n, m = 50, 500
    rows = spark.range(n).select(F.col("id").alias("example_num"), F.lit("lost").alias("subset"))
    labels = spark.range(m).select(F.concat(F.lit("s"), "id").alias("subset"), (F.col("id") % 7).alias("example_count"), F.col("id").alias("ord"))
    got = {r.example_num: r.subset for r in P.allocate_labels(rows, labels).collect()}
    whole, place, want = sum(i % 7 for i in range(m)), 0, {}
    for i in range(m):
        size = int((i % 7) / whole * n)
        want.update({place + j: f"s{i}" for j in range(size)})
        place += size
    assert got == {i: want.get(i, "s0") for i in range(n)}


def test_scratch_is_deleted(spark):
    import os

    from pairsieve.session import discard, materialise

    kept, gone = materialise(spark.range(3), "test"), materialise(spark.range(4), "test")
    assert gone.count() == 4
    discard(gone, None)
    assert not os.path.exists(gone._scratch_path) and os.path.exists(kept._scratch_path) and kept.count() == 3
