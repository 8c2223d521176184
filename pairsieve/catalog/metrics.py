"""Queries on accuracy, ablation, loss and quantiles."""

from pyspark.sql import functions as F

from ..functions.hashing import seeded_uniform
from ..operators import metrics as M
from . import inputs as I
from .pairs import REDUNDANT_SQL, r6
from .registry import query

HIT = "(score_chosen > score_rejected)::int"


@query(
    "pair_accuracy",
    f"""with {I.PAIRS_SQL}
    select count(*) as n_pairs, sum({HIT})::bigint as n_correct, round(avg({HIT}) * 100, 6) as accuracy_pct,
           round(avg({HIT}), 6) as accuracy from pairs""",
)
def pair_accuracy(spark, sf):
    a = M.pair_accuracy(I.pairs(spark, sf))
    return a.select("n_pairs", "n_correct", r6("accuracy_pct").alias("accuracy_pct"), r6("accuracy").alias("accuracy"))


@query(
    "correct_examples",
    f"with {I.PAIRS_SQL} select example_num from pairs where score_chosen > score_rejected",
)
def correct_examples(spark, sf):
    return M.correct_pairs(I.pairs(spark, sf)).select("example_num")


TIED_SQL = "tied as (select example_num, subset, round(score_chosen) as score_chosen, round(score_rejected) as score_rejected from pairs)"


def _tied(spark, sf):
    """Scores rounded to whole numbers, so that some pairs tie."""
    return I.pairs(spark, sf).withColumns({"score_chosen": F.round("score_chosen"), "score_rejected": F.round("score_rejected")})


@query(
    "tie_policies",
    f"""with {I.PAIRS_SQL}, {TIED_SQL}
    select subset, count(*) as n_pairs, sum((score_chosen > score_rejected)::int)::bigint as n_strict,
           sum((score_chosen >= score_rejected)::int)::bigint as n_with_ties from tied group by subset""",
)
def tie_policies(spark, sf):
    tied = _tied(spark, sf)
    strict = M.pair_accuracy(tied, ["subset"], "gt").select("subset", "n_pairs", F.col("n_correct").alias("n_strict"))
    lenient = M.pair_accuracy(tied, ["subset"], "ge").select("subset", F.col("n_correct").alias("n_with_ties"))
    return strict.join(lenient, "subset")


@query(
    "subset_accuracy",
    f"""with {I.PAIRS_SQL}
    select subset, count(*) as n_pairs, sum({HIT})::bigint as n_correct, round(avg({HIT}), 6) as accuracy
    from pairs group by subset""",
)
def subset_accuracy(spark, sf):
    return M.subset_accuracy(I.pairs(spark, sf)).withColumn("accuracy", r6("accuracy"))


@query(
    "section_scores",
    f"""with {I.MODELS_SQL}, {I.SECTIONS_SQL},
    a as (select model, subset, avg({HIT}) as accuracy from models group by model, subset)
    select model, section, round(sum(accuracy * example_count) / sum(example_count), 6) as section_score,
           count(*) as n_subsets from a join sections using (subset) group by model, section""",
)
def section_scores(spark, sf):
    per_subset = M.subset_accuracy(I.two_models(spark, sf), ["model"])
    scores = M.section_scores(per_subset, I.sections(spark), ["model"])
    return scores.withColumn("section_score", r6("section_score"))


ABLATION_TAIL = f"""
flagged as (select *, {REDUNDANT_SQL} as is_redundant from models),
ranked as (select *, row_number() over (partition by model order by md5('42|' || model || '|' || example_num), example_num) as rn,
                  count(*) over (partition by model) as n, sum(is_redundant::int) over (partition by model) as r from flagged),
drawn as (select *, rn <= floor(n::double * (r::double / n::double)) as is_excluded from ranked)
select model,
       round(avg({HIT} * 100.0), 6) as accuracy_full,
       round(avg({HIT} * 100.0) filter (where not is_redundant), 6) as accuracy_non_redundant,
       round(avg({HIT} * 100.0) filter (where is_redundant), 6) as accuracy_redundant,
       round(avg({HIT} * 100.0) filter (where not is_excluded), 6) as accuracy_random,
       count(*) as total, count(*) filter (where is_redundant) as redundant,
       count(*) filter (where not is_redundant) as non_redundant, count(*) filter (where is_excluded) as random_excluded
from drawn group by model"""


def flat_report(report, by):
    rounded = [r6(c).alias(c) for c in ("accuracy_full", "accuracy_non_redundant", "accuracy_redundant", "accuracy_random")]
    return report.select(*by, *rounded, "counts.*")


@query("ablation_report", f"with {I.MODELS_SQL}, {ABLATION_TAIL}")
def ablation_report(spark, sf):
    """One redundant set applied to the scores of both models."""
    scored = I.two_models(spark, sf).withColumn("is_redundant", seeded_uniform(7, "example_num") < 0.6)
    return flat_report(M.ablation(scored, ["model"]), ["model"])


@query(
    "part_shares",
    f"""with {I.MODELS_SQL},
    f as (select model, case when {REDUNDANT_SQL} then 'redundant' else 'non_redundant' end as part,
                 (score_chosen >= score_rejected)::int as hit from models),
    p as (select model, part, count(*) as n_pairs, sum(hit)::bigint as n_correct, avg(hit) as accuracy from f group by model, part)
    select model, part, n_pairs, n_correct, round(accuracy, 6) as accuracy,
           round(n_pairs / sum(n_pairs) over (partition by model) * 100, 6) as share_pct,
           round(sum(accuracy * n_pairs) over (partition by model) / sum(n_pairs) over (partition by model), 6) as overall_accuracy
    from p""",
)
def part_shares(spark, sf):
    part = F.when(seeded_uniform(7, "example_num") < 0.6, F.lit("redundant")).otherwise(F.lit("non_redundant"))
    shares = M.part_shares(I.two_models(spark, sf).withColumn("part", part), "part", ["model"])
    return shares.withColumns({c: r6(c) for c in ("accuracy", "share_pct", "overall_accuracy")})


@query(
    "distinct_difference_sums",
    f"""with {I.FEATS_SQL} select distinct round(list_sum(f_diff), 6) + 0.0 as diff_sum from feats""",
)
def distinct_difference_sums(spark, sf):
    return M.distinct_sums(I.feats(spark, sf)).select((F.col("diff_sum") + F.lit(0.0)).alias("diff_sum")).distinct()


@query(
    "distinct_sum_total",
    f"""with {I.FEATS_SQL}, d as (select distinct round(list_sum(f_diff), 2) as diff_sum from feats)
    select count(*) as n_distinct, round(sum(diff_sum), 6) + 0.0 as overall_sum from d""",
)
def distinct_sum_total(spark, sf):
    return M.distinct_sum_total(I.feats(spark, sf), digits=2).withColumn("overall_sum", r6("overall_sum"))


@query(
    "mean_pair_loss",
    f"""with {I.MODELS_SQL}
    select model, count(*) as n_pairs, round(avg(ln(1 + exp(-(score_chosen - score_rejected)))), 6) as mean_loss
    from models group by model""",
)
def mean_pair_loss(spark, sf):
    return M.mean_pair_loss(I.two_models(spark, sf), ["model"]).withColumn("mean_loss", r6("mean_loss"))


@query(
    "best_epoch",
    f"""with {I.MODELS_SQL},
    e as (select model as family, model || '-' || subset as model, subset as epoch,
                 round(avg({HIT}), 2) as accuracy from models group by all),
    r as (select *, row_number() over (partition by family order by accuracy desc, epoch desc) as rn from e)
    select family, model, accuracy, epoch from r where rn = 1""",
)
def best_epoch(spark, sf):
    """Subsets stand in for epochs; accuracies are rounded so that epochs tie."""
    per_subset = M.subset_accuracy(I.two_models(spark, sf), ["model"])
    epochs = per_subset.select(
        F.col("model").alias("family"),
        F.concat_ws("-", "model", "subset").alias("model"),
        F.col("subset").alias("epoch"),
        F.round("accuracy", 2).alias("accuracy"),
    )
    return M.best_model(epochs, ["family"]).select("family", "model", "accuracy", "epoch")


PROBS_SQL = "unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::double[])"
QUANTILE_LIST = "[0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]"


@query(
    "score_quantiles",
    f"""with {I.MODELS_SQL}, q as (select model, quantile_cont(score_chosen, {QUANTILE_LIST}) as qs from models group by model)
    select model, {PROBS_SQL} as prob, round(unnest(qs), 6) + 0.0 as quantile from q""",
)
def score_quantiles(spark, sf):
    q = M.exact_quantiles(I.two_models(spark, sf), "score_chosen", ["model"])
    return q.withColumn("quantile", r6("quantile"))


@query(
    "value_quantiles",
    f"""with q as (select quantile_cont(l_quantity, {QUANTILE_LIST}) as qs from lineitem)
    select {PROBS_SQL} as prob, round(unnest(qs), 6) + 0.0 as quantile from q""",
)
def value_quantiles(spark, sf):
    """Quantiles of a column with few distinct values, without groups."""
    return M.exact_quantiles(I.table(spark, sf, "lineitem"), "l_quantity").withColumn("quantile", r6("quantile"))


@query(
    "approximate_score_quantiles",
    f"""with {I.MODELS_SQL}, s as (select model, list_sort(list(score_chosen)) as v, count(*) as n from models group by model),
    p as (select model, v, n, {PROBS_SQL} as prob from s)
    select model, prob, round(v[greatest(ceil(prob::double * n), 1)::bigint], 6) + 0.0 as quantile from p""",
)
def approximate_score_quantiles(spark, sf):
    """The sketch keeps 10,000 values, so groups up to that size get the value of the wanted rank itself."""
    found = M.approximate_quantiles(I.two_models(spark, sf), "score_chosen", ["model"])
    return found.withColumn("quantile", r6("quantile"))
