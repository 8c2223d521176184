"""Queries on vectors, pooling, scores and binned reward distributions."""

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import vectors as V
from ..operators.pooling import pool_tokens
from ..operators.scoring import PythonScorer, nan_report, score_pairs
from . import inputs as I
from .pairs import r6
from .registry import query

LONG_SQL = "select {keys}, unnest(range({n})) as pos, round(unnest({vec}), 6) + 0.0 as value from {source}"


def _long(df, keys, vec):
    return df.select(*keys, F.posexplode(vec).alias("pos", "value")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value")
    )


@query("difference_vectors", f"with {I.FEATS_SQL} " + LONG_SQL.format(keys="example_num", n=64, vec="f_diff", source="feats"))
def difference_vectors(spark, sf):
    return _long(I.feats(spark, sf), ["example_num"], "f_diff")


@query("truncated_vectors", f"with {I.FEATS_SQL} " + LONG_SQL.format(keys="example_num", n=16, vec="f_diff[1:16]", source="feats"))
def truncated_vectors(spark, sf):
    return _long(I.feats(spark, sf), ["example_num"], V.truncate("f_diff", 16))


@query(
    "normalised_vectors",
    f"""with {I.FEATS_SQL},
    u as (select example_num, sqrt(list_sum(list_transform(f_diff, lambda x: x * x))) + 1e-12 as norm, f_diff from feats),
    v as (select example_num, list_transform(f_diff, lambda x: x / norm) as unit from u) """
    + LONG_SQL.format(keys="example_num", n=64, vec="unit", source="v"),
)
def normalised_vectors(spark, sf):
    return _long(I.feats(spark, sf), ["example_num"], V.l2_normalise("f_diff"))


@query(
    "non_zero_components",
    f"""with {I.FEATS_SQL},
    q as (select example_num, list_transform(f_diff, lambda x: case when abs(x) < 0.3 then 0.0::double else x end) as v from feats)
    select example_num,
           len(list_filter(v, lambda x: x != 0))::bigint as n_non_zero,
           coalesce(list_sum(list_filter(list_transform(list_zip(v, range(64)), lambda p: case when p[1] != 0 then p[2]::bigint end), lambda x: x is not null)), 0)::bigint as position_sum,
           round(coalesce(list_sum(list_filter(v, lambda x: x != 0)), 0.0), 6) + 0.0 as value_sum,
           (len(list_filter(v, lambda x: x != 0)) = 0)::int as is_zero
    from q""",
)
def non_zero_components(spark, sf):
    """Small components are set to zero first, so that there are zeros to find."""
    v = F.transform("f_diff", lambda x: F.when(F.abs(x) < 0.3, F.lit(0.0)).otherwise(x))
    q = I.feats(spark, sf).select("example_num", v.alias("v"))
    positions = V.non_zero_positions("v")
    return q.select(
        "example_num",
        F.size(positions).cast("bigint").alias("n_non_zero"),
        F.aggregate(positions, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("position_sum"),
        r6(V.non_zero_sum("v")).alias("value_sum"),
        V.is_zero("v").cast("int").alias("is_zero"),
    )


TOKEN_VECTORS_SQL = """tv as (
  select vec_id // 8 as example_num, vec_id % 8 as pos, list_transform(embedding, lambda x: x::double) as vec,
         vec_id % 8 > (vec_id // 8) % 8 as is_pad from embeddings)"""


def _token_vectors(spark, sf):
    """Eight consecutive vectors are the tokens of one example; how many are padding differs by example."""
    e = I.table(spark, sf, "embeddings")
    return e.select(
        F.expr("vec_id div 8").alias("example_num"),
        (F.col("vec_id") % 8).alias("pos"),
        V.as_double("embedding").alias("vec"),
        (F.col("vec_id") % 8 > F.expr("vec_id div 8") % 8).alias("is_pad"),
    )


def _pooled_sql(pick: str) -> str:
    return f"with {TOKEN_VECTORS_SQL}, p as (select example_num, {pick} as pooled from tv group by example_num) " + LONG_SQL.format(
        keys="example_num", n=64, vec="pooled", source="p"
    )


@query("pooled_first", _pooled_sql("min_by(vec, pos)"))
def pooled_first(spark, sf):
    return _long(pool_tokens(_token_vectors(spark, sf), "first"), ["example_num"], "pooled")


@query("pooled_last", _pooled_sql("max_by(vec, pos)"))
def pooled_last(spark, sf):
    return _long(pool_tokens(_token_vectors(spark, sf), "last"), ["example_num"], "pooled")


@query("pooled_last_token", _pooled_sql("max_by(vec, pos) filter (where not is_pad)"))
def pooled_last_token(spark, sf):
    return _long(pool_tokens(_token_vectors(spark, sf), "last_token"), ["example_num"], "pooled")


@query(
    "pooled_mean",
    f"""with {TOKEN_VECTORS_SQL}, x as (select example_num, unnest(range(64)) as pos, unnest(vec) as value from tv)
    select example_num, pos, round(avg(value), 6) + 0.0 as value from x group by example_num, pos""",
)
def pooled_mean(spark, sf):
    return _long(pool_tokens(_token_vectors(spark, sf), "mean"), ["example_num"], "pooled")


RAW_SCORE_SQL = """case when example_num % 10 = 3 then 'NaN'::double when example_num % 10 = 7 then 'Infinity'::double
       else score_chosen end"""


def _raw_scores(spark, sf):
    n = F.col("example_num") % 10
    bad = F.when(n == 3, F.lit(float("nan"))).when(n == 7, F.lit(float("inf"))).otherwise(F.col("score_chosen"))
    return I.pairs(spark, sf).select("example_num", "score_rejected", bad.alias("score"))


@query(
    "cleaned_scores",
    f"""with {I.PAIRS_SQL}, r as (select example_num, {RAW_SCORE_SQL} as score from pairs)
    select example_num, isnan(score)::int as was_nan, isinf(score)::int as was_infinite,
           case when isinf(score) then null else round(case when isnan(score) then 0.0 else score end, 6) + 0.0 end as finite_score
    from r""",
)
def cleaned_scores(spark, sf):
    """Scores with some made NaN and some infinite; the largest finite double is shown as NULL."""
    raw = _raw_scores(spark, sf).withColumn("clean", S.clean_score("score"))
    return raw.select(
        "example_num",
        F.isnan("score").cast("int").alias("was_nan"),
        (F.col("clean") == S.MAX_DOUBLE).cast("int").alias("was_infinite"),
        F.when(F.col("clean") < S.MAX_DOUBLE, r6("clean")).alias("finite_score"),
    )


@query(
    "nan_scores_counted",
    "select count(*) as n_pairs, count(*) filter (where (vec_id // 2) % 10 = 3) as n_nan from embeddings where vec_id % 2 = 0",
)
def nan_scores_counted(spark, sf):
    """A Python scorer that gives NaN for some pairs: each is replaced and counted."""
    marked = I.feats(spark, sf).withColumn("f_chosen", F.concat(F.array(F.col("example_num").cast("double")), F.col("f_chosen")))
    return nan_report(score_pairs(marked, PythonScorer(_sometimes_nan)))


def _sometimes_nan():
    """Scores by the first component, NaN where it is 3 modulo 10 and the vector has 65 components."""
    import numpy as np

    def score(batch):
        first = np.array([v[0] for v in batch])
        whole = np.array([len(v) == 65 for v in batch])
        return np.where(whole & (first % 10 == 3), np.nan, first), list(batch)

    return score


@query(
    "parsed_scores",
    f"""with {I.PAIRS_SQL}
    select example_num, case when example_num % 3 = 2 then 0.0 else round(score_chosen, 6) + 0.0 end as score from pairs""",
)
def parsed_scores(spark, sf):
    """Raw scorer output in three shapes: a record, a plain number, something else."""
    n = F.col("example_num") % 3
    record = F.to_json(F.struct(F.lit("LABEL_1").alias("label"), F.col("score_chosen").alias("score")))
    raw = F.when(n == 0, record).when(n == 1, F.col("score_chosen").cast("string")).otherwise(F.lit("no score"))
    return I.pairs(spark, sf).select("example_num", r6(S.parse_score(raw)).alias("score"))


REWARD_BINS_SQL = """a as (select vec_id, list_transform(embedding, lambda x: abs(x::double)) as v from embeddings),
rb as (
  select vec_id,
         [list_transform(v[1:10], lambda x: x / list_sum(v[1:10])),
          list_transform(v[11:20], lambda x: x / list_sum(v[11:20]))] as rewards,
         [v[21] / (v[21] + v[22]), v[22] / (v[21] + v[22])] as weights,
         v[21:22] as logits
  from a)"""


def _reward_bins(spark, sf):
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    a = I.table(spark, sf, "embeddings").select("vec_id", v.alias("v"))

    def share(start):
        part = F.slice("v", start, 10)
        return F.transform(part, lambda x: x / V.total(part))

    pair = F.slice("v", 21, 2)
    return a.select(
        "vec_id",
        F.array(share(1), share(11)).alias("rewards"),
        F.transform(pair, lambda x: x / V.total(pair)).alias("weights"),
        pair.alias("logits"),
    )


MIX_SQL = "list_transform(list_zip(rewards[1], rewards[2]), lambda p: {a} * p[1] + {b} * p[2])"


@query(
    "reward_distribution",
    f"with {REWARD_BINS_SQL}, m as (select vec_id, {MIX_SQL.format(a='weights[1]', b='weights[2]')} as mix from rb) "
    + LONG_SQL.format(keys="vec_id", n=10, vec="mix", source="m"),
)
def reward_distribution(spark, sf):
    b = _reward_bins(spark, sf).select("vec_id", S.mixture("weights", "rewards").alias("mix"))
    return _long(b, ["vec_id"], "mix")


@query(
    "expected_reward",
    f"""with {REWARD_BINS_SQL}, m as (select vec_id, {MIX_SQL.format(a='weights[1]', b='weights[2]')} as mix from rb)
    select vec_id, round(list_sum(list_transform(list_zip(mix, range(10)), lambda p: p[1] * p[2] / 9.0)), 6) + 0.0 as score from m""",
)
def expected_reward(spark, sf):
    b = _reward_bins(spark, sf)
    return b.select("vec_id", r6(S.expected_reward(S.mixture("weights", "rewards"))).alias("score"))


@query(
    "gated_reward",
    f"""with {REWARD_BINS_SQL},
    g as (select *, exp(logits[1] / 0.5) / (exp(logits[1] / 0.5) + exp(logits[2] / 0.5)) as w from rb),
    m as (select vec_id, w, {MIX_SQL.format(a='w', b='(1 - w)')} as mix from g)
    select vec_id, round(w, 6) as first_weight,
           round(list_sum(list_transform(list_zip(mix, range(10)), lambda p: p[1] * p[2] / 9.0)), 6) + 0.0 as score from m""",
)
def gated_reward(spark, sf):
    b = _reward_bins(spark, sf).withColumn("w", S.softmax("logits", 0.5))
    return b.select(
        "vec_id", r6(F.get("w", F.lit(0))).alias("first_weight"), r6(S.expected_reward(S.mixture("w", "rewards"))).alias("score")
    )


@query(
    "fit_quality",
    f"""with {I.FEATS_SQL},
    c as (select example_num, f_diff as y, f_chosen,
                 list_sum(list_transform(list_zip(f_diff, f_chosen), lambda p: p[1] * p[2]))
                   / list_sum(list_transform(f_chosen, lambda x: x * x)) as k from feats),
    s as (select example_num,
                 list_sum(list_transform(list_zip(y, f_chosen), lambda p: (p[1] - k * p[2]) ** 2)) as ss_res,
                 list_sum(list_transform(y, lambda x: (x - list_avg(y)) ** 2)) as ss_tot from c)
    select example_num, round(ss_res / 64, 6) + 0.0 as mse, round(1 - ss_res / ss_tot, 6) + 0.0 as r2_score,
           round(sqrt(ss_res), 6) + 0.0 as residual from s""",
)
def fit_quality(spark, sf):
    """Quality of the stored reconstruction k·f_chosen of each difference, k by least squares."""
    f = I.feats(spark, sf).withColumn("k", V.dot("f_diff", "f_chosen") / V.squared_norm("f_chosen"))
    fitted = F.transform("f_chosen", lambda x: x * F.col("k"))
    q = f.withColumn("fitted", fitted).select("example_num", V.fit_quality("f_diff", "fitted").alias("q"))
    return q.select("example_num", r6("q.mse").alias("mse"), r6("q.r2_score").alias("r2_score"), r6("q.residual").alias("residual"))
