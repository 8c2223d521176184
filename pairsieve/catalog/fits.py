"""Queries on fits and redundancy.

In two components a non-negative fit has a closed form by angles and the half-space programme is an
interval, so SQL can repeat the greedy search row by row and must agree exactly.
"""

from pyspark.sql import functions as F

from ..functions.vectors import truncate
from ..operators import metrics as M
from ..operators.pairs import attach_section
from ..operators.scoring import LinearScorer, ScorerRegistry, score_pairs
from ..plans.study import StudySettings, section_study
from ..plans.training import introspect, train
from ..redundancy.fits import fit_rows
from ..redundancy.search import find_redundancy, half_space_redundancy, sweep_redundancy
from ..redundancy.sieve import Spec
from ..session import scratch_path
from . import inputs as I
from .metrics import ABLATION_TAIL, flat_report
from .pairs import REDUNDANT_SQL, r6
from .registry import query


def _mean_difference(spark, sf):
    """One basis row: the mean difference vector."""
    columns = [F.avg(F.get("f_diff", F.lit(j))).alias(f"c{j}") for j in range(I.DIM)]
    mean = I.feats(spark, sf).agg(*columns)
    return mean.select(F.lit(0).cast("bigint").alias("example_num"), F.array(*[f"c{j}" for j in range(I.DIM)]).alias("f_diff"))


MEAN_FIT_SQL = """
long as (select example_num, unnest(range(64)) as pos, unnest(f_diff) as v from feats),
mean as (select pos, avg(v) as b from long group by pos),
k as (select example_num, sum(v * b) / sum(b * b) as k from long join mean using (pos) group by example_num),
c as (select example_num, {clip} as k from k),
s as (select example_num, any_value(k) as k, sum((v - k * b) ** 2) as ss_res,
             sum(v * v) - sum(v) * sum(v) / 64 as ss_tot
      from long join mean using (pos) join c using (example_num) group by example_num)
select example_num, round(k, 6) + 0.0 as coefficient, round(ss_res / 64, 6) + 0.0 as mse,
       round(1 - ss_res / ss_tot, 6) + 0.0 as r2_score, round(sqrt(ss_res), 6) + 0.0 as residual from s"""


def _mean_fit(spark, sf, method):
    fit = fit_rows(I.feats(spark, sf), _mean_difference(spark, sf), method)
    first = F.coalesce(F.get("coefficients", F.lit(0))["coefficient"], F.lit(0.0))
    return fit.select(
        "example_num", r6(first).alias("coefficient"), r6("mse").alias("mse"), r6("r2_score").alias("r2_score"),
        r6("residual").alias("residual"),
    )


@query("lstsq_fit_on_mean", f"with {I.FEATS_SQL}, " + MEAN_FIT_SQL.format(clip="k"))
def lstsq_fit_on_mean(spark, sf):
    return _mean_fit(spark, sf, "lstsq")


@query("nnls_fit_on_mean", f"with {I.FEATS_SQL}, " + MEAN_FIT_SQL.format(clip="greatest(k, 0)"))
def nnls_fit_on_mean(spark, sf):
    return _mean_fit(spark, sf, "nnls")


ANGLE = "atan2(y.x1 * b.x2 - y.x2 * b.x1, y.x1 * b.x1 + y.x2 * b.x2)"
# ‖residual‖² of a unit vector whose nearest basis rays lie p to one side and q to the other.
CONE_RESIDUAL = "case when p + q < pi() then 0.0 when least(p, q) < pi() / 2 then sin(least(p, q)) ** 2 else 1.0 end"
SIDES = f"""coalesce(min(case when b.x1 is not null and {ANGLE} >= 0 then {ANGLE} end), 4.0) as p,
            coalesce(min(case when b.x1 is not null and {ANGLE} < 0 then -{ANGLE} end), 4.0) as q"""


@query(
    "nnls_fit_two_components",
    f"""with {I.FEATS_SQL},
    t as (select example_num, f_diff[1] as y1, f_diff[2] as y2 from feats),
    b as (select subset, avg(f_diff[1]) as x1, avg(f_diff[2]) as x2 from feats group by subset),
    a as (select y.example_num, y.y1, y.y2, {SIDES.replace('y.x1', 'y.y1').replace('y.x2', 'y.y2')}
          from t y cross join b group by all),
    r as (select *, ({CONE_RESIDUAL}) * (y1 * y1 + y2 * y2) as ss_res from a)
    select example_num, round(ss_res / 2, 6) + 0.0 as mse, round(1 - ss_res / ((y1 - y2) ** 2 / 2), 4) + 0.0 as r2_score,
           round(sqrt(ss_res), 6) + 0.0 as residual from r""",
)
def nnls_fit_two_components(spark, sf):
    """Every difference on the ten mean differences by subset, first two components."""
    f = I.feats(spark, sf).withColumn("f_diff", truncate("f_diff", 2))
    means = [F.avg(F.get("f_diff", F.lit(j))) for j in range(2)]
    basis = f.groupBy(F.col("subset").alias("example_num")).agg(F.array(*means).alias("f_diff"))
    fit = fit_rows(f, basis, "nnls")
    return fit.select(
        "example_num", r6("mse").alias("mse"), (F.round("r2_score", 4) + F.lit(0.0)).alias("r2_score"), r6("residual").alias("residual")
    )


@query(
    "nnls_fit_large_basis_two_components",
    f"""with {I.FEATS_SQL},
    t as (select example_num, f_diff[1] as y1, f_diff[2] as y2 from feats),
    b as (select f_rejected[1] as x1, f_rejected[2] as x2 from feats),
    a as (select y.example_num, y.y1, y.y2, {SIDES.replace('y.x1', 'y.y1').replace('y.x2', 'y.y2')}
          from t y cross join b group by all),
    r as (select *, ({CONE_RESIDUAL}) * (y1 * y1 + y2 * y2) as ss_res from a)
    select example_num, round(ss_res / 2, 6) + 0.0 as mse, round(sqrt(ss_res), 6) + 0.0 as residual from r""",
)
def nnls_fit_large_basis_two_components(spark, sf):
    """Every difference on all rejected vectors; only four basis rows are held at first, the rest is scanned."""
    f = I.feats(spark, sf)
    targets = f.select("example_num", truncate("f_diff", 2).alias("f_diff"))
    basis = f.select("example_num", truncate("f_rejected", 2).alias("f_diff"))
    fit = fit_rows(targets, basis, "nnls", pool_rows=4)
    return fit.select("example_num", r6("mse").alias("mse"), r6("residual").alias("residual"))


@query("nnls_fit_large_basis")
def nnls_fit_large_basis(spark, sf):
    """The same with all 64 components; tested against a plain loop."""
    f = I.feats(spark, sf)
    fit = fit_rows(f.select("example_num", "f_diff"), f.select("example_num", F.col("f_rejected").alias("f_diff")), "nnls", pool_rows=64)
    weights = F.aggregate("coefficients", F.lit(0.0), lambda total, c: total + c["coefficient"])
    return fit.select(
        "example_num", r6("mse").alias("mse"), r6("residual").alias("residual"), F.size("coefficients").alias("n_used"), r6(weights).alias("weight")
    )


# ---- greedy search in SQL, two components ----

UNIT_SQL = """u as (
  select {grp} as grp, example_num, row_number() over (partition by {grp} order by example_num) as rn,
         f_diff[1] / n as x1, f_diff[2] / n as x2
  from (select *, sqrt(f_diff[1] ** 2 + f_diff[2] ** 2) + 1e-12 as n from {source}))"""

GREEDY_SQL = """step as (
  select grp, solver, threshold, 0::bigint as rn, []::bigint[] as kept, false as red, 0.0::double as r2, 0.0::double as ss
  from (select distinct grp from u) g cross join (values {specs}) s(solver, threshold)
  union all
  select grp, solver, threshold, rn, case when red then kept else list_append(kept, rn) end, red, r2, ss from (
    select grp, solver, threshold, rn, kept, r2, ss, {predicate} as red from (
      select *, 1 - ss / tot as r2 from (
        select *, case when solver = 'lstsq' then case when turn > 1e-9 then 0.0 when n_basis = 0 then 1.0 else 1 - best end
                       else {residual} end as ss from (
          select s.grp, s.solver, s.threshold, y.rn, s.kept, (y.x1 - y.x2) ** 2 / 2 as tot, {sides},
                 count(b.rn) as n_basis,
                 coalesce(max((atan2(b.x2, b.x1) + pi()) % pi()) - min((atan2(b.x2, b.x1) + pi()) % pi()), 0.0) as turn,
                 coalesce(max((y.x1 * b.x1 + y.x2 * b.x2) ** 2), 0.0) as best
          from step s join u y on y.grp = s.grp and y.rn = s.rn + 1
          left join u b on b.grp = s.grp and (b.rn > y.rn or list_contains(s.kept, b.rn))
          group by s.grp, s.solver, s.threshold, y.rn, s.kept, y.x1, y.x2)))))"""


def greedy_sql(specs, source="feats", grp="0", by="r2") -> str:
    """CTEs ``u`` and ``step``: one row per example with ``red``."""
    predicate = "r2 >= threshold" if by == "r2" else "sqrt(ss) <= 1e-8 * sqrt(n_basis)"
    values = ", ".join(f"('{s}', {t}::double)" for s, t in specs)
    return (
        UNIT_SQL.format(grp=grp, source=source)
        + ", "
        + GREEDY_SQL.format(specs=values, predicate=predicate, residual=CONE_RESIDUAL, sides=SIDES)
    )


# A nearly constant row has an R² far below 0, of which only the leading digits are certain: five places below one, else
# five behind the leading digit.
R2_SCALE = "10 ** floor(log10(greatest(abs(r2), 1.0)))"
R2_SQL = f"round(r2 / {R2_SCALE}, 5) * {R2_SCALE} + 0.0 as r2_score"


def _found(results, *extra, value=None):
    values = []
    if value == "r2_score":
        scale = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(F.abs(value), F.lit(1.0)))))
        values = [(F.round(F.col(value) / scale, 5) * scale + F.lit(0.0)).alias(value)]
    elif value:
        values = [r6(value).alias(value)]
    return results.select(*extra, "example_num", F.col("is_redundant").cast("int").alias("is_redundant"), *values)


@query(
    "greedy_nnls_two_components",
    f"""with recursive {I.FEATS_SQL}, {greedy_sql([('nnls', 0.95)])}
    select example_num, red::int as is_redundant, {R2_SQL} from step join u using (grp, rn)""",
)
def greedy_nnls_two_components(spark, sf):
    return _found(find_redundancy(I.feats(spark, sf), components=2), value="r2_score")


@query(
    "greedy_residual_two_components",
    f"""with recursive {I.FEATS_SQL}, {greedy_sql([('nnls', 0.95)], by='res')}
    select example_num, red::int as is_redundant, round(sqrt(ss), 6) + 0.0 as residual from step join u using (grp, rn)""",
)
def greedy_residual_two_components(spark, sf):
    return _found(find_redundancy(I.feats(spark, sf), components=2, solve_by="res"), value="residual")


@query(
    "greedy_sweep_two_components",
    f"""with recursive {I.FEATS_SQL}, {greedy_sql([('nnls', 0.95), ('nnls', 0.8), ('lstsq', 0.95), ('lstsq', 0.6)])}
    select solver, threshold, example_num, red::int as is_redundant, {R2_SQL} from step join u using (grp, rn)""",
)
def greedy_sweep_two_components(spark, sf):
    specs = [Spec("nnls", "r2", 0.95), Spec("nnls", "r2", 0.8), Spec("lstsq", "r2", 0.95), Spec("lstsq", "r2", 0.6)]
    return _found(sweep_redundancy(I.feats(spark, sf), specs, components=2), "solver", "threshold", value="r2_score")


SECTIONED_SQL = f"sectioned as (select example_num, f_diff, section from feats join sections using (subset))"


@query(
    "greedy_by_section_two_components",
    f"""with recursive {I.FEATS_SQL}, {I.SECTIONS_SQL}, {SECTIONED_SQL},
    {greedy_sql([('nnls', 0.95)], source='sectioned', grp='section')}
    select grp as section, example_num, red::int as is_redundant, {R2_SQL} from step join u using (grp, rn)""",
)
def greedy_by_section_two_components(spark, sf):
    sectioned = attach_section(I.feats(spark, sf), I.sections(spark))
    return _found(find_redundancy(sectioned, group_by=["section"], components=2), "section", value="r2_score")


@query(
    "redundancy_summary",
    f"""with recursive {I.FEATS_SQL}, nonzero as (select * from feats where example_num % 10 <> 0),
    zeros as (select count(*) as z from feats where example_num % 10 = 0),
    {greedy_sql([('nnls', 0.95), ('lstsq', 0.95)], source='nonzero')},
    c as (select solver, count(*) as n, count(*) filter (where red) as r from step where rn > 0 group by solver)
    select solver, n + z as n_examples, r + z as n_redundant, n - r as n_non_redundant,
           round((r + z) / (n + z) * 100, 6) as redundant_pct, z as n_zero_redundant, r as n_non_zero_redundant from c, zeros""",
)
def redundancy_summary(spark, sf):
    """Every tenth difference is zero: redundant, and no part of any basis."""
    return _summary(spark, sf, 2)


@query("redundancy_summary_all_components")
def redundancy_summary_all_components(spark, sf):
    """The summary of the search in all 64 components; tested against the sequential loop."""
    return _summary(spark, sf, None)


def _summary(spark, sf, components):
    specs = [Spec("nnls"), Spec("lstsq")]
    zero = F.array_repeat(F.lit(0.0), I.DIM)
    f = I.feats(spark, sf).withColumn("f_diff", F.when(F.col("example_num") % 10 == 0, zero).otherwise(F.col("f_diff")))
    summary = M.redundancy_summary(sweep_redundancy(f, specs, components=components), ["solver"])
    return summary.withColumn("redundant_pct", r6("redundant_pct"))


@query(
    "method_usage",
    f"""with {I.FEATS_SQL}, m as (select unnest(['nnls', 'lstsq']) as method from feats)
    select method, count(*) as n_rows, round(count(*) / sum(count(*)) over () * 100, 6) as usage_pct from m group by method""",
)
def method_usage(spark, sf):
    return _usage(spark, sf, 2)


@query("method_usage_all_components")
def method_usage_all_components(spark, sf):
    """The rows that the search in all 64 components decided, by solver."""
    return _usage(spark, sf, None)


def _usage(spark, sf, components):
    specs = [Spec("nnls"), Spec("lstsq")]
    usage = M.method_usage(sweep_redundancy(I.feats(spark, sf), specs, components=components))
    return usage.withColumn("usage_pct", r6("usage_pct"))


HALF_SPACE_SQL = """u as (
  select example_num, row_number() over (order by example_num) as rn, f_diff[1] as x1, f_diff[2] as x2
  from feats where f_chosen[1] + f_chosen[2] > f_rejected[1] + f_rejected[2]),
step as (
  select 0::bigint as rn, []::bigint[] as kept, false as red, 0.0::double as low
  union all
  select rn, case when red then kept else list_append(kept, rn) end, red, low from (
    select rn, kept, lo <= hi and round(least(lo * y1 + (1 - lo) * y2, hi * y1 + (1 - hi) * y2), 6) >= -0.01 as red,
           case when lo <= hi then least(lo * y1 + (1 - lo) * y2, hi * y1 + (1 - hi) * y2) end as low from (
      select y.rn, s.kept, y.x1 as y1, y.x2 as y2,
             greatest(0.0, coalesce(max(case when b.x1 > b.x2 then (-0.01 - b.x2) / (b.x1 - b.x2) end), 0.0)) as lo,
             least(1.0, coalesce(min(case when b.x1 < b.x2 then (-0.01 - b.x2) / (b.x1 - b.x2) end), 1.0)) as hi
      from step s join u y on y.rn = s.rn + 1 left join u b on b.rn > y.rn or list_contains(s.kept, b.rn)
      group by y.rn, s.kept, y.x1, y.x2)))"""

TWO_ONES = LinearScorer((1.0, 1.0) + (0.0,) * (I.DIM - 2))


@query(
    "half_space_two_components",
    f"""with recursive {I.FEATS_SQL}, {HALF_SPACE_SQL}
    select example_num, red::int as is_redundant, round(low, 6) + 0.0 as min_value from step join u using (rn)""",
)
def half_space_two_components(spark, sf):
    """Correctly ranked pairs of a scorer on the simplex, so its weights meet every constraint."""
    scored = score_pairs(I.feats(spark, sf), TWO_ONES, keep=("example_num", "subset", "f_diff"))
    return _found(half_space_redundancy(M.correct_pairs(scored), components=2), value="min_value")


@query(
    "half_space_infeasible",
    f"with {I.FEATS_SQL} select example_num, 0 as is_redundant, 'linprog' as method from feats",
)
def half_space_infeasible(spark, sf):
    """All differences together contradict each other: no point meets every constraint, nothing is redundant."""
    found = half_space_redundancy(I.feats(spark, sf))
    return found.select("example_num", F.col("is_redundant").cast("int").alias("is_redundant"), "method")


UNIFORM = LinearScorer((1.0 / I.DIM,) * I.DIM)


@query("half_space_all_components")
def half_space_all_components(spark, sf):
    """Tested against a sequential linear-programming loop; SQL has no solver in 64 dimensions."""
    scored = score_pairs(I.feats(spark, sf), UNIFORM, keep=("example_num", "subset", "f_diff"))
    return _found(half_space_redundancy(M.correct_pairs(scored)), value="min_value")


@query("greedy_nnls")
def greedy_nnls(spark, sf):
    """All 64 components; tested against the sequential loop."""
    found = find_redundancy(I.feats(spark, sf))
    return _found(found, "method", value="r2_score")


@query("greedy_residual")
def greedy_residual(spark, sf):
    """Residual mode, all 64 components."""
    return _found(find_redundancy(I.feats(spark, sf), solve_by="res"), value="residual")


@query("greedy_sweep")
def greedy_sweep(spark, sf):
    """Solvers and thresholds together, all 64 components; the counts are those of the single searches."""
    specs = [Spec("nnls", "r2", 0.95), Spec("nnls", "r2", 0.8), Spec("lstsq", "r2", 0.95), Spec("lstsq", "r2", 0.6)]
    return _found(sweep_redundancy(I.feats(spark, sf), specs), "solver", "threshold", value="r2_score")


@query("greedy_lstsq")
def greedy_lstsq(spark, sf):
    """All 64 components; tested against the sequential loop."""
    found = find_redundancy(I.feats(spark, sf), solver="lstsq")
    return _found(found, "method", value="r2_score")


@query("greedy_by_section")
def greedy_by_section(spark, sf):
    """All 64 components, each section its own problem; tested against the sequential loop."""
    sectioned = attach_section(I.feats(spark, sf), I.sections(spark))
    return _found(find_redundancy(sectioned, group_by=["section"]), "section", value="r2_score")


def _roots(spark):
    return {"features": scratch_path(spark, "features"), "redundant": scratch_path(spark, "redundant")}


STUDY_ABLATION = ABLATION_TAIL.replace(
    f"flagged as (select *, {REDUNDANT_SQL} as is_redundant from models)",
    "flagged as (select models.*, red.is_redundant from models join red using (example_num))",
)


@query(
    "section_study",
    f"""with recursive {I.MODELS_SQL}, {greedy_sql([('nnls', 0.95)])},
    red as (select example_num, red as is_redundant from step join u using (grp, rn)), {STUDY_ABLATION}""",
)
def study(spark, sf):
    """Both models on all sections, redundant set of the first (gold) model on two components."""
    registry = ScorerRegistry({"first": I.FIRST_SCORER, "second": I.SECOND_SCORER})
    settings = StudySettings("first", components=2)
    examples = I.feats(spark, sf).drop("f_diff")
    report = section_study(examples, I.sections(spark), registry, ["second", "first"], "", _roots(spark), settings)
    return flat_report(report, ["model"])


@query("section_study_all_components")
def study_all_components(spark, sf):
    """The study of all sections with all 64 components."""
    registry = ScorerRegistry({"first": I.FIRST_SCORER, "second": I.SECOND_SCORER})
    examples = I.feats(spark, sf).drop("f_diff")
    report = section_study(
        examples, I.sections(spark), registry, ["first", "second"], "", _roots(spark), StudySettings("first")
    )
    return flat_report(report, ["model"])


@query("training_curve")
def training_curve(spark, sf):
    curve, _ = train(I.feats(spark, sf), 0.2)
    return curve


@query(
    "introspection_shares",
    f"""with {I.PAIRS_SQL},
    f as (select case when {REDUNDANT_SQL} then 'redundant' else 'non_redundant' end as part,
                 (score_chosen >= score_rejected)::int as hit from pairs),
    p as (select part, count(*) as n_pairs, sum(hit)::bigint as n_correct, avg(hit) as accuracy from f group by part)
    select part, n_pairs, n_correct, round(accuracy, 6) as accuracy, round(n_pairs / sum(n_pairs) over () * 100, 6) as share_pct,
           round(sum(accuracy * n_pairs) over () / sum(n_pairs) over (), 6) as overall_accuracy from p""",
)
def introspection_shares(spark, sf):
    from ..functions.hashing import seeded_uniform

    pairs = I.feats(spark, sf)
    redundant = pairs.where(seeded_uniform(7, "example_num") < 0.6)
    shares = introspect(pairs, redundant, I.FIRST_SCORER)["shares"]
    return shares.withColumns({c: r6(c) for c in ("accuracy", "share_pct", "overall_accuracy")})


@query(
    "introspection_parts",
    f"""with {I.PAIRS_SQL},
    f as (select *, {REDUNDANT_SQL} as red, (score_chosen >= score_rejected)::int as hit,
                 row_number() over (order by md5('42|' || example_num), example_num) as rn from pairs),
    p as (select 'redundant' as part, hit from f where red union all select 'non_redundant' as part, hit from f where not red
          union all select 'random' as part, hit from f where rn <= (select count(*) from f where not red))
    select part, count(*) as n_pairs, sum(hit)::bigint as n_correct, round(avg(hit), 6) as accuracy from p group by part""",
)
def introspection_parts(spark, sf):
    from ..functions.hashing import seeded_uniform

    pairs = I.feats(spark, sf)
    redundant = pairs.where(seeded_uniform(7, "example_num") < 0.6)
    return introspect(pairs, redundant, I.FIRST_SCORER)["parts"].withColumn("accuracy", r6("accuracy"))


@query(
    "introspection_pairs",
    f"""with {I.PAIRS_SQL}
    select example_num, case when {REDUNDANT_SQL} then 'redundant' else 'non_redundant' end as part,
           round(score_chosen - score_rejected, 6) + 0.0 as score_diff,
           round(sqrt(list_sum(list_transform(f_diff, lambda x: x * x))), 6) as diff_norm,
           round(sqrt(list_sum(list_transform(f_chosen, lambda x: x * x))), 6) as chosen_norm,
           round(sqrt(list_sum(list_transform(f_rejected, lambda x: x * x))), 6) as rejected_norm
    from pairs join (select example_num, f_chosen, f_rejected, f_diff from feats) using (example_num)""",
)
def introspection_pairs(spark, sf):
    """The evaluated pairs themselves: part, score difference, both vectors and their difference."""
    from ..functions.hashing import seeded_uniform
    from ..functions.vectors import l2_norm

    pairs = I.feats(spark, sf)
    redundant = pairs.where(seeded_uniform(7, "example_num") < 0.6)
    found = introspect(pairs, redundant, I.FIRST_SCORER)["pairs"]
    norms = {f"{n}_norm": r6(l2_norm(f"f_{n}")) for n in ("diff", "chosen", "rejected")}
    score_diff = r6(F.col("score_chosen") - F.col("score_rejected")).alias("score_diff")
    return found.select("example_num", "part", score_diff, *[c.alias(n) for n, c in norms.items()])
