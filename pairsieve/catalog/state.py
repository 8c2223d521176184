"""Queries on training that continues, permuted orders, bitmaps, stored sketches, checked features and batches by length."""

from pyspark.sql import functions as F

from ..functions.hashing import seeded_uniform
from ..operators import membership as MB
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators import scoring as C
from ..operators import trainer as TR
from ..operators.pairs import assign_positions
from ..session import materialise, scratch_path
from ..sources import features as FE
from . import inputs as I
from .pairs import REDUNDANT_SQL, r6
from .registry import SQL, query
from .stores import _word_scorer

EPOCHS, STEPS = 2, 2


def _training_sql() -> str:
    """Each step of the training as three WITH entries: margins of its batch, mean gradient, next weights."""
    dot = "list_sum(list_transform(list_zip({v}, w), lambda p: p[1] * p[2]))"
    parts, rows = [I.FEATS_SQL, "w0 as (select list_transform(range(0, 64), lambda j: 0.0::double) as w)"], []
    for k in range(EPOCHS * STEPS):
        epoch, batch = divmod(k, STEPS)
        own = f"('0x' || substr(md5('42|{epoch}|' || example_num), 1, 8))::bigint % {STEPS} = {batch}"
        parts += [
            f"m{k} as materialized (select f_diff, {dot.format(v='f_diff')} as z from feats, w{k} where {own})",
            f"g{k} as (select j, avg(-x / (1 + exp(z))) as g from (select unnest(f_diff) as x, unnest(range(0, 64)) as j, z from m{k}) group by j)",
            f"s{k} as (select least(1.0, 1.0 / sqrt(sum(g * g))) * {1 - epoch / EPOCHS} as s from g{k})",
            f"w{k + 1} as materialized (select list(w[j + 1] - s * g order by j) as w from g{k}, s{k}, w{k})",
        ]
    for epoch in range(EPOCHS):
        last = (epoch + 1) * STEPS
        losses = " + ".join(f"(select avg(ln(1 + exp(-z))) from m{k})" for k in range(last - STEPS, last))
        rows.append(
            f"""select {epoch} as epoch, {last}::bigint as steps, round(({losses}) / {STEPS}, 6) as train_loss,
                (select round(avg(({dot.format(v='f_chosen')} >= {dot.format(v='f_rejected')})::int), 6) from feats, w{last}) as accuracy,
                (select round(list_sum(list_transform(w, lambda x: x * x)), 6) from w{last}) as squared_norm"""
        )
    return "with " + ", ".join(parts) + " " + " union all ".join(rows)


@query("training_epochs", _training_sql())
def training_epochs(spark, sf):
    """Two epochs of two batches; the second call finds the first epoch's state and goes on from it."""
    root = scratch_path(spark, "training")
    rows = materialise(I.feats(spark, sf), "feats")
    TR.train_epochs(rows, rows, root, EPOCHS, steps=STEPS)
    history = TR.train_epochs(rows, rows, root, EPOCHS, steps=STEPS)
    squares = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x * x)
    return history.select("epoch", "steps", r6("train_loss").alias("train_loss"), r6("accuracy").alias("accuracy"), r6(squares).alias("squared_norm"))


def _permuted_sql(seed: str) -> str:
    """The same network as nested selects; values beyond the number of rows go through it again."""

    def network(source: str) -> str:
        q = f"select doc_id, n, a, b, x // b as l, x % b as r from {source}"
        for i, (times, plus) in enumerate(S.round_keys(seed)):
            side = "r" if i % 2 == 0 else "l"
            q = f"select doc_id, n, a, b, l, r, ({side} * {times} + {plus}) % {S.PRIME} as m from ({q})"
            q = f"select doc_id, n, a, b, l, r, (m * m + {plus}) % {S.PRIME} * {times} % {S.PRIME} as m from ({q})"
            moved = "(l + m) % a as l, r" if i % 2 == 0 else "l, (r + m) % b as r"
            q = f"select doc_id, n, a, b, {moved} from ({q})"
        return f"select doc_id, n, a, b, l * b + r as x from ({q})"

    return f"""with recursive placed as (select doc_id, count(*) over () as n, row_number() over (order by doc_id) - 1 as x from documents),
    sized as (select doc_id, n, x, ceil(sqrt(n))::bigint as a, (n + ceil(sqrt(n))::bigint - 1) // ceil(sqrt(n))::bigint as b from placed),
    walk as ({network('sized')} union all {network('walk where x >= n')})
    select doc_id, x as place from walk where x < n"""


@query("permuted_order", _permuted_sql("42|3"))
def permuted_order(spark, sf):
    """The place of every document in epoch 3's order, computed from its position."""
    docs = assign_positions(I.table(spark, sf, "documents").select("doc_id"), ["doc_id"], "position")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return S.permuted(docs, docs.count(), 3, partitions).select("doc_id", "place")


@query("bitmap_membership", f"with {I.PAIRS_SQL} select example_num, subset, ({REDUNDANT_SQL})::int as is_redundant from pairs")
def bitmap_membership(spark, sf):
    """The redundant set as stored bitmaps; the scored pairs are not shuffled by key."""
    pairs = I.pairs(spark, sf)
    bitmaps = MB.build_bitmaps(pairs.where(seeded_uniform(7, "example_num") < 0.6))
    flagged = MB.flag_by_bitmaps(pairs, bitmaps, name="is_redundant")
    return flagged.select("example_num", "subset", F.col("is_redundant").cast("int").alias("is_redundant"))


PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


@query(
    "merged_score_quantiles",
    f"""with {I.MODELS_SQL}, s as (select model, count(*) as n, min(score_chosen) as low, max(score_chosen) as high from models group by model),
    p as (select *, unnest({list(PROBS)}::double[]) as prob from s)
    select model, n, prob, case prob when 0 then round(low, 6) + 0.0 when 1 then round(high, 6) + 0.0 end as extreme, 1 as within_error from p""",
)
def merged_score_quantiles(spark, sf):
    """Sketches per model and subset, stored and merged per model; each quantile's rank is looked up among all scores.

    Only the smallest and the largest value are the same in every run; the others must have a rank within the error.
    """
    scored = materialise(I.two_models(spark, sf), "scored")
    stored = materialise(M.quantile_sketches(scored, "score_chosen", ["model", "subset"]), "sketches")
    found = M.merged_quantiles(stored, ["model"], PROBS)
    ranks = scored.select("model", "score_chosen").join(F.broadcast(found), "model").groupBy("model", "n", "prob", "quantile")
    counted = ranks.agg(
        F.count_if(F.col("score_chosen") < F.col("quantile")).alias("below"), F.count_if(F.col("score_chosen") <= F.col("quantile")).alias("upto")
    )
    slack = M.SKETCH_ERROR * F.col("n") + 1
    fits = (F.col("below") <= F.col("prob") * F.col("n") + slack) & (F.col("upto") >= F.col("prob") * F.col("n") - slack)
    extreme = F.when(F.col("prob").isin(0.0, 1.0), r6("quantile"))
    return counted.select("model", "n", "prob", extreme.alias("extreme"), fits.cast("int").alias("within_error"))


@query(
    "features_of_changed_inputs",
    f"""with {I.PAIRS_SQL} select example_num, round(case when subset % 2 = 0 then -score_chosen else score_chosen end, 5) + 0.0 as score_chosen,
        round(score_rejected, 5) + 0.0 as score_rejected from pairs""",
)
def features_of_changed_inputs(spark, sf):
    """Stored features of other inputs, as many rows, are not taken: the changed inputs are scored."""
    root = scratch_path(spark, "features")
    feats = I.feats(spark, sf)
    turned = F.when(F.col("subset") % 2 == 0, F.transform("f_chosen", lambda x: -x)).otherwise(F.col("f_chosen"))
    for rows in (feats, feats.withColumn("f_chosen", turned)):
        computed = FE.reuse_or_compute(
            spark, root, "first", "all", lambda rows=rows: C.score_pairs(rows, I.FIRST_SCORER), inputs=FE.inputs_id(rows, "first")
        )
    return computed.select("example_num", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("score_chosen", "score_rejected")])


@query("scored_by_length", SQL["python_scorer"])
def scored_by_length(spark, sf):
    """Whole conversations through a Python scorer in batches of similar length, at most 4,096 characters or one text each."""
    scorer = C.PythonScorer(_word_scorer, budget=4096)
    diff = C.with_difference(C.score_pairs(I.prompts(spark, sf), scorer, ("completion", "prompt"), ["conv_id", "turn"]))
    return diff.select(
        "conv_id", "turn", "score_chosen", "score_rejected", F.get("f_diff", F.lit(0)).alias("char_diff"), F.get("f_diff", F.lit(2)).alias("line_diff")
    )
