"""Queries that write to the shared folder and read back, and batch scoring and training."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import seeded_uniform
from ..functions.scores import wins
from ..functions.tokens import conversation, fit_length, split_words
from ..functions.vectors import l2_norm
from ..operators import metrics as M
from ..operators import scoring as C
from ..operators import trainer as TR
from ..operators.sampling import split_train_validation
from ..operators.templates import render_for_models, template_table
from ..plans.study import evaluate, relabel
from ..session import materialise, scratch_path
from ..sources import features as FE
from ..sources import records as RE
from ..sources import redundant_sets as RS
from . import inputs as I
from .metrics import HIT
from .pairs import REDUNDANT_SQL, r6
from .registry import query
from .texts import PAD, TEMPLATES


@query(
    "csv_records",
    "select doc_id::varchar as doc_id, text, lang, source, n_chars::varchar as n_chars from documents",
)
def csv_records(spark, sf):
    """Whole texts with quotes and line breaks through a CSV file; every column comes back a string."""
    path = scratch_path(spark, "records") + ".csv"
    RE.write_csv(I.table(spark, sf, "documents"), path)
    return RE.read_records(spark, path)


@query("json_line_records", "select conv_id, turn, role, text from conversations")
def json_line_records(spark, sf):
    path = scratch_path(spark, "records") + ".jsonl"
    source = I.table(spark, sf, "conversations")
    RE.write_records(source, path)
    return RE.read_records(spark, path, source.schema).select("conv_id", "turn", "role", "text")


@query(
    "feature_matrix",
    """select vec_id as example_num, len(embedding)::int as d,
              round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings""",
)
def feature_matrix(spark, sf):
    path = scratch_path(spark, "matrix")
    e = I.table(spark, sf, "embeddings")
    e.select(F.col("vec_id").alias("example_num"), F.col("embedding").cast("array<double>").alias("features")).write.parquet(path)
    m = FE.load_matrix(spark, path)
    return m.select("example_num", F.size("features").alias("d"), r6(l2_norm(F.col("features").cast("array<double>"))).alias("norm"))


@query(
    "preference_split",
    "select item_id as example_num, text as prompt, text as chosen, item_id || '?' as rejected from benchmark",
)
def preference_split(spark, sf):
    root = scratch_path(spark, "dataset")
    b = I.table(spark, sf, "benchmark")
    b.select("item_id", F.col("text").alias("question"), F.col("text").alias("good"), F.concat(F.col("item_id").cast("string"), F.lit("?")).alias("bad")).write.parquet(f"{root}/filtered")
    columns = {"example_num": "item_id", "prompt": "question", "chosen": "good", "rejected": "bad"}
    return RE.read_preferences(spark, root, "filtered", columns)


def _scored(spark, sf, scorer=I.FIRST_SCORER):
    return C.score_pairs(I.feats(spark, sf), scorer)


@query(
    "stored_features",
    f"""with {I.PAIRS_SQL}, {I.SECTIONS_SQL}
    select example_num, subset, round(score_chosen, 5) + 0.0 as score_chosen, round(score_rejected, 5) + 0.0 as score_rejected,
           round(sqrt(list_sum(list_transform(f_diff, lambda x: x * x))), 5) as norm_diff
    from pairs join feats using (example_num, subset) join sections using (subset) where section = 'reasoning'""",
)
def stored_features(spark, sf):
    """Write every section's partition, read one back."""
    root = scratch_path(spark, "features")
    from ..operators.pairs import keep_section

    dims = I.sections(spark)
    for section in ("chat", "chat_hard", "safety", "reasoning"):
        part = keep_section(I.feats(spark, sf), dims, section)
        FE.save_features(C.score_pairs(part, I.FIRST_SCORER), root, "first", section)
    back = FE.usable_features(spark, root, "first", "reasoning")
    return back.select(
        "example_num",
        "subset",
        (F.round("score_chosen", 5) + F.lit(0.0)).alias("score_chosen"),
        (F.round("score_rejected", 5) + F.lit(0.0)).alias("score_rejected"),
        F.round(l2_norm("f_diff"), 5).alias("norm_diff"),
    )


@query(
    "stored_correct_differences",
    f"""with {I.PAIRS_SQL} select example_num, round(list_sum(f_diff), 5) + 0.0 as diff_sum
    from pairs join feats using (example_num, subset) where score_chosen > score_rejected""",
)
def stored_correct_differences(spark, sf):
    root = scratch_path(spark, "features")
    FE.reuse_or_compute(spark, root, "first", "all", lambda: _scored(spark, sf))
    # The second call finds the stored partition and computes nothing.
    reused = FE.reuse_or_compute(spark, root, "first", "all", lambda: _scored(spark, sf))
    correct = M.correct_pairs(reused)
    total = F.aggregate("f_diff", F.lit(0.0), lambda a, x: a + x)
    return correct.select("example_num", (F.round(total, 5) + F.lit(0.0)).alias("diff_sum"))


@query(
    "stored_redundant_set",
    f"with {I.PAIRS_SQL} select example_num, ({REDUNDANT_SQL})::int as is_redundant from pairs",
)
def stored_redundant_set(spark, sf):
    root = scratch_path(spark, "redundant")
    flagged = I.pairs(spark, sf).withColumn("is_redundant", seeded_uniform(7, "example_num") < 0.6)
    for threshold in (0.95, 0.8):
        RS.save_redundant_set(flagged, root, "gold", "all", "nnls", threshold)
    back = RS.lookup_redundant_set(spark, root, "gold", "all", "nnls", 0.95)
    return back.select("example_num", F.col("is_redundant").cast("int").alias("is_redundant"))


@query(
    "json_report",
    f"""with {I.PAIRS_SQL}
    select subset, '{{"subset":' || subset || ',"n_pairs":' || count(*) || ',"n_correct":' || sum({HIT}) || '}}' as report
    from pairs group by subset""",
)
def json_report(spark, sf):
    counts = M.subset_accuracy(I.pairs(spark, sf)).select("subset", "n_pairs", "n_correct")
    return RE.report_json(counts).withColumn("subset", F.get_json_object("report", "$.subset").cast("int"))


LENGTH_PAIRS_SQL = f"""with {I.PROMPTS_SQL}
    select conv_id, turn, completion as preferred, prompt as dispreferred, length(completion)::double as score_chosen,
           length(prompt)::double as score_rejected, length(completion)::double - length(prompt)::double as diff
    from prompts where length(completion) < length(prompt)"""


@query("misranked_pairs", LENGTH_PAIRS_SQL)
def misranked_pairs(spark, sf):
    """The scorer is text length; failures go through the JSON writer."""
    path = scratch_path(spark, "failures") + ".jsonl"
    scored = I.prompts(spark, sf).select(
        "conv_id",
        "turn",
        F.col("completion").alias("preferred"),
        F.col("prompt").alias("dispreferred"),
        F.length("completion").cast("double").alias("score_chosen"),
        F.length("prompt").cast("double").alias("score_rejected"),
    )
    failures = M.misranked_pairs(scored)
    RE.write_records(failures, path)
    return RE.read_records(spark, path, failures.schema)


# ---- batch scoring and training ----


def _word_scorer():
    """Score: words per sentence mark; features: characters, words, line breaks."""

    def score(texts):
        features = [[float(len(t)), float(t.count(" ") + 1), float(t.count("\n"))] for t in texts]
        return [f[1] - f[2] for f in features], features

    return score


@query(
    "python_scorer",
    f"""with {I.PROMPTS_SQL},
    f as (select conv_id, turn, length(completion)::double as c_chars, length(prompt)::double as p_chars,
                 (length(completion) - length(replace(completion, ' ', '')) + 1)::double as cw,
                 (length(prompt) - length(replace(prompt, ' ', '')) + 1)::double as pw,
                 (length(completion) - length(replace(completion, chr(10), '')))::double as cl,
                 (length(prompt) - length(replace(prompt, chr(10), '')))::double as pl from prompts)
    select conv_id, turn, cw - cl as score_chosen, pw - pl as score_rejected, c_chars - p_chars as char_diff, cl - pl as line_diff from f""",
)
def python_scorer(spark, sf):
    registry = C.ScorerRegistry({"words": C.PythonScorer(_word_scorer)}, default=I.FIRST_SCORER)
    scored = C.score_pairs(I.prompts(spark, sf), registry.get("words"), ("completion", "prompt"), ["conv_id", "turn"])
    diff = C.with_difference(scored)
    return diff.select(
        "conv_id", "turn", "score_chosen", "score_rejected",
        F.get("f_diff", F.lit(0)).alias("char_diff"), F.get("f_diff", F.lit(2)).alias("line_diff"),
    )


@query(
    "default_scorer",
    f"""with {I.PAIRS_SQL} select example_num, round(score_chosen, 6) + 0.0 as score_chosen,
        round(score_rejected, 6) + 0.0 as score_rejected from pairs""",
)
def default_scorer(spark, sf):
    registry = C.ScorerRegistry({}, default=I.FIRST_SCORER)
    scored = C.score_pairs(I.feats(spark, sf), registry.get("a model without an entry"))
    return scored.select("example_num", r6("score_chosen").alias("score_chosen"), r6("score_rejected").alias("score_rejected"))


@query(
    "pairwise_training_rows",
    f"""with {I.FEATS_SQL}, b as (select 1.0::double as label, f_diff as v from feats
        union all select 0.0::double as label, list_transform(f_diff, lambda x: -x) as v from feats)
    select label, count(*) as n_rows, round(sum(list_sum(list_transform(v, lambda x: x * x))), 4) as squares,
           round(sum(v[1]), 5) + 0.0 as first_sum from b group by label""",
)
def pairwise_training_rows(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = TR.pairwise_examples(I.feats(spark, sf)).select("label", vector_to_array("features").alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.sum(squares), 4).alias("squares"),
        (F.round(F.sum(F.get("v", F.lit(0))), 5) + F.lit(0.0)).alias("first_sum"),
    )


@query("fitted_scorer")
def fitted_scorer(spark, sf):
    """Fit on the training part, evaluate both parts; no SQL fits a logistic regression."""
    parts = materialise(split_train_validation(I.feats(spark, sf), 0.2), "parts")
    scorer = TR.fit_pairwise(parts.where("part = 'train'"))
    return C.evaluate_parts(TR.score_difference(parts, scorer))


@query(
    "failure_report",
    f"""with {I.PAIRS_SQL},
    t as (select p.*, a.text as preferred, b.text as dispreferred from pairs p
          join documents a on a.doc_id = 2 * p.example_num join documents b on b.doc_id = 2 * p.example_num + 1)
    select round(score_chosen - score_rejected, 6) + 0.0 as diff, round(score_chosen, 6) + 0.0 as score_chosen, preferred,
           round(score_rejected, 6) + 0.0 as score_rejected, dispreferred from t where score_chosen < score_rejected""",
)
def failure_report(spark, sf):
    """Misranked pairs with both texts, written as records and read back."""
    texts = I.table(spark, sf, "documents").select("doc_id", "text")
    scored = I.pairs(spark, sf).withColumns({"doc_id": F.col("example_num") * 2, "other": F.col("example_num") * 2 + 1})
    scored = scored.join(texts.withColumnRenamed("text", "preferred"), "doc_id")
    scored = scored.join(texts.select(F.col("doc_id").alias("other"), F.col("text").alias("dispreferred")), "other")
    path = scratch_path(spark, "failures") + ".jsonl"
    RE.write_failures(scored, path)
    kinds = "diff double, score_chosen double, preferred string, score_rejected double, dispreferred string"
    found = RE.read_records(spark, path, T.StructType.fromDDL(kinds))
    return found.withColumns({c: r6(c) for c in ("diff", "score_chosen", "score_rejected")})




WORDS_SQL = """string_split('<|user|>' || prompt || '<|end|><|assistant|>' || {side} || '<|end|>', ' ')"""


@query(
    "scoring_path_whole",
    f"""with {I.PROMPTS_SQL},
    t as (select conv_id, turn, {WORDS_SQL.format(side='completion')} as c, {WORDS_SQL.format(side='prompt')} as r from prompts),
    f as (select conv_id, turn, array_to_string(c[greatest(len(c) - 2047, 1):len(c)], ' ') as c,
                 array_to_string(r[greatest(len(r) - 2047, 1):len(r)], ' ') as r from t),
    w as (select *, (length(c) - length(replace(c, ' ', '')) + 1)::double - (length(c) - length(replace(c, chr(10), '')))::double as a,
                 (length(r) - length(replace(r, ' ', '')) + 1)::double - (length(r) - length(replace(r, chr(10), '')))::double as b from f)
    select conv_id, turn, a as score_chosen, b as score_rejected, (a > b)::int as is_correct,
           (length(c) - length(r))::double as char_diff from w""",
)
def scoring_path_whole(spark, sf):
    """Prompt and two completions all the way: conversation, template, length, scorer, clean scores, comparison.

    Texts beyond 2,048 words lose their beginning, so the completion is always scored.
    """
    models = F.lit("first").alias("model")
    sides = I.prompts(spark, sf).select("conv_id", "turn", models, "prompt", F.col("completion").alias("chosen"), F.col("prompt").alias("rejected"))
    for side in ("chosen", "rejected"):
        rendered = render_for_models(
            sides.withColumn("conversation", conversation("prompt", side)), template_table(spark, TEMPLATES), name="text"
        )
        tokens, mask = fit_length("words", 2048, F.lit(PAD), "left", "right")
        fitted = rendered.withColumn("words", split_words("text")).withColumns({"t": tokens, "m": mask})
        real = F.slice("t", F.lit(1), F.aggregate("m", F.lit(0), lambda n, x: n + x))
        sides = fitted.withColumn(f"{side}_text", F.array_join(real, " ")).drop("conversation", "text", "words", "t", "m")
    scored = C.score_pairs(sides, C.PythonScorer(_word_scorer), ("chosen_text", "rejected_text"), ["conv_id", "turn"])
    return C.with_difference(scored).select(
        "conv_id",
        "turn",
        "score_chosen",
        "score_rejected",
        wins("score_chosen", "score_rejected", "gt").cast("int").alias("is_correct"),
        F.get("f_diff", F.lit(0)).alias("char_diff"),
    )


@query(
    "evaluation_study",
    f"""with {I.PAIRS_SQL}, {I.SECTIONS_SQL},
    p as (select subset, count(*) as n, avg((score_chosen > score_rejected)::int) as accuracy from pairs group by subset)
    select 'overall' as level, 'all' as name, count(*) as n, round(avg((score_chosen > score_rejected)::int), 6) as accuracy from pairs
    union all select 'subset', subset::varchar, n, round(accuracy, 6) from p
    union all select 'section', section, count(*), round(sum(accuracy * example_count) / sum(example_count), 6)
              from p join sections using (subset) group by section
    union all select 'coverage', 'labelled', count(*), 1.0 from pairs""",
)
def evaluation_study(spark, sf):
    """Stored scores that lost their labels get them again and are evaluated, without any search."""
    labels = I.feats(spark, sf).select("example_num", "subset")
    scored = relabel(I.pairs(spark, sf), labels)
    found = evaluate(scored, I.sections(spark))

    def level(name, df, label, n, accuracy):
        return df.select(F.lit(name).alias("level"), label.cast("string").alias("name"), n.cast("bigint").alias("n"), r6(accuracy).alias("accuracy"))

    share = F.col("n_labelled") / F.col("n_scored")
    return (
        level("overall", found["overall"], F.lit("all"), F.col("n_pairs"), F.col("accuracy"))
        .unionByName(level("subset", found["subsets"], F.col("subset"), F.col("n_pairs"), F.col("accuracy")))
        .unionByName(level("section", found["sections"], F.col("section"), F.col("n_subsets"), F.col("section_score")))
        .unionByName(level("coverage", found["coverage"], F.lit("labelled"), F.col("n_labelled"), share))
    )
