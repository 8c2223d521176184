"""Tables the queries share, derived from the test tables in Spark, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double, difference
from ..operators.pairs import pair_sides
from ..operators.scoring import LinearScorer, score_pairs

DIM = 64
FIRST_SCORER = LinearScorer(tuple(((j * 37) % 13 - 6) / 6.0 for j in range(DIM)))
SECOND_SCORER = LinearScorer(tuple(((j * 29) % 11 - 5) / 5.0 for j in range(DIM)))
SECTIONS = [
    ("chat", 0, 100),
    ("chat", 1, 95),
    ("chat", 2, 40),
    ("chat_hard", 3, 37),
    ("chat_hard", 4, 46),
    ("chat_hard", 5, 134),
    ("safety", 6, 100),
    ("safety", 7, 154),
    ("reasoning", 8, 447),
    ("reasoning", 9, 164),
]
SEED = 42
BAD_SCORE_SHARE = 0.1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected feature vectors: consecutive vectors form a pair, and every vector is in one."""
    e = table(spark, sf_dir, "embeddings").withColumn("example_num", F.expr("vec_id div 2"))
    first = F.col("vec_id") == F.col("example_num") * 2
    chosen = e.where(first).select("example_num", F.col("label").alias("subset"), F.col("embedding").alias("f"))
    rejected = e.where(~first).select("example_num", F.col("embedding").alias("f"))
    return chosen, rejected


def feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_num, subset, f_chosen, f_rejected, f_diff."""
    chosen, rejected = sides(spark, sf_dir)
    paired = pair_sides(chosen, rejected, ["example_num"], ["f"])
    return paired.select(
        "example_num",
        "subset",
        as_double("f_chosen").alias("f_chosen"),
        as_double("f_rejected").alias("f_rejected"),
        difference("f_chosen", "f_rejected").alias("f_diff"),
    )


def pairs(spark: SparkSession, sf_dir: str, scorer: LinearScorer = FIRST_SCORER) -> DataFrame:
    """example_num, subset, score_chosen, score_rejected."""
    return score_pairs(feats(spark, sf_dir), scorer).select(
        "example_num", "subset", "score_chosen", "score_rejected"
    )


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of both scorers in one table with a ``model`` column; the features are read once."""
    scored = feats(spark, sf_dir).select(
        "example_num",
        "subset",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("model"),
                        s.score("f_chosen").alias("score_chosen"),
                        s.score("f_rejected").alias("score_rejected"),
                    )
                    for name, s in (("first", FIRST_SCORER), ("second", SECOND_SCORER))
                ]
            )
        ),
    )
    return scored.select("model", "example_num", "subset", "score_chosen", "score_rejected")


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECTIONS, "section string, subset int, example_count bigint")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn with the assistant turn that follows it. Turns are numbered without gaps."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    replied = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion")
    )
    return asked.join(replied, ["conv_id", "turn"])


# ---- the same in SQL, as the start of a WITH list ----

FEATS_SQL = """
feats as (
  select c.vec_id // 2 as example_num, c.label as subset,
         list_transform(c.embedding, lambda x: x::double) as f_chosen,
         list_transform(r.embedding, lambda x: x::double) as f_rejected,
         list_transform(list_zip(c.embedding, r.embedding), lambda p: p[1]::double - p[2]::double) as f_diff
  from embeddings c join embeddings r on r.vec_id = c.vec_id + 1
  where c.vec_id % 2 = 0)"""


def _scored_sql(name: str, weight: str) -> str:
    return f"""
{name}_w as (select list_transform(range(0, 64), lambda j: {weight}) as w),
{name} as (
  select example_num, subset,
         list_sum(list_transform(list_zip(f_chosen, w), lambda p: p[1] * p[2])) as score_chosen,
         list_sum(list_transform(list_zip(f_rejected, w), lambda p: p[1] * p[2])) as score_rejected
  from feats, {name}_w)"""


PAIRS_SQL = FEATS_SQL + "," + _scored_sql("pairs", "((j * 37) % 13 - 6) / 6.0::double")
SECOND_SQL = _scored_sql("pairs2", "((j * 29) % 11 - 5) / 5.0::double")
MODELS_SQL = (
    PAIRS_SQL
    + ","
    + SECOND_SQL
    + """,
models as (
  select 'first' as model, * from pairs union all select 'second' as model, * from pairs2)"""
)
SECTIONS_SQL = (
    "sections as (select * from (values "
    + ", ".join(f"('{s}', {x}, {n})" for s, x, n in SECTIONS)
    + ") t(section, subset, example_count))"
)
PROMPTS_SQL = """
prompts as (
  select conv_id, turn, prompt, completion from (
    select conv_id, turn, text as prompt, role,
           lead(text) over (partition by conv_id order by turn) as completion,
           lead(role) over (partition by conv_id order by turn) as next_role
    from conversations)
  where role = 'user' and next_role = 'assistant')"""
