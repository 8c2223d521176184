"""Queries on conversations and token columns. Texts are whole; only length fitting cuts them."""

from pyspark.sql import functions as F

from ..functions.tokens import conversation, drop_double_start, fit_length, overlapping_chunks, split_words
from ..operators.templates import render_for_models, template_table
from . import inputs as I
from .registry import query

PAD = "<pad>"
START = "<s>"
TEMPLATES = {"first": {"user": ("<|user|>", "<|end|>"), "assistant": ("<|assistant|>", "<|end|>")}}


@query(
    "conversation_messages",
    f"""with {I.PROMPTS_SQL}
    select conv_id, turn, 0 as pos, 'user' as role, prompt as content from prompts
    union all select conv_id, turn, 1 as pos, 'assistant' as role, completion as content from prompts""",
)
def conversation_messages(spark, sf):
    c = I.prompts(spark, sf).select("conv_id", "turn", F.posexplode(conversation("prompt", "completion")).alias("pos", "m"))
    return c.select("conv_id", "turn", "pos", "m.role", "m.content")


@query(
    "rendered_conversations",
    f"""with {I.PROMPTS_SQL}
    select conv_id, turn, 'first' as model,
           '<|user|>' || prompt || '<|end|>' || '<|assistant|>' || completion || '<|end|>' as text from prompts
    union all
    select conv_id, turn, 'second' as model,
           'User: ' || prompt || chr(10) || 'Assistant: ' || completion || chr(10) as text from prompts""",
)
def rendered_conversations(spark, sf):
    models = F.explode(F.array(F.lit("first"), F.lit("second"))).alias("model")
    c = I.prompts(spark, sf).select("conv_id", "turn", models, conversation("prompt", "completion").alias("conversation"))
    return render_for_models(c, template_table(spark, TEMPLATES)).select("conv_id", "turn", "model", "text")


TOKENS_SQL = "tok as (select doc_id, string_split(text, ' ') as t, len(string_split(text, ' ')) as n from documents)"


def _fitted_sql(length: int, side: str) -> str:
    kept = f"t[1:{length}]" if side == "right" else f"t[greatest(n - {length} + 1, 1):n]"
    pads = f"list_transform(range(greatest({length} - n, 0)), lambda i: '{PAD}')"
    joined = f"{kept} || {pads}" if side == "right" else f"{pads} || {kept}"
    ones = f"repeat('1', least(n, {length})::bigint)"
    zeros = f"repeat('0', greatest({length} - n, 0)::bigint)"
    mask = f"{ones} || {zeros}" if side == "right" else f"{zeros} || {ones}"
    return f"""with {TOKENS_SQL}
    select doc_id, md5(array_to_string({joined}, ' ')) as tokens_md5, {mask} as mask from tok"""


def _tokens(spark, sf):
    """Documents with their words split once, for expressions that use them several times."""
    return I.table(spark, sf, "documents").select("doc_id", "lang", split_words("text").alias("words"))


def _fitted(spark, sf, length, side):
    tokens, mask = fit_length("words", length, F.lit(PAD), side, side)
    d = _tokens(spark, sf).select("doc_id", tokens.alias("t"), mask.alias("m"))
    return d.select(
        "doc_id",
        F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"),
        F.array_join(F.col("m").cast("array<string>"), "").alias("mask"),
    )


@query("tokens_fitted_right", _fitted_sql(1024, "right"))
def tokens_fitted_right(spark, sf):
    return _fitted(spark, sf, 1024, "right")


@query("tokens_fitted_left", _fitted_sql(2048, "left"))
def tokens_fitted_left(spark, sf):
    return _fitted(spark, sf, 2048, "left")


@query(
    "double_start_removed",
    f"""with {TOKENS_SQL}
    select doc_id, n + 1 as n_tokens, md5('{START} ' || array_to_string(t, ' ')) as tokens_md5 from tok""",
)
def double_start_removed(spark, sf):
    """English documents get the start token twice, the others once; afterwards each has one."""
    starts = F.when(F.col("lang") == "en", F.array(F.lit(START), F.lit(START))).otherwise(F.array(F.lit(START)))
    d = _tokens(spark, sf).select("doc_id", F.concat(starts, "words").alias("t"))
    d = d.select("doc_id", drop_double_start("t", F.lit(START)).alias("t"))
    return d.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5")
    )


@query(
    "overlapping_chunks",
    f"""with {TOKENS_SQL},
    padded as (select doc_id, t || list_transform(range((512 - n % 512) % 512), lambda i: '{PAD}') as t from tok),
    c as (select doc_id, t, unnest(range(0, len(t) - 512 + 1, 256)) as i from padded)
    select doc_id, (i // 256)::bigint as chunk, len(t[i + 1:i + 512])::bigint as n_tokens,
           md5(array_to_string(t[i + 1:i + 512], ' ')) as tokens_md5 from c""",
)
def chunks(spark, sf):
    d = _tokens(spark, sf).select(
        "doc_id", F.posexplode(overlapping_chunks("words", 256, F.lit(PAD))).alias("chunk", "t")
    )
    return d.select(
        "doc_id",
        F.col("chunk").cast("bigint").alias("chunk"),
        F.size("t").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"),
    )
