"""Queries on sections, positions, noise, joins and samples."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_uniform
from ..functions.vectors import l2_norm
from ..operators import pairs as P
from ..operators import sampling as S
from ..session import materialise
from . import inputs as I
from .registry import query


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


@query(
    "pair_sides_join",
    f"""with {I.FEATS_SQL}
    select example_num, subset,
           round(sqrt(list_sum(list_transform(f_chosen, lambda x: x * x))), 6) as norm_chosen,
           round(sqrt(list_sum(list_transform(f_rejected, lambda x: x * x))), 6) as norm_rejected
    from feats""",
)
def pair_sides_join(spark, sf):
    f = I.feats(spark, sf)
    return f.select(
        "example_num", "subset", r6(l2_norm("f_chosen")).alias("norm_chosen"), r6(l2_norm("f_rejected")).alias("norm_rejected")
    )


@query(
    "section_filter",
    f"""with {I.PAIRS_SQL}, {I.SECTIONS_SQL}
    select example_num, subset, round(score_chosen, 6) + 0.0 as score_chosen, round(score_rejected, 6) + 0.0 as score_rejected
    from pairs where subset in (select subset from sections where section = 'safety')""",
)
def section_filter(spark, sf):
    kept = P.keep_section(I.pairs(spark, sf), I.sections(spark), "safety")
    return kept.select("example_num", "subset", r6("score_chosen").alias("score_chosen"), r6("score_rejected").alias("score_rejected"))


@query(
    "section_filter_keeps_all",
    f"with {I.PAIRS_SQL} select example_num, subset from pairs",
)
def section_filter_keeps_all(spark, sf):
    return P.keep_section(I.pairs(spark, sf), I.sections(spark), "").select("example_num", "subset")


@query(
    "attach_section",
    f"""with {I.FEATS_SQL}, {I.SECTIONS_SQL}
    select example_num, subset, section, example_count::bigint as example_count from feats join sections using (subset)""",
)
def attach_section(spark, sf):
    return P.attach_section(I.feats(spark, sf).select("example_num", "subset"), I.sections(spark)).select(
        "example_num", "subset", "section", "example_count"
    )


@query(
    "assign_positions",
    """select doc_id, lang, source, row_number() over (order by lang, source, doc_id) - 1 as example_num from documents""",
)
def assign_positions(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return P.assign_positions(d, ["lang", "source", "doc_id"]).select("doc_id", "lang", "source", "example_num")


INDEX_SQL = """idx as (
  select (event_id * 7919) % (select count(*) from feats) as example_num, event_id as ord from events)"""


@query(
    "take_positions",
    f"""with {I.FEATS_SQL}, {INDEX_SQL}
    select ord, example_num, subset, round(f_diff[1], 6) + 0.0 as first_component from idx join feats using (example_num)""",
)
def take_positions(spark, sf):
    """Every event asks for one example, so examples repeat."""
    feats = I.feats(spark, sf).select("example_num", "subset", F.get("f_diff", F.lit(0)).alias("first_component"))
    n = feats.count()
    index = I.table(spark, sf, "events").select(
        ((F.col("event_id") * 7919) % n).alias("example_num"), F.col("event_id").alias("ord")
    )
    return P.take_positions(feats, index).select(
        "ord", "example_num", "subset", r6("first_component").alias("first_component")
    )


def _corrections(spark, sf):
    text = F.col("text")
    return I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("example_num"),
        text.alias("sentence"),
        F.array(F.concat(text, F.lit(" .")), F.lower(text), F.upper(text), F.col("source")).alias("corrections"),
    )


@query(
    "first_annotation",
    "select doc_id as example_num, text || ' .' as preferred, text as dispreferred from documents",
)
def first_annotation(spark, sf):
    return P.to_preference(_corrections(spark, sf), "jhu-clsp/jfleg", keep=["example_num"])


@query(
    "correction_columns",
    "select doc_id as example_num, text as preferred, source || ' ' || lang as dispreferred from documents",
)
def correction_columns(spark, sf):
    d = I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("example_num"), F.concat_ws(" ", "source", "lang").alias("input"), F.col("text").alias("target")
    )
    return P.to_preference(d, "Owishiboo/grammar-correction", keep=["example_num"])


UNIFORM_SQL = "('0x' || substr(md5('{seed}|' || {key}), 1, 8))::bigint / 4294967296.0"


@query(
    "label_noise",
    f"""select conv_id, turn, is_swapped::int as is_swapped,
           case when is_swapped then dispreferred else preferred end as preferred,
           case when is_swapped then preferred else dispreferred end as dispreferred
    from (select conv_id, turn, completion as preferred, prompt as dispreferred,
                 {UNIFORM_SQL.format(seed=42, key="conv_id || '-' || turn")} < 0.25 as is_swapped
          from (with {I.PROMPTS_SQL} select * from prompts))""",
)
def label_noise(spark, sf):
    p = I.prompts(spark, sf).select(
        "conv_id",
        "turn",
        F.concat_ws("-", "conv_id", "turn").alias("example_num"),
        F.col("completion").alias("preferred"),
        F.col("prompt").alias("dispreferred"),
    )
    return P.swap_with_noise(p, 0.25, seed=42).select(
        "conv_id", "turn", F.col("is_swapped").cast("int").alias("is_swapped"), "preferred", "dispreferred"
    )


REDUNDANT_SQL = UNIFORM_SQL.format(seed=7, key="example_num") + " < 0.6"


def _redundant_keys(df):
    """A stand-in redundant set: a seeded 60 % of the examples."""
    return df.where(seeded_uniform(7, "example_num") < 0.6).select("example_num")


@query(
    "redundant_part",
    f"with {I.PAIRS_SQL} select example_num, subset from pairs where {REDUNDANT_SQL}",
)
def redundant_part(spark, sf):
    p = I.pairs(spark, sf)
    return P.redundant_part(p, _redundant_keys(p)).select("example_num", "subset")


@query(
    "non_redundant_part",
    f"with {I.PAIRS_SQL} select example_num, subset from pairs where not ({REDUNDANT_SQL})",
)
def non_redundant_part(spark, sf):
    p = I.pairs(spark, sf)
    return P.non_redundant_part(p, _redundant_keys(p)).select("example_num", "subset")


@query(
    "attach_labels",
    """select doc_id as example_num, lang, quality as subset
       from documents left join labels using (doc_id)""",
)
def attach_labels(spark, sf):
    scored = I.table(spark, sf, "documents").select(F.col("doc_id").alias("example_num"), "lang")
    labels = I.table(spark, sf, "labels").select(F.col("doc_id").alias("example_num"), F.col("quality").alias("subset"))
    return P.attach_labels(scored, labels)


@query(
    "label_coverage",
    """select count(*) as n_scored, count(quality) as n_labelled, (count(*) = count(quality))::int as is_complete
       from documents left join labels using (doc_id)""",
)
def label_coverage(spark, sf):
    return P.label_coverage(attach_labels(spark, sf)).withColumn("is_complete", F.col("is_complete").cast("int"))


@query(
    "proportional_labels",
    f"""with {I.FEATS_SQL}, {I.SECTIONS_SQL},
    l as (select subset, example_count, row_number() over (order by subset) as ord from sections),
    a as (select subset, ord,
                 sum(floor(example_count::double / (select sum(example_count) from l)::double * (select count(*) from feats)))
                   over (order by ord) as stop from l)
    select f.example_num,
           coalesce((select min_by(a.subset, a.ord) from a where a.stop > f.example_num),
                    (select min_by(subset, ord) from l)) as subset
    from feats f""",
)
def proportional_labels(spark, sf):
    labels = I.sections(spark).withColumn("ord", F.col("subset"))
    return P.allocate_labels(I.feats(spark, sf).select("example_num"), labels).select("example_num", "subset")


@query(
    "union_of_sections",
    f"""with {I.PAIRS_SQL}, {I.SECTIONS_SQL}
    select section, count(*) as n_pairs, sum((score_chosen > score_rejected)::int)::bigint as n_correct
    from pairs join sections using (subset) group by section""",
)
def union_of_sections(spark, sf):
    """One accuracy row per section, each from its own filter, united."""
    from ..operators.metrics import pair_accuracy

    dims = I.sections(spark)
    names = sorted({s for s, _, _ in I.SECTIONS})
    parts = [
        pair_accuracy(P.keep_section(I.pairs(spark, sf), dims, s)).select(F.lit(s).alias("section"), "n_pairs", "n_correct")
        for s in names
    ]
    return P.union_sections(parts)


@query("distinct_subsets", "select distinct label as subset from embeddings")
def distinct_subsets(spark, sf):
    return P.subset_names(I.table(spark, sf, "embeddings").withColumnRenamed("label", "subset"))


@query(
    "random_sample",
    "select doc_id, lang from documents order by md5('42|' || doc_id), doc_id limit (select count(*) // 3 from documents)",
)
def random_sample(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", "lang")
    marked = S.mark_sample(d, F.floor(F.col("n") / 3), ["doc_id"])
    return marked.where("is_sampled").select("doc_id", "lang")


@query(
    "random_sample_by_group",
    """select doc_id, lang from (
         select doc_id, lang, row_number() over (partition by lang order by md5('42|' || lang || '|' || doc_id), doc_id) as r,
                count(*) over (partition by lang) as n from documents)
       where r <= n // 4""",
)
def random_sample_by_group(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", "lang")
    marked = S.mark_sample(d, F.floor(F.col("n") / 4), ["doc_id"], by=["lang"])
    return marked.where("is_sampled").select("doc_id", "lang")


@query(
    "train_validation_split",
    """select doc_id, case when r <= ceil(n * 0.1) then 'validation' else 'train' end as part from (
         select doc_id, row_number() over (order by md5('42|' || doc_id), doc_id) as r, count(*) over () as n from documents)""",
)
def train_validation_split(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id")
    return S.split_train_validation(d, 0.1, ["doc_id"])


@query(
    "shuffled_order",
    "select doc_id, row_number() over (order by md5('42|3|' || doc_id), doc_id) - 1 as place from documents",
)
def shuffled_order(spark, sf):
    """The place of every document in epoch 3's order: rows are numbered as ``shuffled`` hands them out."""
    order = S.shuffled(I.table(spark, sf, "documents").select("doc_id"), 3, ["doc_id"])
    row = F.monotonically_increasing_id()
    placed = order.select("doc_id", F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("rank"))
    placed = materialise(placed, "order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("rank")).alias("place"))
