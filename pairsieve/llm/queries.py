"""The operators as named queries over the test tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, centroids, counting, credentials, encoding, exact, language, packing, rules, simhash, sketches, urls, windows

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

URL_RULES = (
    urls.DomainRule("net", "/", "block"),
    urls.DomainRule("example.net", "/en/", "allow"),
    urls.DomainRule("example.com", "/de/", "block"),
    urls.DomainRule("org", "/fr/", "allow"),
)
URL_GLOBS = tuple(
    urls.Glob(pattern, "block")
    for word in ("cheap-pills", "spam-farm", "casino")
    for pattern in (f"*{word}*", f"*{word}*/**")
)

ROUNDS = 20


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf))


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.duplicate_groups(documents(spark, sf))


def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(documents(spark, sf))


def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return sketches.compare_versions(documents(spark, sf))


def op5_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.round_trip(documents(spark, sf), PIECES)


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_digests(documents(spark, sf), BYTES)


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counting.token_counts(documents(spark, sf), PIECES)


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return windows.remove_repeats_digests(documents(spark, sf))


def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.secret_digests(documents(spark, sf))


def op10_urls(spark: SparkSession, sf: str) -> DataFrame:
    return urls.filter_urls(spark.read.parquet(f"{sf}/pages.parquet"), URL_RULES, URL_GLOBS)


def op11_quality(spark: SparkSession, sf: str) -> DataFrame:
    judged = rules.judge(documents(spark, sf), rounds=ROUNDS)
    base = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return judged.select(*base, F.round("quality", 4).alias("quality"))


def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align(documents(spark, sf), BYTES, PIECES)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_exact_dedup,
        op3_language,
        op4_fingerprints,
        op5_sentencepiece,
        op6_packing,
        op7_token_counts,
        op8_substring_dedup,
        op9_secrets,
        op10_urls,
        op11_quality,
        op12_centroids,
        op13_alignment,
    )
}

def quality_sql(rounds: int) -> str:
    """``op11_quality``: the counts, the votes, and the rounds of expectation-maximisation one after another."""
    each = list(enumerate(rules.RULES))
    votes = ", ".join(f"case when {r.good} then 1 when {r.bad} then -1 else 0 end as v{i}" for i, r in each)
    names = ", ".join(f"v{i}" for i, _ in each)
    odds = "ln(good / (1 - good))" + "".join(
        f" + case v{i} when 1 then ln(a{i} / (1 - b{i})) when -1 then ln((1 - a{i}) / b{i}) else 0 end" for i, _ in each
    )
    belief = rules.TIMES
    begin = f"{rules.GOOD}::double as good, " + ", ".join(f"{rules.ON_GOOD}::double as a{i}, {rules.ON_BAD}::double as b{i}" for i, _ in each)
    shares = ", ".join(
        f"(coalesce(sum(p) filter (v{i} = 1), 0) + {rules.ON_GOOD * belief}) / (coalesce(sum(p) filter (v{i} <> 0), 0) + {belief}) as a{i}, "
        f"(coalesce(sum(n - p) filter (v{i} = -1), 0) + {rules.ON_BAD * belief}) / (coalesce(sum(n - p) filter (v{i} <> 0), 0) + {belief}) as b{i}"
        for i, _ in each
    )
    steps = "".join(
        f""",
        m{k} as materialized (
            select (sum(p) + {rules.GOOD * belief}) / (sum(n) + {belief}) as good, {shares}
            from (select *, n / (1 + exp(-({odds}))) as p from patterns, m{k - 1}))"""
        for k in range(1, rounds + 1)
    )
    return rf"""
        with d as (
            select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
            from documents),
        starts as (
            select doc_id, i, array_to_string(ws[i:i + 2], ' ') as seq
            from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)),
        again as (select doc_id, i from starts qualify count(*) over (partition by doc_id, seq) > 1),
        covered as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 3)) as j from again) group by doc_id),
        counts as materialized (
            select doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
                   (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0) as n_repeat_words,
                   len(lines) as n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '{rules.WORD_LIKE}'))) as n_word_like,
                   len(list_filter(lines, lambda x: regexp_matches(x, '{rules.LINE_END.replace("'", "''")}'))) as n_ended_lines,
                   length(regexp_replace(text, '[^!?]+', '', 'g')) as n_marks,
                   length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) as n_letters,
                   length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) as n_upper
            from d left join covered using (doc_id)),
        voted as materialized (select *, {votes} from counts),
        patterns as materialized (select {names}, count(*)::double as n from voted group by all),
        m0 as materialized (select {begin}){steps},
        judged as (
            select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 1 / (1 + exp(-({odds}))) as p
            from voted, m{rounds})
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not base_failed and p >= 0.5 as kept, round(p, 4) as quality
        from judged
    """


def centroids_sql(k: int = 8, rounds: int = 10) -> str:
    """``op12_centroids``: vectors as rows of components, and the rounds one after another."""
    steps = "".join(
        f""",
        a{r} as materialized (
            select v, arg_min(c, (distance, c)) as c, min(distance) as distance
            from (select v, c, sum((vectors.x - m.x) * (vectors.x - m.x)) as distance
                  from vectors join m{r} m using (i) group by v, c) group by v),
        m{r + 1} as materialized (
            select m.c, m.i, coalesce(new.x, m.x) as x from m{r} m left join (
                select c, i, floor_div(sum(vectors.x), count(*)) as x
                from vectors join a{r} using (v) group by c, i) new on m.c = new.c and m.i = new.i)"""
        for r in range(rounds)
    )
    floor_div = lambda a, b: f"(({a}) - ((({a}) % ({b}) + ({b})) % ({b}))) // ({b})"
    steps = steps.replace("floor_div(sum(vectors.x), count(*))", f"({floor_div('sum(vectors.x)', 'count(*)')})::bigint")
    return f"""
        with kept as materialized (
            select row_number() over () as v, vec_id, embedding from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
        vectors as materialized (
            select v, i, floor(1024 * embedding[i]::double)::bigint as x from kept, range(1, 65) t(i)),
        begin as (select v, row_number() over (order by sha256('3:' || vec_id), embedding) - 1 as c from kept),
        m0 as materialized (select c, i, x from begin join vectors using (v) where c < {k}){steps},
        last as materialized (
            select v, arg_min(c, (distance, c)) as c, min(distance) as distance
            from (select v, c, sum((vectors.x - m.x) * (vectors.x - m.x)) as distance
                  from vectors join m{rounds} m using (i) group by v, c) group by v),
        said as (select c, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from m{rounds} group by c)
        select vec_id, c::integer as cluster, distance::bigint as distance,
               (sum(distance) over (partition by c))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
               centroid_sha256
        from last join kept using (v) join said using (c)
    """


SQL = {
    "op12_centroids": centroids_sql(),
    "op11_quality": quality_sql(ROUNDS),
    "op2_exact_dedup": """
        with d as (
            select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) as text_sha256
            from documents)
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id = max(doc_id) over g as kept, text_sha256
        from d window g as (partition by text_sha256)
    """,
    "op8_substring_dedup": r"""
        with w as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        starts as (
            select doc_id, i, array_to_string(ws[i:i + 12], ' ') as seq
            from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)),
        first as (select seq, min(doc_id) as lowest from starts group by seq),
        gone as (
            select doc_id, list_distinct(flatten(list(range(i, i + 13)))) as places
            from starts join first using (seq) where doc_id > lowest group by doc_id),
        kept as (
            select doc_id, len(ws) as n_words, coalesce(len(places), 0) as n_removed,
                   list_filter(ws, lambda x, i: not list_contains(coalesce(places, []), i)) as stays
            from w left join gone using (doc_id))
        select doc_id, n_words, n_removed, sha256(array_to_string(stays, ' ')) as kept_sha256 from kept
    """,
    "op10_urls": r"""
        with cut as (
            select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
            from pages),
        ruled as (
            select *, case
                when ('.' || host) like '%.example.net' and path like '/en/%' then 'example.net/en/'
                when ('.' || host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
                when ('.' || host) like '%.org' and path like '/fr/%' then 'org/fr/'
                when ('.' || host) like '%.net' and path like '/%' then 'net/' end as rule,
              case
                when host like '%cheap-pills%' then 'cheap-pills'
                when host like '%spam-farm%' then 'spam-farm'
                when host like '%casino%' then 'casino' end as word
            from cut)
        select page_id, host, path, rule,
               case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
                    when word is not null then 'block' else 'allow' end as verdict,
               case when rule is null and word is not null
                    then '*' || word || '*' || case when path = '' then '' else '/**' end end as pattern
        from ruled
    """,
}
