import duckdb
import pytest
from .plain import base_secrets, components, exact, simhash

import corpus_pipeline
from pairsieve.llm import language
from pairsieve.llm.queries import QUERIES, SQL, documents
from pairsieve.session import materialise


def test_every_operator_is_named():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    df = QUERIES[name](spark, small)
    asked = con.execute(SQL[name])
    columns = [c[0] for c in asked.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, asked.fetchall()))


def test_stages(spark, small):
    start = documents(spark, small)
    docs, seen = start, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, small), name)
        assert docs.columns == start.columns
        seen[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in docs.collect()})

    before, after = seen["language_id"]
    learn = start.where(~language.held_out(start.doc_id))
    model = language.fit_languages(learn)
    names, _, rejected = model.predict(list(before.values()))
    assert set(after) == {k for k, r in zip(before, rejected) if not r}

    before, after = seen["exact_dedup"]
    assert set(after) == {keep for _, keep, _, _ in exact(before.items())}

    before, after = seen["near_dedup"]
    assert set(after) == set(components(list(before), [simhash(t) for t in before.values()], 3))

    before, after = seen["secret_scan"]
    assert set(after) == set(before) and not any(map(base_secrets, after.values()))
    assert {k for k in before if before[k] != after[k]} >= {k for k, t in before.items() if base_secrets(t)}

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {p.doc_id for p in pieces} == set(after)
    whole = corpus_pipeline.run(spark, small).collect()
    assert sorted((p.doc_id, p.start, p.length, p.doc_tokens) for p in whole if p.start == 0)[0][0] in after
    assert {p.doc_id: p.doc_tokens for p in whole} == {p.doc_id: p.doc_tokens for p in pieces}


def test_stages_take_awkward_rows(spark, awkward, nothing):
    shaped = awkward.select("doc_id", "text", "lang", awkward.part.alias("source"), awkward.doc_id.alias("n_chars"))
    for docs in (shaped, nothing):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, ""), name)
            if name != "packing":
                assert docs.count() <= n
                n = docs.count()
        assert {r.offset for r in docs.collect() if r.sequence_id == 0} >= ({0} if n else set())
