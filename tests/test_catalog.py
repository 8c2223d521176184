import duckdb
import pytest

import check
from pairsieve.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in check.TABLES.split():
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    got = check.table_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(SQL[name])
    want = check.table_of([c[0] for c in result.description], result.fetchall())
    assert got == want


def test_whole_texts_are_scored(spark, tmp_path):
    """The completions differ from the prompts behind word 48, and one text is longer than 2,048 words."""
    long, longer = " ".join(["word"] * 60), " ".join(["word"] * 2100)
    rows = [(1, 0, "user", long), (1, 1, "assistant", "a b c"), (2, 0, "user", longer), (2, 1, "assistant", "a b c")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["scoring_path_whole"](spark, str(tmp_path)).collect()}
    # Words: 60 + 3 and 60 + 60, one less as the parts meet without a space.
    assert (got[1].score_chosen, got[1].score_rejected) == (62.0, 119.0)
    assert (got[2].score_chosen, got[2].score_rejected) == (2048.0, 2048.0)
    # Both end in "word<|end|>"-like words; only the chosen side still holds the second start, 13 characters, and a, b, c.
    assert got[2].char_diff == 15.0
