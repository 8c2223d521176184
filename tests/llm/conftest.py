import pytest

CLASHING = "row part ids gram grams cuts known print root range first best n text_sha256 text_key keep_id lang variant".split()


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with NULL and repeated keys, NULL, empty, blank and very long texts, and columns named like helper columns."""
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    texts = [
        (1, f"{line}\nAlpha beta. password = abcdefghijkl0123"),
        (1, f"{line}\nAlpha beta. password = abcdefghijkl0123"),
        (2, f"{line.upper()}\nother words here"),
        (3, f"start {line} end"),
        (4, None),
        (5, ""),
        (6, " \t\n\x0b "),
        (None, f"{line} and no key"),
        (None, None),
        (7, "漢字 é ñ 😀 \u2581 <s> <|endoftext|> " + "x" * 300),
        (8, ("long text of many words " * 9000) + "AKIA" + "Z" * 20),
        (9, "y" * 60_000),
        (10, "start " + line + " end"),
        (10, "another text with the same key"),
    ]
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(k, t, *[f"{c}?" for c in CLASHING]) for k, t in texts], f"doc_id bigint, text string, {names}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
