import random

import numpy as np
import pytest
from .plain import components, exact, repeats, simhash

from pairsieve.llm import exact as EX
from pairsieve.llm import simhash as SH
from pairsieve.llm import windows as WI
from pairsieve.llm.components import connected_components
from pairsieve.session import materialise

from .conftest import rows_of


def by_key(rows):
    return sorted(rows, key=repr)


# ---- SimHash ----


def test_fingerprints(awkward):
    got = by_key((r.doc_id, r.print % (1 << 64)) for r in SH.fingerprints(awkward).collect())
    assert got == by_key((k, simhash(t)) for k, t in rows_of(awkward))


def test_hashes_are_counted_in_blocks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    monkeypatch.setattr(SH, "BLOCK", 7)
    assert SH.simhash(text) == simhash(text)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
def test_components_of_dense_fingerprints(spark, distance):
    rng, prints = random.Random(distance), []
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            prints.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)]
    stored = materialise(spark.createDataFrame(rows, "doc_id bigint, print bigint"), "test")
    found = SH._with_winner(SH._components(stored, distance), SH.F.min("doc_id"))
    assert {r.doc_id: r.best for r in found.collect()} == dict(enumerate(components(range(len(rows)), prints, distance)))


def test_links_lose_no_pair_at_any_bits(spark):
    """One pair for bits in one half, in both halves, at the edges of the blocks."""
    rng = random.Random(5)
    for bits in [(0, 1, 2), (0, 31, 32), (15, 16, 63), (31, 32, 33), (0, 32), (63,), (47, 48, 49), (1, 17, 33)]:
        a = rng.getrandbits(64)
        rows = [(int(np.uint64(x).astype(np.int64)),) for x in (a, a ^ sum(1 << b for b in bits))]
        found = SH.links(spark.createDataFrame(rows, "print bigint")).collect()
        assert {frozenset((r.a, r.b)) for r in found} == {frozenset(x for x, in rows)}, bits


def test_near_duplicates(awkward, medium, spark, nothing):
    for df in (awkward, spark.read.parquet(f"{medium}/documents.parquet").limit(300)):
        df = materialise(df, "test")
        rows = rows_of(df)
        prints = [simhash(t) for _, t in rows]
        want = [(k, f"{p:016x}", c) for (k, _), p, c in zip(rows, prints, components([k for k, _ in rows], prints, 3))]
        assert by_key(map(tuple, SH.near_duplicates(df).collect())) == by_key(want)
        kept = SH.drop_near_duplicates(df)
        assert kept.columns == df.columns
        assert kept.count() == len({(c, p if c is None else 0) for _, p, c in want})
    assert SH.near_duplicates(nothing).count() == SH.drop_near_duplicates(nothing).count() == 0
    with pytest.raises(ValueError):
        SH.near_duplicates(awkward, distance=5)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text), (9, text.replace("w7 ", "w8 ")), (4, "another thing entirely here"), (4, "another thing entirely here")]
    kept = SH.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    lowest = components([r[0] for r in rows], [simhash(t) for _, t in rows], 3)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(lowest))


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(25)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    lone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k not in lone}


# ---- exact ----


def test_exact_groups(awkward, nothing):
    got = EX.duplicate_groups(awkward, frequent=2, tracked=8).collect()
    assert by_key((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == by_key(exact(rows_of(awkward)))
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert EX.duplicate_groups(nothing).count() == EX.drop_duplicates(nothing).count() == 0


def test_frequent_texts_take_the_other_way_with_the_same_result(spark):
    rows = [(i, "Hot" if i % 3 == 0 else f"cold {i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = by_key(exact(rows))
    for frequent, tracked in ((1, 8), (16, 64), (500, 1024)):
        got = EX.duplicate_groups(df, frequent=frequent, tracked=tracked).collect()
        assert by_key((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sorted(r.doc_id for r in EX.drop_duplicates(df).collect()) == sorted({w[1] for w in want})


def test_exact_runs_without_python(spark, medium):
    df = spark.read.parquet(f"{medium}/documents.parquet")
    for plan in (EX.duplicate_groups(df), EX.drop_duplicates(df)):
        said = plan._jdf.queryExecution().toString()
        assert "Python" not in said and "Arrow" not in said and "ExistingRDD" not in said


def test_only_a_to_z_change_case(spark):
    rows = [(1, "ÉCLAIR A"), (2, "éclair a"), (3, "ÉCLAIR a"), (4, "İ"), (5, "i̇"), (6, "\u212a"), (7, "k")]
    got = {r.doc_id: r.keep_id for r in EX.duplicate_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}


# ---- substrings ----


def test_repeated_windows(awkward, nothing):
    got = WI.remove_repeats_digests(awkward).collect()
    assert by_key(map(tuple, got)) == by_key(repeats(rows_of(awkward)))
    assert WI.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("window", [2, 3, 5, 13])
def test_random_words(spark, window):
    rng = random.Random(window)
    passage = [f"p{i}" for i in range(20)]
    rows = []
    for i in range(120):
        words = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            words[5:5] = passage
        rows.append((i // 2 if i > 100 else 200 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = WI.remove_repeats_digests(df, window=window).collect()
    assert by_key(map(tuple, got)) == by_key(repeats(rows, window))


@pytest.mark.parametrize("piece", [1, 3_000, 10**9])
def test_pieces_do_not_change_the_result(spark, medium, piece):
    """A row a piece, a few rows a piece, all rows of a batch in one."""
    df = spark.read.parquet(f"{medium}/documents.parquet").limit(200)
    rows = rows_of(df)
    assert by_key(map(tuple, WI.remove_repeats_digests(df, piece_chars=piece).collect())) == by_key(repeats(rows))


@pytest.mark.parametrize("drop", [EX.drop_duplicates, SH.drop_near_duplicates])
def test_columns_named_like_helpers_stay(spark, drop):
    names = "DOC_ID bigint, TEXT string, TEXT_SHA256 string, __kept_key string, row_mark int, Row_Mark_ int, text_key int"
    df = spark.createDataFrame([(i, t, "x", "y", 1, 2, 3) for i, t in enumerate(["same words here", "same words here", None, ""])], names)
    kept = drop(df)
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.collect()) == ([1, 3] if drop is EX.drop_duplicates else [0, 2])
    assert all(tuple(r)[2:] == ("x", "y", 1, 2, 3) for r in kept.collect())


def test_gram_sizes():
    for window in range(2, 40):
        gram, grams = WI.sampling(window)
        assert gram >= 1 and gram + grams - 1 == window and grams & (grams - 1) == 0
