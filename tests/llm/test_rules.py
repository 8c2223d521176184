import math
import random

import pytest
import regex

from pairsieve.llm import rules

from .conftest import rows_of

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    """The counts of ``rules.features`` as a plain loop."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + j for places in windows.values() if len(places) > 1 for i in places for j in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
        "n_lines": len(lines),
        "n_word_like": sum(bool(regex.search(rules.WORD_LIKE, w)) for w in words),
        "n_ended_lines": sum(bool(regex.search(rules.LINE_END, line)) for line in lines),
        "n_marks": text.count("!") + text.count("?"),
        "n_letters": len(regex.findall(r"\p{L}", text)),
        "n_upper": len(regex.findall(r"\p{Lu}", text)),
    }


def fitted(votes, rounds):
    """Probability that a text with these votes is good, after expectation-maximisation over all texts one by one."""
    m = len(votes[0])
    good, a, b, belief = rules.GOOD, [rules.ON_GOOD] * m, [rules.ON_BAD] * m, rules.TIMES

    def probability(v):
        odds = math.log(good / (1 - good))
        for x, p, q in zip(v, a, b):
            odds += math.log(p / (1 - q)) if x > 0 else math.log((1 - p) / q) if x < 0 else 0
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        ps = [probability(v) for v in votes]
        good = (sum(ps) + rules.GOOD * belief) / (len(ps) + belief)

        def share(weights, i, right, start):
            hits = sum(w for w, v in zip(weights, votes) if v[i] == right)
            return (hits + start * belief) / (sum(w for w, v in zip(weights, votes) if v[i]) + belief)

        a, b = (
            [share(ps, i, 1, rules.ON_GOOD) for i in range(m)],
            [share([1 - p for p in ps], i, -1, rules.ON_BAD) for i in range(m)],
        )
    return [probability(v) for v in votes], good


def voted(n):
    return tuple(1 if _holds(r.good, n) else -1 if _holds(r.bad, n) else 0 for r in rules.RULES)


def _holds(condition, counts):
    return eval(condition, {}, counts)


def test_counts(spark, awkward, medium):
    for df in (awkward, spark.read.parquet(f"{medium}/documents.parquet").limit(300)):
        want = sorted(((k, *counted(t).values()) for k, t in rows_of(df)), key=repr)
        assert sorted(map(tuple, rules.features(df).collect()), key=repr) == want


@pytest.mark.parametrize("text, n", [("a b c", 0), ("a b c a b c", 6), ("a a a a", 4), ("a b a b a b", 6), ("a b c d a b c", 6), ("x a b c y a b c z", 6)])
def test_words_in_repeated_windows(spark, text, n):
    assert rules.features(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().n_repeat_words == n


def test_judged_as_by_a_plain_loop(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = rows_of(docs)
    counts = [counted(t) for _, t in rows]
    want, _ = fitted([voted(n) for n in counts], 20)
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    for (key, _), n, p in zip(rows, counts, want):
        failed = n["n_words"] < 50 or 100 * n["n_repeat_words"] > 50 * n["n_words"]
        assert got[key].quality == pytest.approx(p, abs=1e-9)
        assert (got[key].base_failed, got[key].kept) == (failed, not failed and p >= 0.5)


def test_clean_documents_stay_and_bad_ones_go(spark, medium):
    """By labels that the operator never sees, over the documents that do not fail anyway."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    judged = [r for r in rules.judge(spark.read.parquet(f"{medium}/documents.parquet")).collect() if r.doc_id in labels and not r.base_failed]
    clean = [r.kept for r in judged if labels[r.doc_id]]
    bad = [r.kept for r in judged if not labels[r.doc_id]]
    assert len(clean) > 200 and len(bad) > 15
    assert sum(clean) >= 0.99 * len(clean) and sum(bad) <= 0.05 * len(bad)


def test_one_odd_vote_does_not_drop_a_text(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=80)) + ".\n" for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100, good[0].replace(".\n", "")), (101, " ".join(f"{w}*** |" for w in good[1].upper().split()))]
    kept = {r.doc_id: r.quality >= 0.5 for r in rules.judge(spark.createDataFrame(rows, "doc_id int, text string"), max_repeated=100).collect()}
    assert kept[100] and not kept[101] and all(kept[i] for i in range(60))


def test_awkward_rows(awkward, nothing, spark):
    got = rules.judge(awkward).collect()
    assert sorted((repr(r.doc_id), r.n_words) for r in got) == sorted((repr(k), len(WORD.findall(t or ""))) for k, t in rows_of(awkward))
    assert all(r.base_failed and not r.kept for r in got if r.n_words == 0)
    assert rules.judge(nothing).count() == 0
    with pytest.raises(ValueError, match="at most 9"):
        rules.judge(awkward, rules.RULES * 2)


def test_no_python_in_tasks(awkward):
    plan = rules.judge(awkward)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
