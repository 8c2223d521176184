import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsieve.catalog import inputs as I
from pairsieve.functions.vectors import fit_quality
from pairsieve.operators.metrics import correct_pairs
from pairsieve.operators.pairs import attach_section
from pairsieve.operators.scoring import LinearScorer, score_pairs
from pairsieve.redundancy import kernels, pricing, search, sieve
from pairsieve.redundancy.fits import fit_rows
from pairsieve.redundancy.search import find_redundancy, half_space_redundancy, sweep_redundancy
from pairsieve.redundancy.sieve import Spec

from sequential import (
    cone_residual,
    cone_residual_by_supports,
    greedy,
    half_space_greedy,
    simplex_minimum,
    span_residual,
)

# Small tails and blocks drive the search through screening, scanning and several blocks.
TIGHT = {"tail_rows": 5, "block_rows": 8}


def frame(spark, rows, partitions=3):
    data = [(i * 3 + 1, [float(v) for v in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "example_num bigint, f_diff array<double>").repartition(partitions)


def found(df, rows):
    result = df.select("example_num", "is_redundant").collect()
    assert len(result) == len(rows) and len({r.example_num for r in result}) == len(rows)
    return sorted((r.example_num - 1) // 3 for r in result if r.is_redundant)


def differences(spark, sf, d):
    rows = I.feats(spark, sf).orderBy("example_num").select("f_diff").collect()
    return np.array([r.f_diff for r in rows])[:, :d]


def pointed(seed, n, d, copies=0):
    """Rows with a common direction, so that many are extreme; some exact and near copies."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, d)) + 1.5 * np.eye(d)[0]
    for _ in range(copies):
        i, j = rng.integers(0, n, 2)
        rows[i] = rows[j] * rng.uniform(0.5, 2) + rng.choice([0, 1e-4]) * rng.normal(size=d)
    return rows


# Expected counts: differences of the test embeddings at sf0.01, 250 rows.
COUNTS = {
    16: {("lstsq", 0.95): 235, ("lstsq", 0.8): 238, ("lstsq", 0.6): 242, ("nnls", 0.95): 233, ("nnls", 0.8): 234, ("nnls", 0.6): 235},
    64: {("lstsq", 0.95): 192, ("lstsq", 0.8): 204, ("lstsq", 0.6): 215, ("nnls", 0.95): 180, ("nnls", 0.8): 187},
    8: {("lstsq", 0.95): 242, ("lstsq", 0.8): 244, ("nnls", 0.95): 242, ("nnls", 0.8): 242},
}


@pytest.mark.parametrize("d", COUNTS)
def test_counts_on_test_embeddings(spark, medium, d):
    specs = [Spec(solver, "r2", threshold) for solver, threshold in COUNTS[d]]
    result = sweep_redundancy(I.feats(spark, medium), specs, components=d)
    counts = result.where("is_redundant").groupBy("solver", "threshold").count().collect()
    assert {(r.solver, r.threshold): r["count"] for r in counts} == COUNTS[d]


def test_counts_at_a_thousand_rows(spark):
    """The tail is a small part here, so most rows are decided without a fit."""
    feats = I.feats(spark, "/root/testdata/sf0.1")
    assert find_redundancy(feats, solver="lstsq").where("is_redundant").count() == 942
    assert find_redundancy(feats, components=16).where("is_redundant").count() == 983
    assert find_redundancy(feats, components=32).where("is_redundant").count() == 965


@pytest.mark.parametrize("solver,threshold", [("nnls", 0.95), ("nnls", 0.7), ("lstsq", 0.95), ("lstsq", 0.5)])
@pytest.mark.parametrize("seed,copies", [(1, 0), (2, 25)])
def test_equals_sequential_search(spark, solver, threshold, seed, copies):
    rows = pointed(seed, 45, 5, copies)
    result = find_redundancy(frame(spark, rows), solver=solver, threshold=threshold, **TIGHT)
    assert found(result, rows) == greedy(rows, solver, threshold)


def test_many_screening_rounds(spark):
    rows = pointed(5, 90, 5, 40)
    result = find_redundancy(frame(spark, rows, 6), threshold=0.9, tail_rows=4, block_rows=10)
    assert found(result, rows) == greedy(rows, "nnls", 0.9)


def test_kept_rows_beyond_driver_memory(spark, monkeypatch):
    monkeypatch.setattr(sieve, "KEPT_IN_MEMORY", 3)
    monkeypatch.setattr(sieve, "FLUSH_ROWS", 4)
    rows = pointed(8, 45, 5, 10)
    result = find_redundancy(frame(spark, rows), threshold=0.9, **TIGHT)
    assert found(result, rows) == greedy(rows, "nnls", 0.9)


@pytest.mark.parametrize("solver", ["nnls", "lstsq"])
def test_residual_mode(spark, solver):
    rng = np.random.default_rng(4)
    rows = np.vstack([rng.normal(size=(20, 3)) @ rng.normal(size=(3, 6)), rng.normal(size=(6, 6)), np.zeros((2, 6))])
    rows = rows[rng.permutation(len(rows))]
    result = find_redundancy(frame(spark, rows), solver=solver, solve_by="res", **TIGHT)
    assert found(result, rows) == greedy(rows, solver, solve_by="res")


def test_residual_mode_pointed(spark):
    rng = np.random.default_rng(6)
    corners = rng.normal(size=(8, 4)) + 3 * np.eye(4)[0]
    rows = np.vstack([corners, rng.uniform(size=(25, 8)) @ corners])[rng.permutation(33)]
    result = find_redundancy(frame(spark, rows), solve_by="res", **TIGHT)
    assert found(result, rows) == greedy(rows, "nnls", solve_by="res")


def test_a_third_of_the_rows_are_copies(spark):
    rng = np.random.default_rng(9)
    rows = pointed(9, 75, 4)
    hot = rng.random(len(rows)) < 0.35
    rows[hot] = rows[0] + 1e-5 * rng.normal(size=(hot.sum(), 4))
    for solver in ("nnls", "lstsq"):
        result = find_redundancy(frame(spark, rows), solver=solver, threshold=0.95, **TIGHT)
        assert found(result, rows) == greedy(rows, solver, 0.95)


def test_groups_are_separate_problems(spark):
    rng = np.random.default_rng(11)
    rows = pointed(11, 90, 5, 15)
    groups = rng.choice(["a", "b", "c", None], size=len(rows), p=[0.6, 0.2, 0.15, 0.05])
    data = [(i, groups[i], [float(v) for v in r]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "example_num bigint, part string, f_diff array<double>")
    specs = [Spec("nnls", "r2", 0.9), Spec("lstsq", "r2", 0.9), Spec("nnls", "r2", 0.6)]
    result = sweep_redundancy(df, specs, group_by=["part"], **TIGHT).collect()
    for spec in specs:
        for group in ("a", "b", "c", None):
            members = [i for i in range(len(rows)) if groups[i] == group]
            want = {members[j] for j in greedy(rows[members], spec.solver, spec.threshold)}
            got = {r.example_num for r in result if r.part == group and r.solver == spec.solver and r.threshold == spec.threshold and r.is_redundant}
            assert got == want, (spec, group)


def test_sections_of_test_embeddings(spark, medium):
    sectioned = attach_section(I.feats(spark, medium), I.sections(spark)).cache()
    result = find_redundancy(sectioned, group_by=["section"], components=16, tail_rows=24, block_rows=16).collect()
    for section in ("chat", "chat_hard", "safety", "reasoning"):
        rows = sectioned.where(F.col("section") == section).orderBy("example_num").select("example_num", "f_diff").collect()
        keys = [r.example_num for r in rows]
        want = {keys[i] for i in greedy(np.array([r.f_diff[:16] for r in rows]), "nnls")}
        assert {r.example_num for r in result if r.section == section and r.is_redundant} == want


def test_order_of_groups_in_memory_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(search, "TAIL_BYTES", 1)
    rows = pointed(13, 40, 4)
    data = [(i, i % 3, [float(v) for v in r]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "example_num bigint, part int, f_diff array<double>")
    result = find_redundancy(df, group_by=["part"], threshold=0.9, **TIGHT).collect()
    for part in range(3):
        members = [i for i in range(40) if i % 3 == part]
        want = {members[j] for j in greedy(rows[members], "nnls", 0.9)}
        assert {r.example_num for r in result if r.part == part and r.is_redundant} == want


# ---- fit values ----


def final_values(rows, dropped, residual):
    """The value of each row on all later and the kept earlier rows."""
    unit = rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-12)
    out = []
    for i, y in enumerate(unit):
        left = residual(unit[[j for j in range(len(unit)) if j > i or (j < i and j not in dropped)]], y)
        out.append(1 - left / np.sum((y - y.mean()) ** 2))
    return out


@pytest.mark.parametrize("solver, residual", [("nnls", cone_residual_by_supports), ("lstsq", span_residual)])
def test_values_are_those_of_the_final_basis(spark, solver, residual):
    rows = pointed(21, 60, 5, 10)
    want = final_values(rows, greedy(rows, solver, 0.9), residual)
    for options in ({}, TIGHT, {"tail_rows": 3, "block_rows": 3}, {"tail_rows": 40}):
        result = find_redundancy(frame(spark, rows), solver=solver, threshold=0.9, **options).orderBy("example_num").collect()
        assert [r.r2_score for r in result] == pytest.approx(want, abs=1e-7), options


def test_values_with_more_kept_rows_than_the_driver_holds(spark, monkeypatch):
    monkeypatch.setattr(sieve, "KEPT_IN_MEMORY", 3)
    rows = pointed(8, 45, 5, 10)
    want = final_values(rows, greedy(rows, "nnls", 0.9), cone_residual_by_supports)
    result = find_redundancy(frame(spark, rows), threshold=0.9, **TIGHT).orderBy("example_num").collect()
    assert [r.r2_score for r in result] == pytest.approx(want, abs=1e-7)


def test_values_can_be_left_out(spark):
    rows = pointed(8, 20, 4)
    result = find_redundancy(frame(spark, rows), threshold=0.9, values=False)
    assert found(result, rows) == greedy(rows, "nnls", 0.9) and result.where("r2_score is not null").count() == 0


def test_half_space_minimum_of_every_row(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(24, 3)) + 0.6
    dropped = half_space_greedy(rows)
    want = [simplex_minimum(c, rows[[j for j in range(24) if j > i or (j < i and j not in dropped)]]) for i, c in enumerate(rows)]
    for options in ({}, {"tail_rows": 4, "block_rows": 5}):
        result = half_space_redundancy(frame(spark, rows), **options).orderBy("example_num").collect()
        assert [r.min_value for r in result] == pytest.approx(want, abs=1e-6)


def test_a_tail_is_solved_in_several_tasks(spark, monkeypatch):
    """Fewer rows than a tail: no round leaves all open rows to one task."""
    asked = []
    solve = sieve.Sieve._solve

    def watched(self, problems, runs):
        open_rows = sum(t.redundant is None for p in problems for t in p.block)
        asked.append((open_rows, min(sieve.RUN_ROWS, open_rows) if runs else 1))
        return solve(self, problems, runs)

    monkeypatch.setattr(sieve.Sieve, "_solve", watched)
    rows = pointed(2, 60, 16)
    find_redundancy(frame(spark, rows), threshold=0.9, group_rows=0).count()  # groups this small are decided in tasks otherwise
    assert asked[0] == (60, sieve.RUN_ROWS) and all(run <= sieve.RUN_ROWS for _, run in asked)


# ---- edge cases ----


@pytest.mark.parametrize("bad", [[float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [None, 1.0, 1.0], None])
def test_vectors_must_be_finite(spark, bad):
    data = [(0, [2.0, 3.0, 5.0]), (1, [1.0, 2.0, 4.0]), (2, bad)]
    df = spark.createDataFrame(data, "example_num bigint, f_diff array<double>")
    for search_rows in (find_redundancy, half_space_redundancy):
        with pytest.raises(ValueError, match="1 vectors"):
            search_rows(df)


def verdicts(spark, rows, **kw):
    out = find_redundancy(frame(spark, np.array(rows, dtype=float), 1), **kw).orderBy("example_num").collect()
    return out


def test_zero_difference_is_redundant(spark):
    out = verdicts(spark, [[0, 0, 0], [1, 2, 3], [3, 1, 0]])
    assert out[0].is_redundant and out[0].is_zero and out[0].r2_score == 1.0
    alone = verdicts(spark, [[0, 0, 0]])
    assert alone[0].is_redundant


def test_copies_and_multiples(spark):
    for first, second in ([1, 2, 3], [1, 2, 3]), ([1, 2, 3], [2, 4, 6]):
        for solver in ("nnls", "lstsq"):
            assert [r.is_redundant for r in verdicts(spark, [first, second], solver=solver)] == [True, False]
    opposite = [[1, 2, 3], [-1, -2, -3]]
    assert [r.is_redundant for r in verdicts(spark, opposite, solver="lstsq")] == [True, False]
    assert [r.is_redundant for r in verdicts(spark, opposite, solver="nnls")] == [False, False]


def test_constant_rows_are_kept_and_used(spark):
    rows = [[1, 1, 1], [2, 2, 2], [5, 5, 5.2], [-3, -3, -3]]
    out = verdicts(spark, rows)
    assert [r.is_redundant for r in out][:2] == [False, False] and not out[3].is_redundant
    assert out[0].r2_score == 0.0
    # Constant rows before and after count as basis rows.
    mixed = np.array([[1, 1, 1], [2, 1, 1], [3, 1, 1], [0, 1, 2], [1, 2, 3]], dtype=float)
    for solver in ("nnls", "lstsq"):
        got = [i for i, r in enumerate(verdicts(spark, mixed, solver=solver)) if r.is_redundant]
        assert got == greedy(mixed, solver, 0.95)


def test_keys_must_identify_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [2.0, 1.0])], "example_num bigint, f_diff array<double>")
    with pytest.raises(ValueError, match="identify"):
        find_redundancy(df)
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 1.0])], "example_num bigint, f_diff array<double>")
    with pytest.raises(ValueError, match="NULL"):
        find_redundancy(df)
    df = spark.createDataFrame([(2, [1.0]), (1, [2.0, 1.0])], "example_num bigint, f_diff array<double>")
    with pytest.raises(ValueError, match="length"):
        find_redundancy(df)


def test_scaling_rows_changes_nothing(spark):
    rows = pointed(21, 40, 5)
    scale = np.random.default_rng(1).uniform(0.1, 10, size=(40, 1))
    a = found(find_redundancy(frame(spark, rows), **TIGHT), rows)
    assert a == found(find_redundancy(frame(spark, rows * scale), **TIGHT), rows)


def test_staged_rows_give_the_same(spark):
    rows = pointed(22, 40, 5)
    assert found(find_redundancy(frame(spark, rows), stage=True, **TIGHT), rows) == greedy(rows, "nnls")


def test_no_rows(spark):
    empty = spark.createDataFrame([], "example_num bigint, f_diff array<double>")
    assert find_redundancy(empty).count() == 0


# ---- half-spaces ----


@pytest.mark.parametrize("seed", range(4))
def test_half_space_equals_sequential_programmes(spark, seed):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(22, 3))
    rows *= np.sign(rows @ np.array([0.2, 0.5, 0.3]))[:, None]  # a point of the simplex meets them all
    result = half_space_redundancy(frame(spark, rows), tail_rows=4, block_rows=4)
    assert found(result, rows) == half_space_greedy(rows)
    assert 0 < len(half_space_greedy(rows)) < len(rows)


@pytest.mark.parametrize("held", [8 * 3 * 4, 1 << 20])
def test_half_spaces_are_decided_at_once(spark, monkeypatch, held):
    """No block of rows is loaded, whether tasks hold all rows or a few, and copies and near copies are decided as in order."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(20, 3))
    rows *= np.sign(rows @ np.array([0.2, 0.5, 0.3]))[:, None]
    rows = np.vstack([rows, rows[4:9], rows[9:12] + 1e-8])
    loaded = []
    monkeypatch.setattr(sieve, "PROGRAMME_BYTES", held)
    monkeypatch.setattr(sieve.Sieve, "_next_blocks", lambda self, *a, f=sieve.Sieve._next_blocks: loaded.append(1) or f(self, *a))
    dropped = half_space_greedy(rows)
    want = [simplex_minimum(c, rows[[j for j in range(28) if j > i or (j < i and j not in dropped)]]) for i, c in enumerate(rows)]
    result = half_space_redundancy(frame(spark, rows), tail_rows=4, block_rows=1).orderBy("example_num").collect()
    assert [i for i, r in enumerate(result) if r.is_redundant] == dropped and not loaded
    assert [r.min_value for r in result] == pytest.approx(want, abs=1e-6)


def test_programmes_on_some_rows_at_a_time():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(2 * kernels.PRICED, 6)) + 2.0
    usable = rng.random(len(rows)) < 0.8
    for cost in rng.normal(size=(20, 6)):
        low, w = kernels.simplex_minimum(cost, rows, usable)
        some = np.flatnonzero(usable)
        parts = [kernels.simplex_minimum(cost, rows[some[i::3]])[0] for i in range(3)]
        assert (rows[usable] @ w).min() > -1e-9 and abs(cost @ w - low) < 1e-9 and low >= max(parts) - 1e-9
        tight = some[rows[some] @ w < 1e-7]
        assert kernels.simplex_minimum(cost, rows[tight])[0] == pytest.approx(low, abs=1e-8)


def test_programmes_side_by_side():
    """As one by one, whatever ends first; and going on with more rows from where they ended is as starting anew."""
    rng = np.random.default_rng(7)
    for d in (2, 3, 6):
        rows = rng.normal(size=(90, 12, d)) + 1.0
        rows[::4] = np.round(rows[::4] - 0.8)
        costs = np.round(rng.normal(size=(90, d)), 1)
        bases = kernels.slack_basis(costs)
        for some in (0, 5, 12):
            points, feasible = kernels.simplex_minima(costs, rows[:, :some], bases)
            for i, cost in enumerate(costs):
                low, _ = kernels.simplex_minimum(cost, rows[i, :some])
                assert feasible[i] == (low is not None)
                assert low is None or (abs(cost @ points[i] - low) < 1e-8 and (rows[i, :some] @ points[i] > -1e-9).all())
        assert 0 < feasible.sum() < 90


@pytest.mark.parametrize("held", [8 * 3 * 16, 1 << 20])
def test_half_spaces_take_a_programme_a_row(spark, monkeypatch, held):
    """Rows meet the table in pieces, not in joins; and hardly any row needs a second programme for its decision or its value."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(30, 3))
    rows *= np.sign(rows @ np.array([0.2, 0.5, 0.3]))[:, None]
    rows = np.vstack([rows, rows[3:6]])
    asked = []
    solve = sieve.solve_programmes
    monkeypatch.setattr(sieve, "PROGRAMME_BYTES", held)
    monkeypatch.setattr(sieve.pricing, "_price", None)
    monkeypatch.setattr(sieve, "solve_programmes", lambda targets, *a: asked.append(targets.count()) or solve(targets, *a))
    dropped = half_space_greedy(rows)
    want = [simplex_minimum(c, rows[[j for j in range(33) if j > i or (j < i and j not in dropped)]]) for i, c in enumerate(rows)]
    result = half_space_redundancy(frame(spark, rows), tail_rows=4, block_rows=1).orderBy("example_num").collect()
    assert [i for i, r in enumerate(result) if r.is_redundant] == dropped and 0 < len(dropped) < 33
    assert [r.min_value for r in result] == pytest.approx(want, abs=1e-6)
    assert asked[0] == 30 and sum(asked[1:]) < 30


def test_half_space_infeasible_keeps_everything(spark):
    rows = np.array([[-1.0, -2.0], [-1.0, -1.0], [0.5, 1.0], [3.0, -1.0]])
    assert half_space_greedy(rows) == []
    assert found(half_space_redundancy(frame(spark, rows), tail_rows=1, block_rows=2), rows) == []


def test_half_space_on_test_embeddings(spark, medium):
    scorer = LinearScorer((1.0, 1.0, 1.0) + (0.0,) * 61)
    scored = score_pairs(I.feats(spark, medium), scorer, keep=("example_num", "subset", "f_diff"))
    picked = correct_pairs(scored).orderBy("example_num").select("example_num", "f_diff").collect()
    keys, rows = [r.example_num for r in picked], np.array([r.f_diff[:3] for r in picked])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in zip(keys, rows)], "example_num bigint, f_diff array<double>")
    got = {r.example_num for r in half_space_redundancy(df, tail_rows=10, block_rows=8).where("is_redundant").collect()}
    # Enumerating vertices of 120 rows is slow; only the rows that survive a two-sided check need it.
    from pairsieve.redundancy.kernels import simplex_minimum

    dropped = []
    for i in range(len(rows)):
        others = [j for j in range(len(rows)) if j != i and j not in dropped]
        low, _ = simplex_minimum(rows[i] + 0.01, rows[others] + 0.01)
        if low is not None and round(low - 0.01, 6) >= -0.01:
            dropped.append(i)
    assert got == {keys[i] for i in dropped}


# ---- fits against a basis table ----


def test_pricing_in_blocks_and_parts(spark, monkeypatch):
    """Many small blocks and parts: several tasks find rows for one target, and one part serves several blocks."""
    rng = np.random.default_rng(12)
    basis, targets = rng.normal(size=(60, 4)) + np.eye(4)[0], rng.normal(size=(30, 4))
    monkeypatch.setattr(pricing, "BLOCK_ROWS", 7)
    monkeypatch.setattr(pricing, "PART_ROWS", 11)
    out = fit_rows(frame(spark, targets), frame(spark, basis), "nnls", pool_rows=2).collect()
    assert len(out) == 30
    for r in out:  # no basis row leads further, and what is left is orthogonal to the fit
        fit = np.array(r.reconstruction)
        left = targets[(r.example_num - 1) // 3] - fit
        assert (basis @ left).max() < 1e-6 and abs(fit @ left) < 1e-6 and abs(r.residual - np.linalg.norm(left)) < 1e-9


@pytest.mark.parametrize("start", [5, 8192])
def test_fits_on_start_rows_are_those_of_the_whole_basis(spark, monkeypatch, start):
    """Where the rows that tasks hold reach every target, the table is never joined; else the fits go on in it."""
    rng = np.random.default_rng(12)
    basis, targets = rng.normal(size=(80, 4)), rng.normal(size=(30, 4))
    joined = []
    monkeypatch.setattr(pricing, "START_ROWS", start)
    monkeypatch.setattr(pricing, "_price", lambda *a, f=pricing._price: joined.append(1) or f(*a))
    out = fit_rows(frame(spark, targets), frame(spark, basis), "nnls", pool_rows=2).collect()
    assert len(out) == 30 and max(r.residual for r in out) < 1e-9
    for r in out:
        again = sum(c.coefficient * basis[(c.basis_key - 1) // 3] for c in r.coefficients)
        assert np.allclose(again, targets[(r.example_num - 1) // 3]) and all(c.coefficient >= 0 for c in r.coefficients)
    assert bool(joined) == (start == 5)


def test_values_of_open_rows_never_come_to_the_driver(spark, monkeypatch):
    """Beyond the tail no vector is collected for a fit value: the search may look at blocks, the values may not."""
    seen = []
    rows = pointed(3, 60, 5)
    monkeypatch.setattr(sieve.Sieve, "_next_blocks", lambda self, *a, f=sieve.Sieve._next_blocks: seen.append(1) or f(self, *a))
    values = find_redundancy(frame(spark, rows), threshold=0.9, **TIGHT)
    searched = len(seen)
    found_values = {r.example_num: r.r2_score for r in values.collect()}
    none = find_redundancy(frame(spark, rows), threshold=0.9, values=False, **TIGHT)
    assert len(seen) == 2 * searched and none.where("r2_score is not null").count() == 0
    assert len(found_values) == 60 and all(v is not None for v in found_values.values())


@pytest.mark.parametrize("solver,solve_by", [("nnls", "r2"), ("lstsq", "r2"), ("nnls", "res"), ("lstsq", "res"), ("linprog", "r2")])
def test_groups_decided_in_tasks_are_those_of_the_search(spark, solver, solve_by):
    """The same decisions and values whether a task decides a group or the search does."""
    rng = np.random.default_rng(8)
    data = []
    for g in range(12):
        n = int(rng.integers(1, 30))
        rows = np.abs(pointed(g, n, 4, copies=3)) if solver == "linprog" else pointed(g, n, 4, copies=3)
        rows[0] = 0.5  # a constant row
        data += [(g % 5 if g < 10 else None, f"{g}", 7 * i + g, [float(v) for v in r]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "part int, name string, example_num bigint, f_diff array<double>").repartition(4)

    def run(**options):
        if solver == "linprog":
            out = half_space_redundancy(df, group_by=["part", "name"], **options)
            value = "min_value"
        else:
            out = find_redundancy(df, group_by=["part", "name"], solver=solver, solve_by=solve_by, threshold=0.8, **options)
            value = "residual" if solve_by == "res" else "r2_score"
        return {(r.part, r.name, r.example_num): (r.is_redundant, r[value]) for r in out.collect()}

    whole, some, none = run(), run(group_rows=12), run(group_rows=0, tail_rows=4)
    assert len(whole) == len(data) and whole.keys() == some.keys() == none.keys()
    for key, (redundant, value) in whole.items():
        for other in (some, none):
            assert other[key][0] == redundant
            assert (value is None and other[key][1] is None) or abs(other[key][1] - value) < 1e-6 * max(1.0, abs(value))


def test_many_groups_take_as_many_jobs_as_few(spark):
    context = spark.sparkContext
    counts = []
    for n in (3, 300):
        data = [(g, i, [float(i + 1), float(g % 7), 1.0 / (i + 1 + g)]) for g in range(n) for i in range(4)]
        df = spark.createDataFrame(data, "part int, example_num bigint, f_diff array<double>").repartition(3)
        context.setJobGroup(f"groups {n}", "")
        assert find_redundancy(df, group_by=["part"]).count() == 4 * n
        counts.append(len(context.statusTracker().getJobIdsForGroup(f"groups {n}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert abs(counts[0] - counts[1]) <= 2


@pytest.mark.parametrize("seed", range(4))
def test_half_space_bounded_from_above(spark, seed):
    """Components above the bound of 100,000: the bound cuts the simplex, also where only a scan finds the row that does."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(24, 3)) * 0.2 + 0.25
    rows[rng.integers(0, 24, 6)] *= rng.choice([3e5, 1e6, -2e5], size=(6, 1))
    rows[seed] = [2e5, 0.1, 0.2]
    for options in ({}, {"tail_rows": 4, "block_rows": 5}):
        result = half_space_redundancy(frame(spark, rows), **options)
        assert found(result, rows) == half_space_greedy(rows)


def test_a_bound_from_above_decides(spark):
    """(1, −1) has its minimum −1 at (0, 1), which (0, 400,000) forbids: w₂ ≤ 1/4, so the minimum is 1/2."""
    rows = np.array([[1.0, -1.0], [0.0, 4e5]])
    got = {r.example_num: r for r in half_space_redundancy(frame(spark, rows)).collect()}
    assert got[1].is_redundant and abs(got[1].min_value - 0.5) < 1e-6


def test_a_fit_that_does_not_converge_is_an_error(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(kernels, "STEPS", 0)
    with pytest.raises(ArithmeticError, match="converge"):
        kernels.nnls(rng.normal(size=(30, 5)), rng.normal(size=5))


@pytest.mark.parametrize("method", ["nnls", "lstsq"])
def test_fit_rows_whatever_is_held_at_once(spark, method):
    rng = np.random.default_rng(2)
    basis, targets = rng.normal(size=(17, 5)) + np.eye(5)[0], rng.normal(size=(23, 5))
    basis[3] = basis[1] * 2
    targets[7] = 0.0
    b, t = frame(spark, basis), frame(spark, targets)
    residual = cone_residual if method == "nnls" else span_residual
    for options in ({}, {"pool_rows": 1}, {"pool_rows": 6}):
        out = fit_rows(t, b, method, **options).collect()
        assert len(out) == len(targets)
        for r in out:
            y = targets[(r.example_num - 1) // 3]
            assert abs(r.residual**2 - residual(basis, y)) < 1e-7
            assert abs(r.mse - residual(basis, y) / 5) < 1e-7
            if y.any():
                assert abs(r.r2_score - (1 - residual(basis, y) / np.sum((y - y.mean()) ** 2))) < 1e-6
            again = sum((c.coefficient * basis[(c.basis_key - 1) // 3] for c in r.coefficients), 0 * y)
            assert np.allclose(again, r.reconstruction)
            assert method == "lstsq" or all(c.coefficient >= 0 for c in r.coefficients)


@pytest.mark.parametrize("method", ["nnls", "lstsq"])
def test_fit_rows_with_repeated_keys_and_no_basis(spark, method):
    rng = np.random.default_rng(3)
    data = [(1 if i < 6 else None, [float(v) for v in rng.normal(size=3)]) for i in range(8)]
    t = spark.createDataFrame(data, "example_num bigint, f_diff array<double>")
    b = frame(spark, rng.normal(size=(9, 3)))
    for options in ({}, {"pool_rows": 1}):
        out = fit_rows(t, b, method, **options).collect()
        assert sorted(map(str, (r.example_num for r in out))) == ["1"] * 6 + ["None"] * 2
    empty = fit_rows(t, b.limit(0), method).collect()
    assert len(empty) == 8 and all(r.coefficients == [] and r.reconstruction == [0.0] * 3 for r in empty)
    assert fit_rows(t.limit(0), b, method).count() == 0
    with pytest.raises(ValueError, match="1 vectors"):
        fit_rows(t, b.union(spark.createDataFrame([(5, [float("nan"), 1.0, 1.0])], b.schema)), method)
    with pytest.raises(ValueError, match="length"):
        fit_rows(t, frame(spark, rng.normal(size=(4, 2))), method)


def test_fit_quality_of_constant_rows(spark):
    df = spark.sql(
        "select * from values (array(1D,1D,1D), array(0D,1D,1D)), (array(0D,0D), array(0D,0D)), (array(1D,3D), array(1D,2D)) t(y, f)"
    )
    got = [r[0] for r in df.select(fit_quality("y", "f").r2_score).collect()]
    assert got[0] == 0.0 and got[1] == 1.0 and abs(got[2] - 0.5) < 1e-12


def test_summaries_at_full_width(spark, small):
    from sequential import span_residual

    from pairsieve.catalog import QUERIES

    def cone_residual(basis, y):
        """Lawson and Hanson's active set; the supports cannot be tried one by one in 64 dimensions."""
        x, used = np.zeros(len(basis)), np.zeros(len(basis), bool)
        while True:
            slope = basis @ (y - basis.T @ x)
            slope[used] = -np.inf
            if slope.max(initial=-np.inf) <= 1e-10:
                left = y - basis.T @ x
                return float(left @ left)
            used[slope.argmax()] = True
            while True:
                z = np.zeros(len(basis))
                z[used] = np.linalg.lstsq(basis[used].T, y, rcond=None)[0]
                bad = used & (z <= 1e-12)
                if not bad.any():
                    x = z
                    break
                x = x + (x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min() * (z - x)
                used &= x > 1e-12

    feats = sorted((r.example_num, list(r.f_diff)) for r in I.feats(spark, small).collect())
    rows = np.asarray([v if k % 10 else [0.0] * len(v) for k, v in feats])
    zeros = sum(k % 10 == 0 for k, _ in feats)
    got = {r.solver: r for r in QUERIES["redundancy_summary_all_components"](spark, small).collect()}
    for solver, residual in (("nnls", cone_residual), ("lstsq", span_residual)):
        redundant = len(greedy(rows[rows.any(1)], solver, residual=residual)) + zeros
        r = got[solver]
        assert (r.n_examples, r.n_redundant, r.n_non_redundant) == (len(rows), redundant, len(rows) - redundant)
        assert (r.n_zero_redundant, r.n_non_zero_redundant) == (zeros, redundant - zeros)
    used = {r.method: (r.n_rows, r.usage_pct) for r in QUERIES["method_usage_all_components"](spark, small).collect()}
    assert used == {"nnls": (len(rows), 50.0), "lstsq": (len(rows), 50.0)}
