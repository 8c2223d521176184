"""Fit many target rows against one basis table, both of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, fit_quality
from ..session import materialise
from . import kernels, pricing
from .sieve import EXACT, LOWEST_KEY, MERGE_SLOTS, _arrays, _pivot_task, _vector_column

GROUP = "{}"
FIT = "_id bigint, _vec array<double>, _entries array<struct<id:bigint,coefficient:double>>, _fitted array<double>, _settled boolean"
STARTED = f"{FIT}, _extra {pricing.EXTRA}"
ENTRIES = pa.list_(pa.struct([("id", pa.int64()), ("coefficient", pa.float64())]))
EXTRA = pa.list_(pa.struct([("key", pa.int64()), ("vec", pa.list_(pa.float64()))]))


def fit_rows(
    targets: DataFrame,
    basis: DataFrame,
    method: str = "nnls",
    key: str = "example_num",
    vector: str = "f_diff",
    basis_key: str = "example_num",
    basis_vector: str = "f_diff",
    pool_rows: int | None = None,
) -> DataFrame:
    """Least squares of every target on the rows of ``basis``, ``nnls`` (x ≥ 0) or ``lstsq``.

    Returns key, coefficients (the non-zero ones, by basis key), reconstruction, mse, r2_score, residual: one row per
    target, also where keys repeat or are NULL. Vectors that are NULL, of another length, or have NULL, NaN or infinite
    components are an error.

    ``lstsq`` needs at most d independent basis rows, the last in order; they are found per task and merged, and the
    coefficients are those on them (a basic solution; the least-norm one where the basis is independent).
    ``nnls`` fits every target in its own task: on a first pool of ``pool_rows`` basis rows (4·d), then also on those of the first
    ``pricing.start_rows`` rows that improve it. A fit that leaves nothing, or that has seen the whole basis, is final; the others
    go on together in rounds (``pricing``): tasks fit them, a join finds basis rows that would improve them, until none does. The
    pool and the start decide the cost, never the result.
    """
    if method not in ("nnls", "lstsq"):
        raise ValueError(f"method must be 'nnls' or 'lstsq', not {method!r}")
    row = F.monotonically_increasing_id()
    rows = targets.select(row.alias("_id"), F.col(key).alias("_name"), as_double(vector).alias("_vec"))
    base = basis.select(row.alias("_key"), F.col(basis_key).cast("bigint").alias("_basis_key"), as_double(basis_vector).alias("_vec"))
    rows, base = materialise(rows, "targets"), materialise(base, "basis")
    n_rows, n, d = _checked(rows, base)
    table = base.select(F.lit(GROUP).alias("_g"), "_key", "_vec", F.lit(1.0).alias("_spread"))
    if method == "lstsq":
        ids, matrix = _independent_rows(table, d)
        parts = [_first_fits(rows, ids, matrix, True, method)]
    else:
        size = pool_rows or 4 * d
        held = base.orderBy("_key").limit(max(size, pricing.start_rows(d))).select("_key", "_vec").collect()
        ids, matrix = np.array([r["_key"] for r in held], np.int64), np.array([r["_vec"] for r in held]).reshape(-1, d)
        start = pricing.Start(ids[size:], matrix[size:])
        ids, matrix = ids[:size], matrix[:size]
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // pricing.FITTED_ROWS))
        first = materialise(_started(rows.repartition(min(tasks, max(n_rows, 1)), "_id"), ids, matrix, start, len(held) == n), "fits")
        parts = [first.where("_settled").drop("_extra")]
        if n > len(held):
            parts.append(materialise(_improved(first.where("not _settled"), table, n, d, ids, matrix), "fits"))
    fitted = parts[0]
    for part in parts[1:]:
        fitted = fitted.unionByName(part)

    named = base.select(F.col("_key").alias("id"), "_basis_key")
    entries = fitted.select("_id", F.explode("_entries").alias("_e")).select("_id", "_e.*").join(named, "id")
    entry = F.struct(F.col("_basis_key").alias("basis_key"), "coefficient")
    entries = entries.groupBy("_id").agg(F.array_sort(F.collect_list(entry)).alias("_coefficients"))
    none = F.array().cast("array<struct<basis_key:bigint,coefficient:double>>")
    quality = fitted.join(rows.select("_id", "_name"), "_id").join(entries, "_id", "left")
    quality = quality.withColumn("_q", fit_quality("_vec", "_fitted"))
    return quality.select(
        F.col("_name").alias(key),
        F.coalesce("_coefficients", none).alias("coefficients"),
        F.col("_fitted").alias("reconstruction"),
        "_q.mse",
        "_q.r2_score",
        "_q.residual",
    )


def _checked(rows: DataFrame, base: DataFrame) -> tuple[int, int, int]:
    """Targets, basis rows and the length of all vectors."""
    odd = F.col("_vec").isNull() | F.exists("_vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    facts = [
        df.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(odd).alias("odd"),
            F.min(F.size("_vec")).alias("low"),
            F.max(F.size("_vec")).alias("high"),
        ).first()
        for df in (rows, base)
    ]
    bad = sum(f["odd"] for f in facts)
    if bad:
        raise ValueError(f"{bad} vectors are NULL or have NULL, NaN or infinite components")
    sizes = {f[c] for f in facts if f["n"] for c in ("low", "high")}
    if len(sizes) > 1:
        raise ValueError("vectors differ in length")
    return facts[0]["n"], facts[1]["n"], sizes.pop() if sizes else 1


def _independent_rows(table: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The last linearly independent rows of the basis, at most d: per task, then merged in two levels."""
    shape = "_g string, _key bigint, _vec array<double>, _spread double"
    spans = table.sparkSession.sparkContext.broadcast({GROUP: np.zeros((0, d))})
    task = _pivot_task(spans, d)
    slot = F.pmod(F.xxhash64("_key"), F.lit(MERGE_SLOTS))
    merged = table.mapInArrow(task, shape).repartition(slot).mapInArrow(task, shape).repartition(1).mapInArrow(task, shape)
    found = merged.toArrow()
    if not found.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, d))
    _, keys, vecs, _ = _arrays(found.combine_chunks().to_batches()[0], d)
    return keys, vecs


def _fit(matrix: np.ndarray, y: np.ndarray, method: str) -> np.ndarray:
    if len(matrix) == 0:
        return np.zeros(0)
    return kernels.nnls(matrix, y)[0] if method == "nnls" else np.linalg.lstsq(matrix.T, y, rcond=None)[0]


def _batch(ids: list, vecs: np.ndarray, names: np.ndarray, x: list[np.ndarray], matrix: np.ndarray, settled: list[bool]) -> pa.RecordBatch:
    entries = [[{"id": int(names[j]), "coefficient": float(row[j])} for j in np.flatnonzero(row)] for row in x]
    fitted = np.array([row @ matrix for row in x]).reshape(vecs.shape)
    arrays = [pa.array(ids, pa.int64()), _vector_column(vecs), pa.array(entries, ENTRIES), _vector_column(fitted), pa.array(settled)]
    return pa.RecordBatch.from_arrays(arrays, names=["_id", "_vec", "_entries", "_fitted", "_settled"])


def _first_fits(rows: DataFrame, names: np.ndarray, matrix: np.ndarray, complete: bool, method: str) -> DataFrame:
    """Every target on the pool; settled if the pool is all there is, or if the fit leaves nothing."""
    shared = rows.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                vecs = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(float)
                x = [_fit(matrix, y, method) for y in vecs]
                left = [np.linalg.norm(y - row @ matrix) <= EXACT * np.linalg.norm(y) for y, row in zip(vecs, x)]
                yield _batch(part.column(0), vecs, names, x, matrix, [bool(complete or e) for e in left])

    return rows.select("_id", "_vec").mapInArrow(run, FIT)


def _started(rows: DataFrame, names: np.ndarray, matrix: np.ndarray, start: pricing.Start, complete: bool) -> DataFrame:
    """Non-negative fits on the pool and on the start rows that improve them; ``_extra`` has these, where the fit goes on."""
    shared = rows.sparkSession.sparkContext.broadcast((names, matrix, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, start = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                vecs = pricing.vectors(part.column(1), matrix.shape[1])
                has: list[list[int]] = [[] for _ in vecs]
                x = [_fit(matrix, y, "nnls") for y in vecs]
                left = np.array([y - row @ matrix for y, row in zip(vecs, x)]).reshape(vecs.shape)
                going = np.flatnonzero(np.linalg.norm(left, axis=1) > EXACT * np.linalg.norm(vecs, axis=1))
                while len(going) and len(start.keys):
                    limits = kernels.IMPROVES * np.linalg.norm(left[going], axis=1) + 1e-12
                    found = start.best(left[going], limits, [has[t] for t in going])
                    more = {int(t): rows for t, rows in zip(going, found) if rows}
                    going = list(more)
                    for t in going:
                        has[t] += more[t]
                        basis = np.vstack([matrix, start.vecs[has[t]]])
                        x[t] = _fit(basis, vecs[t], "nnls")
                        left[t] = vecs[t] - x[t] @ basis
                exact = np.linalg.norm(left, axis=1) <= EXACT * np.linalg.norm(vecs, axis=1)
                for t in range(len(vecs)):
                    basis, own = np.vstack([matrix, start.vecs[has[t]]]), np.concatenate([names, start.keys[has[t]]])
                    settled = bool(complete or exact[t])
                    extra = [] if settled else [{"key": int(start.keys[i]), "vec": start.vecs[i]} for i in has[t]]
                    fit = _batch(part.column(0).slice(t, 1), vecs[t : t + 1], own, [x[t]], basis, [settled])
                    column = pa.array([extra], EXTRA)
                    yield pa.RecordBatch.from_arrays([*fit.columns, column], names=[*fit.schema.names, "_extra"])

    return rows.select("_id", "_vec").mapInArrow(run, STARTED)


def _improved(rows: DataFrame, table: DataFrame, n: int, d: int, ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """Fits of the targets that further basis rows improve: column generation in the tables, then the fits themselves in tasks."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def judge(number, key, vec, spread, extra):
        basis = np.vstack([shared.value[1], extra])
        left = vec - _fit(basis, vec, "nnls") @ basis
        size = float(np.linalg.norm(left))
        return size, left, kernels.IMPROVES * size + 1e-12

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                vecs = pricing.vectors(part.column(1), d)
                for i, extra in enumerate(part.column(2).to_pylist()):
                    basis = np.vstack([matrix, np.array([e["vec"] for e in extra]).reshape(len(extra), d)])
                    own = np.concatenate([names, np.array([e["key"] for e in extra], np.int64)])
                    x = [_fit(basis, vecs[i], "nnls")]
                    yield _batch(part.column(0).slice(i, 1), vecs[i : i + 1], own, x, basis, [True])

    targets = rows.select(
        F.lit(0).alias("_p"), F.lit(GROUP).alias("_g"), "_id", F.lit(LOWEST_KEY).alias("_key"), "_vec", F.lit(1.0).alias("_spread"), "_extra"
    )
    units = table.select("_g", "_key", "_vec", F.lit(None).cast("array<int>").alias("_kept_by"))
    improved = pricing.improve(targets, units, {GROUP: n}, judge, {0: ids}, d)
    return improved.select("_id", "_vec", "_extra").mapInArrow(write, FIT)
