"""Whole groups decided in one task each: many small groups take one job, whatever their number."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .kernels import HalfSpaceTest
from .pricing import vectors
from .sieve import KEPT, OPEN, GONE, Spec, constant_rows, decide_run

# Multiplications of a pass over a group's rows for each of its rows, up to which one task decides the group; a linear
# programme costs as much as so many fits.
GROUP_WORK, PROGRAMME = 1 << 25, 8
DECIDED = "_g string, _s int, _key bigint, _redundant boolean, _value double"


def rows_per_task(d: int, specs: Sequence[Spec]) -> int:
    """Rows of the largest group that a task decides by itself."""
    work = GROUP_WORK // (PROGRAMME if any(s.solver == "linprog" for s in specs) else 1)
    return int((work / d) ** 0.5)


def decide_groups(rows: DataFrame, specs: Sequence[Spec], d: int, tasks: int, values: bool) -> DataFrame:
    """``_g, _s, _key, _redundant, _value`` of the fitted rows (``_kind`` 'fit') of every group, in one job.

    Groups are dealt by hash into ``tasks`` tasks, about equal in work as each holds many groups or a few within the same
    bound; a task decides its groups one after another, rows in order of their keys, each on all later and all kept rows.
    ``_redundant`` is NULL where other rows say that the row is redundant without a test. A problem whose constraints no
    point meets gives one row without a key.
    """
    tests = [s.test for s in specs]

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("_s", "_key", "_redundant", "_value")}
        kind = table.column("_kind").to_numpy()
        vecs = vectors(table.column("_vec"), d)
        first = vecs[kind == "keep", 0]
        fixed = constant_rows(bool((first > 0).any()), bool((first < 0).any()), d)
        keys, spreads = table.column("_key").to_numpy(), table.column("_spread").to_numpy()
        order = np.flatnonzero(kind == "fit")
        order = order[np.argsort(keys[order])]
        keys, vecs, spreads = keys[order], vecs[order], spreads[order]
        for s, (spec, test) in enumerate(zip(specs, tests)):
            if not len(keys):
                break
            if isinstance(test, HalfSpaceTest) and test.judge(np.linspace(1.0, 2.0, d), vecs, 0.0, 0).limit == np.inf:
                for name, value in zip(out, (s, None, None, None)):
                    out[name].append(value)
                continue
            for name, found in zip(out, _decided(spec, test, fixed, keys, vecs, spreads, values)):
                out[name].extend([s] * len(keys) if name == "_s" else found)
        kinds = {"_s": pa.int32(), "_key": pa.int64(), "_redundant": pa.bool_(), "_value": pa.float64()}
        n = len(out["_s"])
        arrays = [pa.array([key[0].as_py()] * n, pa.string()), *[pa.array(c, kinds[name]) for name, c in out.items()]]
        return pa.table(arrays, names=["_g", *out])

    source = rows.where(F.col("_kind").isin("fit", "keep")).select("_g", "_key", "_vec", "_spread", "_kind")
    return source.repartition(tasks, "_g").groupBy("_g").applyInArrow(decide, DECIDED)


def _decided(spec: Spec, test, fixed: np.ndarray, keys: np.ndarray, vecs: np.ndarray, spreads: np.ndarray, values: bool):
    """Columns of one group under one spec, rows in order."""
    n = len(keys)
    # With coefficients of any sign the last independent rows decide everything; the others are redundant.
    pick = np.sort(kernels.last_independent(keys, vecs)) if spec.solver == "lstsq" else np.arange(n)
    known = keys[pick], vecs[pick], np.full(len(pick), OPEN, np.int8)
    targets = [(keys[i], vecs[i], spreads[i], n - 1 - int(i)) for i in pick]
    redundant: list[bool | None] = [None] * n
    for i, (gone, _) in zip(pick, decide_run(test, fixed, known, 0, targets)):
        redundant[i] = gone
    fitted: list[float | None] = [None] * n
    if values:
        states = np.array([GONE if redundant[i] else KEPT for i in pick], np.int8)
        basis, always = np.vstack([fixed, vecs[pick]]), np.ones(len(fixed), bool)
        for i in range(n):
            usable = (known[0] > keys[i]) | ((states == KEPT) & (known[0] < keys[i]))
            fitted[i] = float(test.judge(vecs[i], basis, spreads[i], 0, np.concatenate([always, usable])).value)
    return None, keys.tolist(), redundant, fitted
