"""Which examples of a table carry no information beyond the others."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import (
    ZERO_ATOL,
    as_double,
    centred_sum_squares,
    is_constant,
    is_zero,
    l2_normalise,
    truncate,
)
from ..session import discard, materialise
from .groups import GROUP_WORK, decide_groups, rows_per_task
from .sieve import SPREAD_FLOOR, TAIL_BYTES, Sieve, Spec, constant_rows


INFEASIBLE = "_g string, _s int, _infeasible boolean"


def find_redundancy(
    df: DataFrame,
    vector: str = "f_diff",
    key: str = "example_num",
    group_by: Sequence[str] = (),
    solve_by: str = "r2",
    solver: str = "nnls",
    threshold: float = 0.95,
    components: int | None = None,
    **options,
) -> DataFrame:
    """Greedy redundancy in the order of ``key``, within each group.

    An example is redundant when its normalised difference vector is fitted by the later examples and the
    earlier kept ones with R² ≥ ``threshold`` (``solve_by='r2'``) or with a residual of at most 1e-8 times
    the Frobenius norm of the basis (``'res'``). ``solver`` chooses non-negative (``nnls``) or unconstrained
    (``lstsq``) coefficients.

    Returns group columns, key, is_redundant, residual, r2_score, method, is_zero. r2_score (residual) is that of the fit on
    the final basis, all later and the kept earlier examples, whatever ``tail_rows`` and ``block_rows`` are. Vectors that are
    NULL or have NULL, NaN or infinite components are an error, as are NULL and repeated keys.
    """
    return sweep_redundancy(
        df, [Spec(solver, solve_by, threshold)], vector, key, group_by, components, **options
    ).drop("solver", "solve_by", "threshold")


def sweep_redundancy(
    df: DataFrame,
    specs: Sequence[Spec],
    vector: str = "f_diff",
    key: str = "example_num",
    group_by: Sequence[str] = (),
    components: int | None = None,
    stage: bool = True,
    **options,
) -> DataFrame:
    """``find_redundancy`` for several specs; specs of one kind share every scan of the rows.

    ``stage`` writes the normalised rows to the shared folder first, because the search reads them several times.
    ``tail_rows`` (default 4·d) and ``block_rows`` bound what one task or the driver holds; they do not change the
    result. ``values=False`` leaves out the fit values, and with them the pass that fits every row.
    """
    parts = []
    for mode in ("r2", "res"):
        chosen = [s for s in specs if s.solve_by == mode]
        if chosen:
            parts.append(_cone_search(df, chosen, mode, vector, key, list(group_by), components, stage, **options))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def half_space_redundancy(
    df: DataFrame,
    vector: str = "f_diff",
    key: str = "example_num",
    group_by: Sequence[str] = (),
    components: int | None = None,
    stage: bool = True,
    **options,
) -> DataFrame:
    """Greedy half-space redundancy in the order of ``key``.

    An example is redundant when row·w ≥ −0.01 holds for every w on the simplex that meets the same
    constraint, and row·w ≤ 100,000, for the later and the earlier kept examples. min_value is the smallest row·w there;
    NULL where no w meets the constraints.
    """
    group_by = list(group_by)
    v = truncate(as_double(vector), components)
    rows = _rows(df, v, key, group_by).withColumns({"_spread": F.lit(0.0), "_kind": F.lit("fit"), "is_zero": is_zero("_vec")})
    rows = _staged(rows, stage)
    decided, values, infeasible = _run(rows, [Spec("linprog")], _facts(rows), **options)
    # Where no point meets all constraints nothing is redundant; elsewhere what was not decided one by one is.
    settled = F.col("_infeasible").isNull()
    joined = rows.withColumn("_s", F.lit(0)).join(decided, ["_g", "_s", "_key"], "left")
    joined = joined.join(values, ["_g", "_s", "_key"], "left").join(infeasible, ["_g", "_s"], "left")
    return joined.select(
        *group_by,
        F.col("_key").alias(key),
        F.coalesce("_redundant", settled).alias("is_redundant"),
        F.col("_value").alias("min_value"),
        F.lit("linprog").alias("method"),
    )


def _staged(rows: DataFrame, stage: bool) -> DataFrame:
    return materialise(rows, "rows") if stage else rows


def _rows(df: DataFrame, vec: Column, key: str, group_by: list[str]) -> DataFrame:
    group = F.to_json(F.struct(*group_by), {"ignoreNullFields": "false"}) if group_by else F.lit("{}")
    return df.select(*group_by, group.alias("_g"), F.col(key).cast("bigint").alias("_key"), vec.alias("_vec"))


def _facts(rows: DataFrame) -> tuple[DataFrame, int]:
    """Per group: row counts and which constant directions occur; and the length of all vectors."""
    kept = F.col("_kind") == "keep"
    first = F.get("_vec", F.lit(0))
    odd = F.exists("_vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    facts = rows.groupBy("_g").agg(
        F.count_if(F.col("_key").isNull()).alias("n_null"),
        F.count_if(F.col("_vec").isNull() | odd).alias("n_odd"),
        F.count_if(F.col("_kind") == "fit").alias("n_fit"),
        F.count_if((F.col("_kind") == "fit") & (F.col("_spread") < SPREAD_FLOOR)).alias("n_low"),
        F.count_if(kept & (first > 0)).alias("n_plus"),
        F.count_if(kept & (first < 0)).alias("n_minus"),
        F.min(F.size("_vec")).alias("d_min"),
        F.max(F.size("_vec")).alias("d_max"),
    )
    facts = materialise(facts, "facts")
    sums = [F.sum(c).alias(c) for c in ("n_null", "n_odd")]
    total = facts.agg(*sums, F.min("d_min").alias("d_min"), F.max("d_max").alias("d_max")).first()
    if total["n_null"]:
        raise ValueError("the key must not be NULL: row order decides the result")
    if total["n_odd"]:
        raise ValueError(f"{total['n_odd']} vectors are NULL or have NULL, NaN or infinite components")
    if total["d_min"] != total["d_max"]:
        raise ValueError("vectors differ in length")
    return facts, total["d_min"] or 1


def _run(
    rows: DataFrame,
    specs: list[Spec],
    facts: tuple[DataFrame, int],
    tail_rows: int | None = None,
    block_rows: int = 256,
    check_keys: bool = True,
    values: bool = True,
    group_rows: int | None = None,
):
    """Decisions of the rows that needed one, fit values, and ``_g, _s`` of problems whose constraints cannot be met.

    Groups of at most ``group_rows`` rows are decided whole, in tasks; larger ones by the search. The default is what a task
    does in reasonable time (``rows_per_task``), and no group where ``tail_rows`` is given.
    """
    if check_keys:
        twice = rows.groupBy("_g", "_key").count().where(F.col("count") > 1)
        if not twice.isEmpty():
            raise ValueError("the key must identify a row within its group")
    spark = rows.sparkSession
    found = [spark.createDataFrame([], Sieve.DECISION), spark.createDataFrame([], Sieve.VALUE)]
    infeasible = spark.createDataFrame([], INFEASIBLE)
    listed, d = facts
    stored = listed
    if group_rows is None:
        group_rows = rows_per_task(d, specs) if tail_rows is None else 0
    tail_rows = 4 * d if tail_rows is None else tail_rows
    whole = F.col("n_fit") <= group_rows
    work = F.col("n_fit").cast("double") * F.col("n_fit") * d
    small = listed.agg(F.count_if(whole).alias("n"), F.sum(F.when(whole, work)).alias("work"), F.count_if(~whole).alias("others")).first()
    if small["n"]:
        mine = rows.join(listed.where(whole).select("_g"), "_g", "left_semi") if small["others"] else rows
        tasks = max(2 * spark.sparkContext.defaultParallelism, int(small["work"] // GROUP_WORK) + 1)
        done = materialise(decide_groups(mine, specs, d, tasks, values), "groups")
        found[0] = found[0].unionByName(done.where("_redundant is not null").select("_g", "_s", "_key", "_redundant"))
        if values:
            found[1] = found[1].unionByName(done.where("_key is not null").select("_g", "_s", "_key", "_value"))
        infeasible = infeasible.unionByName(done.where("_key is null").select("_g", "_s", F.lit(True).alias("_infeasible")))
        listed = listed.where(~whole)
    # Groups come in pages whose tails together fit the driver, however many groups there are.
    at_once = max(1, TAIL_BYTES // (2 * tail_rows * d * 8 * len(specs)))
    single = not small["n"] and listed.limit(at_once + 1).count() <= at_once
    pages = listed.orderBy("_g").toLocalIterator()
    while batch := list(islice(pages, at_once)):
        groups = {f["_g"]: {"n_fit": f["n_fit"], "n_low": f["n_low"], "fixed": constant_rows(f["n_plus"], f["n_minus"], d)} for f in batch}
        mine = rows if single else rows.where(F.col("_g").isin(list(groups)))
        decided, fitted, problems = Sieve(mine, specs, groups, d, tail_rows, block_rows).run(values)
        found = [a.unionByName(b) for a, b in zip(found, (decided, fitted))]
        missed = [(p.group, p.index, True) for p in problems if not p.feasible]
        if missed:
            infeasible = infeasible.unionByName(spark.createDataFrame(missed, INFEASIBLE))
    discard(stored)
    return (*found, infeasible)


def _cone_search(df, specs, mode, vector, key, group_by, components, stage, **options) -> DataFrame:
    unit = l2_normalise(truncate(as_double(vector), components))
    near_zero = F.forall("_vec", lambda x: F.abs(x) <= F.lit(ZERO_ATOL))
    rows = _rows(df, unit, key, group_by).withColumn("is_zero", is_zero("_vec"))
    if mode == "r2":
        kind = (
            F.when(is_constant("_vec") & near_zero, F.lit("drop"))
            .when(is_constant("_vec"), F.lit("keep"))
            .otherwise(F.lit("fit"))
        )
    else:
        kind = F.when(F.col("is_zero"), F.lit("drop")).otherwise(F.lit("fit"))
    rows = rows.withColumns({"_spread": centred_sum_squares("_vec"), "_kind": kind})
    rows = _staged(rows, stage)
    decided, values, _ = _run(rows, specs, _facts(rows), **options)

    described = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("_s"),
                    F.lit(s.solver).alias("solver"),
                    F.lit(s.solve_by).alias("solve_by"),
                    F.lit(float(s.threshold)).alias("threshold"),
                )
                for i, s in enumerate(specs)
            ]
        )
    ).alias("_spec")
    narrow = rows.select(*group_by, "_g", "_key", "is_zero", "_kind", "_spread", described).select("*", "_spec.*").drop("_spec")
    joined = narrow.join(decided, ["_g", "_s", "_key"], "left").join(values, ["_g", "_s", "_key"], "left")
    value = F.when(F.col("_kind") == "drop", F.lit(1.0 if mode == "r2" else 0.0)).when(
        F.col("_kind") == "keep", F.lit(0.0)
    ).otherwise(F.col("_value"))
    return joined.select(
        *group_by,
        F.col("_key").alias(key),
        F.coalesce("_redundant", F.col("_kind") != "keep").alias("is_redundant"),
        (value if mode == "res" else F.lit(None).cast("double")).alias("residual"),
        (value if mode == "r2" else F.lit(None).cast("double")).alias("r2_score"),
        F.col("solver").alias("method"),
        "is_zero",
        "solver",
        "solve_by",
        "threshold",
    )
