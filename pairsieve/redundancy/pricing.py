"""Column generation for any number of targets at once: fits in tasks, and one join per round that finds rows to improve them.

A target is fitted on a basis of bounded size. Its fit names a direction and a limit: only a row whose inner product with the
direction exceeds the limit can change it. Each round fits every open target in tasks, then looks for such rows in the whole
table; targets without any are settled, the others take the best rows found into their basis. Targets, fits, values and rows
stay in tables of the shared folder; the driver sees how many targets are open, per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from . import kernels

# Targets and table rows that meet in one task at a time, and rows multiplied at once there.
BLOCK_ROWS, PART_ROWS, CHUNK = 2048, 8192, 1024
# Best rows a round returns per target.
LANES = 16
# Targets that one task fits.
FITTED_ROWS = 500
# Table rows that every task holds and looks at before the table is joined: so many, or as many as fit these bytes.
START_ROWS, START_BYTES = 8192, 4 << 20

EXTRA = "array<struct<key:bigint,vec:array<double>>>"
TARGET = "_p int, _g string, _id bigint, _key bigint, _vec array<double>, _spread double"
STATE = f"{TARGET}, _extra {EXTRA}, _value double, _direction array<double>, _limit double"
FOUND = "_p int, _id bigint, _lane int, _score double, _row struct<key:bigint,vec:array<double>>"

#: (problem, key, vector, spread, rows besides its basis) to (value, direction, limit)
Judge = Callable[[int, int, np.ndarray, float, np.ndarray], tuple[float, np.ndarray, float]]


def vectors(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), d), dtype=np.float64)


def list_column(rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)))


def start_rows(d: int) -> int:
    return min(START_ROWS, START_BYTES // (8 * d))


class Start:
    """Some rows of the table, sorted by lane: of these a task finds the best per lane by itself, as a round does in the table."""

    def __init__(self, keys: np.ndarray, vecs: np.ndarray):
        order = np.lexsort((np.arange(len(keys)), keys % LANES))
        self.keys, self.vecs = keys[order], vecs[order]
        self.bounds = np.searchsorted(self.keys % LANES, np.arange(LANES + 1))

    def best(self, directions: np.ndarray, limits: np.ndarray, has: list[list[int]]) -> list[list[int]]:
        """Per target: the positions of the rows, one per lane at most, that exceed its limit most; not those that it ``has``."""
        scores = self.vecs @ directions.T
        for t, mine in enumerate(has):
            scores[mine, t] = -np.inf
        out: list[list[int]] = [[] for _ in has]
        for begin, end in zip(self.bounds[:-1], self.bounds[1:]):
            if end > begin:
                pick = begin + scores[begin:end].argmax(axis=0)
                for t in np.flatnonzero(scores[pick, np.arange(len(has))] > limits):
                    out[t].append(int(pick[t]))
        return out


def _fit_task(judge: Judge, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                problems, keys, spreads = (batch.column(c).to_pylist() for c in (0, 3, 5))
                vecs = vectors(batch.column(4), d)
                fits = []
                for i, extra in enumerate(batch.column(6).to_pylist()):
                    more = np.array([e["vec"] for e in extra]).reshape(len(extra), d)
                    fits.append(judge(problems[i], keys[i], vecs[i], spreads[i], more))
                values, directions, limits = zip(*fits)
                columns = [pa.array(values, pa.float64()), list_column(np.array(directions)), pa.array(limits, pa.float64())]
                names = [*batch.schema.names, "_value", "_direction", "_limit"]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return run


def _price_task(known, d: int, two_sided: bool):
    """Of a block of targets and a part of the table: the best row per target and lane that exceeds its limit.

    A row counts for targets before it, and for targets after it if it was kept. Rows that a target's basis has are passed over.
    """

    def run(targets: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if targets.num_rows and rows.num_rows:
            problems, keys = (targets.column(c).to_numpy() for c in ("_p", "_key"))
            ids, limits = (targets.column(c).to_numpy() for c in ("_id", "_limit"))
            directions, has = vectors(targets.column("_direction"), d), targets.column("_has").to_pylist()
            own_keys, vecs = rows.column("_key").to_numpy(), vectors(rows.column("_vec"), d)
            kept_by = rows.column("_kept_by").to_pylist()
            asked = np.unique(problems)
            kept_for = {p: kept for p in asked if (kept := np.array([bool(k) and int(p) in k for k in kept_by])).any()}
            # Rows that a target's basis has: places of the row and of the target.
            held = np.array([key for mine in has for key in mine], np.int64)
            holder = np.repeat(np.arange(len(keys)), [len(mine) for mine in has])
            order = np.argsort(own_keys)
            place = order[np.searchsorted(own_keys, held, sorter=order).clip(max=len(own_keys) - 1)]
            found = own_keys[place] == held
            place, holder = place[found], holder[found]
            top = np.full((LANES, len(keys)), -np.inf)
            at = np.zeros((LANES, len(keys)), np.int64)
            for begin in range(0, len(own_keys), CHUNK):
                own = own_keys[begin : begin + CHUNK]
                scores = kernels.gains(vecs[begin : begin + CHUNK], directions, two_sided)
                eligible = own[:, None] > keys[None, :]
                for p, kept in kept_for.items():
                    eligible |= kept[begin : begin + CHUNK, None] & (own[:, None] < keys[None, :]) & (problems == p)[None, :]
                for p in asked:
                    eligible[np.ix_(np.isin(own, known.value[int(p)]), problems == p)] = False
                here = (place >= begin) & (place < begin + len(own))
                eligible[place[here] - begin, holder[here]] = False
                scores = np.where(eligible & (scores > limits[None, :]), scores, -np.inf)
                for lane in range(LANES):
                    members = np.flatnonzero(own % LANES == lane)
                    if len(members):
                        pick = scores[members].argmax(axis=0)
                        value = scores[members[pick], np.arange(len(keys))]
                        better = value > top[lane]
                        top[lane, better], at[lane, better] = value[better], begin + members[pick[better]]
            lanes, t = np.nonzero(np.isfinite(top))
            if len(t):
                row = at[lanes, t]
                pair = pa.StructArray.from_arrays([pa.array(own_keys[row]), list_column(vecs[row])], names=["key", "vec"])
                out = [pa.array(problems[t], pa.int32()), pa.array(ids[t]), pa.array(lanes, pa.int32()), pa.array(top[lanes, t]), pair]
        names = ["_p", "_id", "_lane", "_score", "_row"]
        return pa.table(out, names=names) if out else EMPTY

    return run


EMPTY = pa.schema(
    [
        ("_p", pa.int32()),
        ("_id", pa.int64()),
        ("_lane", pa.int32()),
        ("_score", pa.float64()),
        ("_row", pa.struct([("key", pa.int64()), ("vec", pa.list_(pa.float64()))])),
    ]
).empty_table()


def _by_group(values: dict[str, int]) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col("_g"))


def _salt(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def _price(fits: DataFrame, table: DataFrame, n_open: dict[str, int], sizes: dict[str, int], known, d: int, two_sided: bool) -> DataFrame:
    """``_p, _id, _new``: for each target the best rows that would improve it. One job, whatever the number of targets.

    Targets fall into blocks and the group's rows into parts, both of bounded size. A target is sent to every part, a row to
    every block, and each pair of block and part meets in one task; best rows are then reduced per target.
    """
    blocks = _by_group({g: -(-n // BLOCK_ROWS) for g, n in n_open.items()})
    parts = _by_group({g: -(-sizes[g] // PART_ROWS) for g in n_open})
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    has = F.transform("_extra", lambda x: x["key"]).alias("_has")
    asked = fits.select("_p", "_g", "_id", "_key", "_direction", "_limit", has, _salt("_id", blocks).alias("_t"))
    asked = asked.withColumn("_s", all_of(parts))
    rows = table.where(F.col("_g").isin(list(n_open))).select("_g", "_key", "_vec", "_kept_by", _salt("_key", parts).alias("_s"))
    rows = rows.withColumn("_t", all_of(blocks))
    place = ["_g", "_t", "_s"]
    found = asked.groupBy(*place).cogroup(rows.groupBy(*place)).applyInArrow(_price_task(known, d, two_sided), FOUND)
    best = found.groupBy("_p", "_id", "_lane").agg(F.max_by("_row", "_score").alias("_row"))
    return best.groupBy("_p", "_id").agg(F.collect_list("_row").alias("_new"))  # at most LANES


def _open_by_group(targets: DataFrame) -> dict[str, int]:
    return {r["_g"]: r["n"] for r in targets.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}


def improve(
    targets: DataFrame,
    table: DataFrame,
    sizes: dict[str, int],
    judge: Judge,
    known: dict[int, np.ndarray],
    d: int,
    two_sided: bool = False,
) -> DataFrame:
    """``TARGET, _extra, _value`` of every target, fitted on its basis and whatever rows of the table improve the fit.

    ``targets`` has the columns of ``TARGET``, and may have ``_extra``, rows found before; ``_id`` is unique within a problem ``_p``, all problems of a group share its rows.
    ``table`` has ``_g, _key, _vec, _kept_by`` (problems that have kept the row; NULL for none). ``sizes`` counts a group's
    rows, ``known`` lists the keys that the basis of a problem has from the start. ``two_sided``: rows bound from above, too.
    """
    spark = targets.sparkSession
    shared = spark.sparkContext.broadcast(known)
    extra = F.col("_extra") if "_extra" in targets.columns else F.array()
    state = targets.select(*[c.split()[0] for c in TARGET.split(", ")], extra.cast(EXTRA).alias("_extra"))
    n_open, settled = _open_by_group(state), []
    while n_open:
        n = sum(n_open.values())
        tasks = max(spark.sparkContext.defaultParallelism, -(-n // FITTED_ROWS))
        fits = materialise(state.repartition(min(n, tasks)).mapInArrow(_fit_task(judge, d), STATE), "fits")
        open_fits = fits.where(F.col("_limit") < float("inf"))
        n_open = _open_by_group(open_fits)
        if sum(n_open.values()) < n:  # no row can change the others
            settled.append(fits.where("not _limit < double('inf')").drop("_direction", "_limit"))
        if not n_open:
            break
        found = _price(open_fits, table, n_open, sizes, shared, d, two_sided)
        priced = materialise(open_fits.drop("_direction", "_limit").join(found, ["_p", "_id"], "left"), "priced")
        if sum(n_open.values()) == n:
            discard(fits)
        settled.append(priced.where("_new is null").drop("_new"))
        state = priced.where("_new is not null").withColumn("_extra", F.concat("_extra", "_new")).drop("_new", "_value")
        state = state.select(*[c.split()[0] for c in TARGET.split(", ")], "_extra")
        n_open = _open_by_group(state)
    out = settled[0] if settled else spark.createDataFrame([], f"{TARGET}, _extra {EXTRA}, _value double")
    for more in settled[1:]:
        out = out.unionByName(more)
    return out
