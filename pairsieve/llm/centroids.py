"""Exact k-means over a VA-file: vectors as few-bit cells, whose lookup tables settle most assignments without the vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsieve.session import materialise

from .rows import quoted

#: Components beyond this, after scaling, would make squared distances of 64-bit integers inexact.
LARGEST = 1 << 26
#: Vectors that set the borders of the cells: those with the smallest hashes, at most so many.
SAMPLE = 4096


def kept_vectors(df: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """``vec_id, x`` (integers ``floor(scale * component)``) of the vectors with exactly ``size`` finite components."""
    raw = F.transform(F.col(quoted(vector)), lambda c: c.cast("double"))
    chosen = df.select(F.col(quoted(key)).alias("vec_id"), raw.alias("raw"))
    finite = F.forall("raw", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    chosen = chosen.where((F.size("raw") == size) & finite)
    return chosen.select("vec_id", F.transform("raw", lambda c: F.floor(c * float(scale))).alias("x"))


def seed_hash(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)


class Cells:
    """Borders of the cells of each dimension: ``2^bits`` cells between the least and largest value of a sample.

    Inner borders are the sample's quantiles. Values outside the sample's range belong to no cell.
    """

    def __init__(self, sample: np.ndarray, bits: int):
        levels = np.linspace(0, 1, (1 << bits) + 1)
        self.borders = np.quantile(sample, levels, axis=0, method="inverted_cdf").astype(np.int64)  # cells + 1, d

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells (n, d) and whether a vector lies in cells throughout."""
        n, d = x.shape
        last = len(self.borders) - 2
        cells = np.empty((n, d), np.uint8)
        inside = np.ones(n, bool)
        for k in range(d):
            cells[:, k] = np.clip(np.searchsorted(self.borders[:, k], x[:, k], side="right") - 1, 0, last)
            inside &= (x[:, k] >= self.borders[0, k]) & (x[:, k] <= self.borders[-1, k])
        return cells, inside

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By dimension, cell and centroid ``c``: the least and largest ``c² - 2·x·c`` of any ``x`` in the cell.

        Added up over the dimensions they bound a vector's distance to ``c`` less the vector's own square, which is
        the same for every centroid; so the intervals overlap less than those of the distances themselves would.
        """
        low, high = self.borders[:-1], self.borders[1:]
        own = (centroids * centroids).T[:, None, :]
        a = own - 2 * low.T[:, :, None] * centroids.T[:, None, :]
        b = own - 2 * high.T[:, :, None] * centroids.T[:, None, :]
        return np.minimum(a, b), np.maximum(a, b)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equally near ones the first) and the squared distance; exact."""
    best, least = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for number, c in enumerate(centroids):
        away = x - c
        distance = np.einsum("ij,ij->i", away, away)
        closer = distance < least
        best[closer], least[closer] = number, distance[closer]
    return best, least


def settle(cells: np.ndarray, inside: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The centroid whose interval lies below all others, or -1 where intervals overlap or a vector is in no cell."""
    low, high = tables
    n, d = cells.shape
    least, most = np.zeros((n, low.shape[2]), np.int64), np.zeros((n, low.shape[2]), np.int64)
    for k in range(d):
        own = cells[:, k]
        least += low[k][own]
        most += high[k][own]
    best = most.argmin(1)
    ceiling = most[np.arange(n), best]
    least[np.arange(n), best] = np.iinfo(np.int64).max
    return np.where(inside & (least.min(1) > ceiling), best, -1)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """A binary column of equally long vectors, as it lies in memory."""
    whole = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    begin = np.frombuffer(column.buffers()[1], "<i4")[column.offset] if len(column) else 0
    return whole[begin : begin + len(column) * size].reshape(len(column), size)


def _encode(df: DataFrame, cells, size: int) -> DataFrame:
    """``vec_id, cells, inside, x``: the VA-file, cells and whole vectors as bytes in columns of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                if np.abs(x).max() > LARGEST:
                    raise ValueError(f"{int((np.abs(x) > LARGEST).any(1).sum())} vectors have components beyond {LARGEST}, scaled")
                own, inside = cells.value.encode(x)
                columns = [own.tobytes(), x.astype("<i4").tobytes()]
                packed = [_fixed(c, batch.num_rows) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), packed[0], pa.array(inside), packed[1]], names=["vec_id", "cells", "inside", "x"]
                )

    kind = df.schema["vec_id"].dataType.simpleString()
    return df.mapInArrow(run, f"vec_id {kind}, cells binary, inside boolean, x binary")


def _fixed(data: bytes, rows: int) -> pa.Array:
    size = len(data) // rows
    offsets = pa.py_buffer(np.arange(0, len(data) + 1, size, dtype="<i4").tobytes())
    return pa.Array.from_buffers(pa.binary(), rows, [None, offsets, pa.py_buffer(data)])


def _moves(table: DataFrame, cells, before: np.ndarray | None, now: np.ndarray) -> dict[tuple[int, int], int]:
    """By (centroid, dimension): how the sum of its vectors changes from the assignment to ``before`` to that to ``now``.
    Dimension -1 has the change in their number.

    One scan, stateless: a task settles each vector under both sets of centroids by its cells. Where both settle on the same
    centroid nothing changes, and the vector is not looked at. The others' vectors are fetched: those
    whose intervals overlap are compared exactly, those that move are added here and subtracted there.
    """
    d = now.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [cells.value.tables(c) if c is not None else None for c in (before, now)]
        sums, counts = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _vectors(batch.column(0), d)
            inside = batch.column(1).to_numpy(zero_copy_only=False)
            new = settle(own, inside, tables[1])
            old = settle(own, inside, tables[0]) if before is not None else None
            wanted = np.flatnonzero((new < 0) | (old != new)) if old is not None else np.arange(len(new))
            x = _vectors(batch.column(2), 4 * d)[wanted].view("<i4").astype(np.int64)
            for assigned, centroids, sign in ((old, before, -1), (new, now, 1)):
                if assigned is None:
                    continue
                assigned = assigned[wanted]
                unclear = np.flatnonzero(assigned < 0)
                assigned[unclear] = nearest(x[unclear], centroids)[0]
                counts += sign * np.bincount(assigned, minlength=len(now))
                for c in np.unique(assigned):
                    sums[c] += sign * x[assigned == c].sum(0)
        changes = np.column_stack([counts, sums])
        c, i = np.nonzero(changes)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i - 1), pa.array(changes[c, i])], names=["c", "i", "change"])

    parts = table.select("cells", "inside", "x").mapInArrow(run, "c long, i long, change long")
    found = parts.groupBy("c", "i").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change")).collect()
    return {(r["c"], r["i"]): int(r["change"]) for r in found}


def _floor_means(sums: dict[tuple[int, int], int], centroids: np.ndarray) -> np.ndarray:
    """Each non-empty centroid becomes the floor of its vectors' mean."""
    new = centroids.copy()
    for c in range(len(centroids)):
        if n := sums.get((c, -1), 0):
            new[c] = [sums.get((c, i), 0) // n for i in range(centroids.shape[1])]
    return new


def cluster(
    df: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    size: int = 64,
    k: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    seed: int = 3,
    bits: int = 8,
    sample: int = SAMPLE,
) -> DataFrame:
    """k-means in exact integers: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per kept vector.

    Kept are vectors with exactly ``size`` components, none NULL, NaN or infinite; a component becomes
    ``floor(scale * component)``. Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed:key`` (all there
    are, if fewer), in that order. Each round assigns every vector to the nearest centroid by squared Euclidean distance
    (of equally near ones the first) and moves each non-empty centroid to the floor of its vectors' mean; then vectors are
    assigned once more. ``distance`` is squared; ``cluster_inertia`` and ``inertia`` sum it over the cluster and over all.

    *VA-file.* Vectors are stored with an approximation: one of ``2^bits`` cells per dimension, whose borders are
    quantiles of a bounded sample (at most ``sample`` vectors, those with the smallest hashes); borders decide the cost,
    never a result. In a round every task builds lookup tables (dimension, cell, centroid) of least and largest
    contributions; their sums are an interval per centroid. Where one interval lies below the others the vector
    is settled by its cells alone. Only vectors whose intervals overlap, or that lie outside the sample's range, are fetched
    and compared exactly. Sums of clusters are carried from round to round: tasks return what leaves and what joins, so a settled vector that stays where it
    was in the round before is not fetched either (the first round and the last assignment, which needs distances, fetch all).

    A round is one scan without a shuffle of vectors; a task sends ``k`` rows, the driver holds ``k`` centroids, exact sums and the sample.
    Nothing but the VA-file is stored, so a lost executor costs its tasks. Repeated rows count one by one; of vectors with
    equal keys the smaller goes first as a starting centroid. A NULL key hashes like an empty one. An empty table gives an empty result. Components beyond
    2^26 after scaling are an error, as 64-bit distances would not be exact. Other columns are not read.
    """
    if not 1 <= bits <= 8:
        raise ValueError("cells take 1 to 8 bits")
    spark = df.sparkSession
    kept = kept_vectors(df, key, vector, size, scale)
    kind = kept.schema["vec_id"].dataType.simpleString()
    first = kept.withColumn("hash", seed_hash(seed)).orderBy("hash", "x").limit(max(k, sample)).toArrow()
    if not first.num_rows:
        return spark.createDataFrame([], f"vec_id {kind}, " + RESULT)
    chosen = first.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    if np.abs(chosen).max() > LARGEST:
        raise ValueError(f"vectors have components beyond {LARGEST}, scaled")
    cells = spark.sparkContext.broadcast(Cells(chosen, bits))
    table = materialise(_encode(kept, cells, size), "va-file")

    centroids, before = chosen[:k].copy(), None
    sums: dict[tuple[int, int], int] = {}
    for _ in range(rounds):
        for place, change in _moves(table, cells, before, centroids).items():
            sums[place] = sums.get(place, 0) + change
        before, centroids = centroids, _floor_means(sums, centroids)
        if np.array_equal(before, centroids):
            break  # every further round would repeat this one

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = cells.value.tables(centroids)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(3), 4 * size).view("<i4").astype(np.int64)
                best = settle(_vectors(batch.column(1), size), batch.column(2).to_numpy(zero_copy_only=False), tables)
                unclear = np.flatnonzero(best < 0)
                best[unclear] = nearest(x[unclear], centroids)[0]
                away = x - centroids[best]
                distance = np.einsum("ij,ij->i", away, away)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(distance)], names=["vec_id", "c", "distance"])

    assigned = materialise(table.mapInArrow(assign, f"vec_id {kind}, c long, distance long"), "assigned")
    inertia = {r["c"]: int(r["s"]) for r in assigned.groupBy("c").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [
        (c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centroids.tolist())
    ]
    facts = spark.createDataFrame(facts, "c long, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    joined = assigned.join(F.broadcast(facts), "c")
    return joined.select("vec_id", F.col("c").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
