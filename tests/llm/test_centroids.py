import hashlib
import random

import pytest

from pairsieve.llm import centroids as C

SHAPE = "vec_id bigint, embedding array<float>, label int, x string, cells string, c int, hash string"


def plain(rows, size, k, rounds, scale=1024, seed=3):
    """The clustering as a plain loop: sorted (key, cluster, distance, cluster inertia, inertia, digest)."""
    kept = [(key, [int(c * scale // 1) for c in v]) for key, v in rows if v is not None and len(v) == size and all(c is not None and abs(c) < float("inf") for c in v)]
    digest = lambda key: hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (away(v, centres[c]), c))
    for _ in range(rounds):
        assigned = [nearest(v) for _, v in kept]
        for c in range(len(centres)):
            own = [v for (_, v), a in zip(kept, assigned) if a == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    assigned = [nearest(v) for _, v in kept]
    distance = [away(v, centres[a]) for (_, v), a in zip(kept, assigned)]
    inertia = [sum(d for d, a in zip(distance, assigned) if a == c) for c in range(len(centres))]
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((key, a, d, inertia[a], sum(inertia), said[a]) for (key, _), a, d in zip(kept, assigned, distance)), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(k, v, 0, "x", "cells", 1, "hash") for k, v in rows], SHAPE)


def clustered(df, **how):
    return sorted(map(tuple, C.cluster(df, **how).collect()), key=repr)


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_equals_a_plain_loop_whatever_the_cells(spark, small, bits):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in df.collect()], 64, 8, 10)
    assert clustered(df, bits=bits) == want
    assert clustered(df.repartition(5), bits=bits, sample=20) == want  # most vectors outside the sample's range


def test_groups_of_copies_ties_and_kept_vectors(spark):
    rng = random.Random(4)
    near = [tuple(rng.choice((-1.0, -0.5, 0.25, 0.5)) for _ in range(3)) for _ in range(12)]
    rows = [(i, list(near[min(11, int(rng.expovariate(0.5)))])) for i in range(200)]  # copies, and equal distances
    rows += [(300, None), (301, []), (302, [1.0, 2.0]), (303, [1.0, 2.0, None]), (304, [1.0, float("nan"), 0.0])]
    rows += [(305, [float("inf"), 0.0, 0.0]), (306, [1.0, 2.0, 3.0, 4.0]), (5, rows[5][1]), (5, [9.0, 9.0, 9.0]), (None, [0.5, 0.5, 0.5])]
    assert clustered(table(spark, rows), size=3, k=4, rounds=6) == plain(rows, 3, 4, 6)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-1.0, 2.0])]
    assert clustered(table(spark, rows), size=2, k=8) == plain(rows, 2, 8, 10)
    for none in ([], [(1, None), (2, [1.0])]):
        found = C.cluster(table(spark, none), size=2)
        assert found.count() == 0
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        C.cluster(table(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])]), size=2).collect()


def test_cells_settle_most_vectors_and_never_wrongly(spark, medium):
    df = spark.read.parquet(f"{medium}/embeddings.parquet")
    x = C.np.asarray([r.x for r in C.kept_vectors(df, "vec_id", "embedding", 64, 1024).collect()])
    cells = C.Cells(x, 8)
    own, inside = cells.encode(x)
    found = C.settle(own, inside, cells.tables(x[:8]))
    right, _ = C.nearest(x, x[:8])
    assert inside.all() and (found >= 0).mean() > 0.5
    assert (found[found >= 0] == right[found >= 0]).all()
