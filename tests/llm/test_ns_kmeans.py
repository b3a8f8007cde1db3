"""k-means with ns-bounds against plain rounds over all distances, and against its SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from leadloom.llm import ns_kmeans


def plain(rows, k=8, dims=64, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in out if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    top = 2**63 - 1
    return sorted(((i, c, min(d, top), min(inertia[c], top), min(sum(inertia.values()), top), digest[c]) for i, c, d in out), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def run(spark, tmp_path, rows, **how):
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in ns_kmeans.op11_ns_kmeans(spark, str(tmp_path), **how).collect()), key=str)


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    cursor = con.execute(ns_kmeans.ORACLE)
    columns = [c[0] for c in cursor.description]
    got = ns_kmeans.op11_ns_kmeans(spark, sf_dir)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(cursor.fetchall())


def test_odd_vectors(spark, tmp_path):
    rng = random.Random(5)
    good = [(i, [rng.gauss(i % 5, 1) for _ in range(4)], 0) for i in range(300)]
    odd = [(400, None, 0), (401, [], 0), (402, [1.0] * 3, 0), (403, [1.0, None, 1.0, 1.0], 0), (404, [1.0, float("nan"), 1.0, 1.0], 0), (405, [float("inf")] * 4, 0), (None, [0.5] * 4, None)]
    rows = good + good[:40] + [(7, [9.0] * 4, 1)] + [(i, [2.0, 2.0, 2.0, 2.0], 0) for i in range(500, 600)] + odd
    assert run(spark, tmp_path, rows, k=5, dims=4) == plain([r[:2] for r in rows], k=5, dims=4)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 5, [(i, [0.25, -0.75], 0) for i in range(20)]])
def test_few_and_equal_vectors(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows, k=3, dims=2) == plain([r[:2] for r in rows], k=3, dims=2)


def test_components_beyond_the_common_range(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.randint(0, 13) for _ in range(3)], 0) for i in range(60)]
    assert run(spark, tmp_path, rows, k=4, dims=3) == plain([r[:2] for r in rows], k=4, dims=3)


def test_bounds_save_distances():
    """Against all distances in every round: the same clusters from far fewer evaluations, with ties and moving centroids."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(-40, 40, (400, 6)) + 500 * rng.integers(0, 6, (1, 6)) + 90 * g for g in range(6)]).astype(np.int64)
    x = np.concatenate([x, x[:50]])
    history = [x[rng.choice(len(x), 7, replace=False)].astype(object)]
    n, k = len(x), 7
    cluster, dist, at = np.full(n, -1), np.zeros((n, k)), np.zeros((n, k), dtype=np.int64)
    counts = []
    for _ in range(14):
        counts.append(ns_kmeans.assign(x, cluster, dist, at, history))
        every = np.stack([((x - c.astype(np.int64)) ** 2).sum(axis=1) for c in history[-1]], axis=1)
        assert (cluster == every.argmin(axis=1)).all()
        history.append(np.asarray([x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else history[-1][j] for j in range(k)], dtype=object))
    assert counts[0] == n * k and sum(counts[5:]) < 0.5 * n * k * len(counts[5:])
