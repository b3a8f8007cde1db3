"""Exact k-means over integer vectors with ns-bounds.

Each vector keeps, for every centroid, the exact distance at the round in which it was last evaluated. The history of the
centroids of all rounds (rounds x k x dimensions, whatever the number of vectors) goes to every task. In a later round the
stored distance is loosened by the norm of the centroid's total displacement since then, which the norms of the single rounds'
steps can only exceed. A vector whose loosened bounds still tell its centroid from all others keeps it unread; for the others
first the own distance is evaluated anew, then that of every centroid whose bound does not clear it, in whole numbers.

A round is one pass over the written state, partition by partition without a shuffle, and a sum over the vectors that changed
their centroid, pre-aggregated in each task: k x dimensions numbers come to the driver. When none changed, the centroids stand
and no further round can differ.

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no part; fewer vectors
than k give as many centroids; repeated rows are vectors of their own; a null vec_id is kept, but is no starting centroid;
starts of one hash are ordered by their components; ties go to the smaller number; an empty centroid stays where it is; an
empty table gives no rows; other columns are not read. Whole numbers of any size are exact while the clusters are found;
distances and sums beyond 64 bits are given as the greatest 64-bit number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm._common import discard, materialize

SCALE, MOST = 1024, 2**63 - 1
#: Relative error of a square root and of the few sums behind a bound, with room to spare.
SLACK = 1e-12


def quantized(vectors: DataFrame, dims: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v: the components times SCALE rounded down, of the vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.where((F.size(vector) == dims) & F.coalesce(finite, F.lit(False))).select(
        F.col(vec_id).alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v")
    )


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances: in 64 bits where they fit, else in Python's whole numbers."""
    most = max(int(np.abs(x.astype(float)).max(initial=0)), int(np.abs(c.astype(float)).max(initial=0))) + 1
    if x.shape[-1] * (2 * most) ** 2 >= MOST:
        x, c = x.astype(object), c.astype(object)
    else:
        x, c = x.astype(np.int64), c.astype(np.int64)
    return ((x - c) ** 2).sum(axis=-1)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


def assign(x: np.ndarray, cluster: np.ndarray, dist: np.ndarray, at: np.ndarray, history: list[np.ndarray]) -> int:
    """Moves vectors to the nearest of history[-1], in place; returns how many distances were evaluated.

    dist and at: of each vector and centroid, the distance and the round of its last evaluation. cluster -1: none yet.
    """
    now, k = len(history) - 1, len(history[-1])
    far = np.stack([root(squared(then, history[-1])) for then in history])  # the total displacement of each centroid since each round
    rows = np.flatnonzero(cluster < 0)
    for j in range(k):
        dist[rows, j], at[rows, j] = root(squared(x[rows], history[-1][j])), now
    evaluated = k * len(rows)
    best = {j: squared(x[rows], history[-1][j]) for j in range(k)} if len(rows) else {}
    if best:
        cluster[rows] = np.argmin(np.stack([best[j] for j in range(k)], axis=1), axis=1)

    def open_rows(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose bounds do not tell their centroid from the others, and for them which others."""
        own = cluster[which]
        loose = far[at[which], np.arange(k)]
        low = dist[which] - loose - SLACK * (dist[which] + loose)
        mine = np.arange(len(which))
        high = dist[which, own] + far[at[which, own], own]
        near = low <= (high * (1 + SLACK))[:, None]
        near[mine, own] = False
        some = near.any(axis=1)
        return which[some], near[some]

    older = np.setdiff1d(np.arange(len(x)), rows, assume_unique=True)
    failing, _ = open_rows(older)
    exact = squared(x[failing], history[-1][cluster[failing]])
    dist[failing, cluster[failing]], at[failing, cluster[failing]] = root(exact), now
    evaluated += len(failing)
    still, near = open_rows(failing)
    exact = exact[np.isin(failing, still, assume_unique=True)]
    least, winner = exact, cluster[still].copy()
    for j in range(k):
        here = np.flatnonzero(near[:, j])
        d = squared(x[still[here]], history[-1][j])
        dist[still[here], j], at[still[here], j] = root(d), now
        evaluated += len(here)
        better = (d < least[here]) | ((d == least[here]) & (j < winner[here]))
        least[here[better]], winner[here[better]] = d[better], j
    cluster[still] = winner
    return evaluated


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.reshape(-1)))


def _round(state: DataFrame, history: list[np.ndarray], label: str) -> DataFrame:
    """The state after one more assignment: vec_id, v, cluster, was (the cluster before), dist, at, evaluated."""
    k, now = len(history[-1]), len(history) - 1
    fresh = "cluster" not in state.columns
    kind = state.schema["vec_id"].dataType.simpleString()
    columns = ["vec_id", "v"] if fresh else ["vec_id", "v", "cluster", "dist", "at"]
    names = ["vec_id", "v", "cluster", "was", "dist", "at", "evaluated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column(1), n)
            if fresh:
                was, dist, at = np.full(n, -1), np.zeros((n, k)), np.zeros((n, k), dtype=np.int64)
            else:
                was, dist, at = batch.column(2).to_numpy().astype(np.int64), _matrix(batch.column(3), n).copy(), _matrix(batch.column(4), n).astype(np.int64)
            cluster = was.copy()
            evaluated = assign(x, cluster, dist, at, history)
            counts = np.zeros(n, dtype=np.int64)
            counts[0] = evaluated  # of the whole batch
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), _lists(dist), _lists(at.astype(np.int32)), pa.array(counts)], names
            )

    schema = f"vec_id {kind}, v array<long>, cluster int, was int, dist array<double>, at array<int>, evaluated long"
    return materialize(state.select(*columns).mapInArrow(run, schema), f"{label}-{now}")


def _changes(state: DataFrame, k: int, dims: int) -> list[tuple[int, int, int]]:
    """(cluster, place, difference) of the sums of components, at place dims of the count, by the vectors that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=object)
        for batch in batches:
            n = batch.num_rows
            x = np.concatenate([_matrix(batch.column(0), n).reshape(n, dims).astype(object), np.ones((n, 1), dtype=object)], axis=1) if n else np.zeros((0, dims + 1), dtype=object)
            small = n and np.abs(x[:, :-1].astype(float)).max() < 2**40
            x = x.astype(np.int64) if small else x
            for sign, column in ((1, 1), (-1, 2)):
                of = batch.column(column).to_numpy()
                for j in range(k):
                    total[j] += sign * x[of == j].sum(axis=0).astype(object)
        j, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(j.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array([Decimal(int(total[a, b])) for a, b in zip(j, place, strict=True)], pa.decimal128(38, 0))], ["cluster", "place", "n"]
        )

    moved = state.where(F.col("cluster") != F.col("was")).select("v", "cluster", "was")
    sums = moved.mapInArrow(run, "cluster int, place int, n decimal(38,0)").groupBy("cluster", "place").agg(F.sum("n").alias("n"))
    return [(r["cluster"], r["place"], int(r["n"])) for r in sums.collect()]  # k x (dims + 1) rows at most


def starts(vectors: DataFrame, k: int, prefix: str = "3:") -> np.ndarray:
    """The k vectors with the smallest hash of prefix and vec_id, in its order."""
    hashed = vectors.where(F.col("vec_id").isNotNull()).withColumn("hash", F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256))
    rows = hashed.orderBy("hash", "v").limit(k).select("v").collect()
    return np.asarray([r["v"] for r in rows], dtype=object)


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """The state after so many rounds and the assignment that follows them, and the centroids that it refers to.

    vectors: vec_id and v, all of the centroids' length.
    """
    k, dims = centroids.shape
    history, total, state, label = [centroids], np.zeros((k, dims + 1), dtype=object), vectors, "kmeans"
    for now in range(rounds + 1):
        before, state = state, _round(state, history, label)
        if now:
            discard(before)
        if now == rounds:
            break
        changes = _changes(state, k, dims)
        for j, place, n in changes:
            total[j, place] += n
        if not changes:
            break  # the same vectors, so the same centroids and assignments in every further round
        history.append(np.asarray([[s // t[-1] for s in t[:-1]] if t[-1] else list(old) for t, old in zip(total, history[-1], strict=True)], dtype=object))
    return state, history[-1]


def _capped(n: Column) -> Column:
    return F.least(n, F.lit(Decimal(MOST))).cast("long")


def with_distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    kind = state.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column(2).to_numpy()
                d = squared(_matrix(batch.column(1), batch.num_rows), centroids[own])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([Decimal(int(x)) for x in d], pa.decimal128(38, 0))], ["vec_id", "cluster", "d"])

    each = state.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {kind}, cluster int, d decimal(38,0)")
    sums = {r["cluster"]: int(r["d"]) for r in each.groupBy("cluster").agg(F.sum("d").alias("d")).collect()}  # one row a cluster
    digest = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    rows = [(j, min(d, MOST), min(sum(sums.values()), MOST), digest[j]) for j, d in sums.items()]
    table = state.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return each.join(F.broadcast(table), "cluster").select("vec_id", "cluster", _capped(F.col("d")).alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def op11_ns_kmeans(spark: SparkSession, sf_dir: str, k: int = 8, dims: int = 64, rounds: int = 10) -> DataFrame:
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), dims)
    first = starts(vectors, k)
    if not len(first):
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {RESULT}")
    state, centroids = cluster(vectors, first, rounds)
    return with_distances(state, centroids)


def _oracle(k: int = 8, dims: int = 64, rounds: int = 10) -> str:
    """The rounds one after the other, each centroid a row of a table."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := d, j := j)) AS best FROM (
  SELECT rid, j, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM x CROSS JOIN c{r}) GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT j, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT best.j AS j, unnest(v) AS e, unnest(range(1, {dims + 1})) AS i FROM a{r} JOIN x USING (rid)) GROUP BY j, i),
u{r} AS (SELECT j, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT c{r}.j AS j, coalesce(u{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN u{r} ON c{r}.j = u{r}.j)""")
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS j, v AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})),
{",".join(steps)},
f AS (SELECT vec_id, best.j AS cluster, best.d AS distance FROM a{rounds} JOIN x USING (rid))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{rounds} ON cluster = j
"""


ORACLE = _oracle()
