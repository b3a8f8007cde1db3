"""Exact top-k by inner product with MaxScore over dimension postings.

A vector's dimensions are its terms. Inside a shard, each dimension's posting list holds the integer components; its bound
for a query is the most that a component of the shard can add beyond the least it must add. Terms are split by these
bounds: the non-essential ones together cannot lift a vector over the current k-th score, the essential ones are traversed
for all vectors, and the others are probed, largest bound first, only for vectors that remain competitive. Shards yield
their own k best, which are merged by a window per query.

Vectors are dealt to shards and queries to blocks by a hash, and every (shard, query block) cell is one bounded task: work is
the stated query set against all rows, and no cell grows with the data.

Defined results: null vectors and vectors with null or non-finite components take no part; vectors of different lengths
are compared over the shorter one's dimensions; repeated rows are separate candidates; queries that repeat a vec_id are one query,
whose list is the best of all their scores; ties go to the smaller vec_id; a null vec_id is never a query nor a candidate; an empty
table or query set gives no rows; other columns are not read. Scores are exact; cells whose scores could pass 2^53 are counted in
whole numbers of any size, and a score beyond 64 bits is given as the nearest 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALE = 1024


def quantized(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v, the components times SCALE rounded down."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return (
        vectors.where(F.col(vector).isNotNull() & F.col(vec_id).isNotNull())
        .where(F.coalesce(finite, F.lit(False)))
        .select(F.col(vec_id).alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))
    )


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def large_top(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best of one shard where doubles are not exact: Python's whole numbers, row by row."""
    q = [int(x) for x in query]
    scores = ((sum(a * int(b) for a, b in zip(q, v, strict=True)), int(i)) for i, v in zip(ids, vectors, strict=True) if i != query_id)
    return sorted(((max(min(s, 2**63 - 1), -(2**63)), i) for s, i in scores), key=lambda x: (-x[0], x[1]))[:k]


def shard_top(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int, chunk: int = 8) -> list[tuple[int, int]]:
    """The k best (score, vec_id) of one shard. Values are integers below 2^53, so doubles are exact.

    vectors: one posting list per column. Returned scores are exact; pruned vectors are surely below the k-th.
    """
    lowest, highest = vectors.min(axis=0), vectors.max(axis=0)
    least = np.minimum(query * lowest, query * highest)
    bound = np.maximum(query * lowest, query * highest) - least
    order = np.argsort(-bound, kind="stable")
    rest = np.concatenate([np.cumsum((bound + least)[order][::-1])[::-1], [0]])  # the most that the terms from here on can add
    alive = np.flatnonzero(ids != query_id)
    if not len(alive):
        return []
    # a first threshold from the vectors that are best on the strongest terms
    strong = order[:chunk]
    partial = vectors[:, strong] @ query[strong]
    seed = alive[np.argpartition(-partial[alive], min(4 * k, len(alive)) - 1)[: 4 * k]]
    full = vectors[seed] @ query
    threshold = np.sort(full)[-k] if len(seed) >= k else -np.inf
    # essential terms: as long as the others alone could still reach the threshold
    split = chunk
    while split < len(order) and rest[split] + least[order[:split]].sum() >= threshold:
        split += chunk
    partial = vectors[np.ix_(alive, order[:split])] @ query[order[:split]]
    while split < len(order):
        keep = partial + rest[split] >= threshold
        alive, partial = alive[keep], partial[keep]
        step = order[split : split + chunk]
        partial = partial + vectors[np.ix_(alive, step)] @ query[step]
        split += chunk
    alive, partial = alive[partial >= threshold], partial[partial >= threshold]
    best = np.lexsort((ids[alive], -partial))[:k]
    return [(int(partial[i]), int(ids[alive[i]])) for i in best]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 4096, query_rows: int = 1024
) -> DataFrame:
    """Of each query its k best vectors: query_id, rank, vec_id, score. Both frames: vec_id and v (array of long)."""
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    cell = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    dealt = vectors.withColumn("shard", cell(shards)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("qb", cell(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(stored: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(stored) and len(wanted):
            width = max(stored["v"].map(len).max(), wanted["v"].map(len).max())
            ids, matrix = stored["vec_id"].to_numpy(), _matrix(stored["v"], width)
            asked = _matrix(wanted["v"], width)
            most = max(1, width) * float(np.abs(matrix.astype(float)).max(initial=0)) * float(np.abs(asked.astype(float)).max(initial=0))
            best = shard_top if most < 2**53 else large_top
            if best is shard_top:
                matrix, asked = matrix.astype(float), asked.astype(float)
            for query_id, q in zip(wanted["vec_id"].tolist(), asked, strict=True):
                rows += [(query_id, vec_id, score) for score, vec_id in best(ids, matrix, query_id, q, k)]
        return pd.DataFrame({c: np.asarray([r[i] for r in rows], dtype=np.int64) for i, c in enumerate(("query_id", "vec_id", "score"))})

    found = (
        dealt.groupBy("shard", "qb")
        .cogroup(asked.groupBy("shard", "qb"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_maxscore(spark: SparkSession, sf_dir: str, every: int = 100) -> DataFrame:
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0))


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, 1 + least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
