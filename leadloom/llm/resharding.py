"""Minimum-cost-flow resharding.

The old shards hold so many bytes, the new ones take so many. A minimum-cost flow over that small graph (one node per old
and per new shard) says how many bytes go from where to where, so that the fewest bytes move. Each old shard is a line of
blocks; the flow cuts the line into stretches, and rows follow the stretch in which they begin. Positions on the line come
from sums per (old shard, block) and running sums inside a block, so no task ever holds a whole shard.

Defined results: a null text has no bytes (size 1 with the separator); a null doc_id is placed like any other value;
repeated rows are placed one by one; an empty table gives no rows; other columns travel along, save those named shard or slot.

The shards that lose or gain rows are then written anew, whole, and the others stay as they are. Rows are known by their place in
the first copy, never by doc_id; their text is shuffled once.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm._common import materialize, shared_dir


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each supplier to each consumer at the least total cost: successive shortest paths with potentials."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold the old ones")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    potential = [0] * (n + m)
    while any(left):
        distance, come, heap = [float("inf")] * (n + m), [-1] * (n + m), []
        for i in range(n):
            if left[i]:
                distance[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > distance[u]:
                continue
            steps = [(n + j, cost[u][j]) for j in range(m)] if u < n else [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                if (e := d + c + potential[u] - potential[v]) < distance[v]:
                    distance[v], come[v] = e, u
                    heapq.heappush(heap, (e, v))
        goal = min((n + j for j in range(m) if room[j]), key=lambda v: (distance[v] + potential[v], v))
        far = distance[goal]
        for v in range(n + m):
            potential[v] += min(distance[v], far)
        path, v = [], goal
        while come[v] != -1:
            path.append((come[v], v))
            v = come[v]
        amount = min([left[v], room[goal - n], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        room[goal - n] -= amount
    return flow


def transfers(old_sizes: dict[int, int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """(old, lo, hi, new): stretches of each old shard's line of bytes. What stays at home (old mod new count) comes first."""
    olds = sorted(old_sizes)
    cost = [[int(o % len(capacities) != j) for j in range(len(capacities))] for o in olds]
    flow = min_cost_flow([old_sizes[o] for o in olds], capacities, cost)
    cuts = []
    for o, row, price in zip(olds, flow, cost, strict=True):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (price[j], j)):
            if row[j]:
                cuts.append((o, at, at + row[j], j))
                at += row[j]
    return cuts


def reshard(
    docs: DataFrame, old: Column, n_new: int, n_old: int, doc_id: str = "doc_id", text: str = "text", rows_per_block: int = 16384,
) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """Each row's doc_id, size, text_crc32, old and new shard, slot and the row itself; and the transfers that the flow chose.

    old: the row's old shard, 0 to n_old - 1. The new shards get equal bytes, up to one row at each cut.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sized = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), old.cast("int").alias("old"),
            F.struct(*[c for c in docs.columns if c not in ("shard", "slot")]).alias("row"),
        ),
        "sized",
    )
    place = (F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    rows, sized = sized.select("row", *place), sized.select("doc_id", "size", "text_crc32", "old", *place)
    blocks = max(1, -(-sized.count() // rows_per_block))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    sums = materialize(sized.groupBy("old", "block").agg(F.sum("size").alias("bytes")), "sums")
    old_sizes = {r["old"]: r["bytes"] for r in sums.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}  # n_old rows at most
    total = sum(old_sizes.values())
    capacities = [total * (j + 1) // n_new - total * j // n_new for j in range(n_new)]
    cuts = transfers(old_sizes, capacities)
    ahead = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(sums.select("old", "block", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("base")), "bases")
    inside = Window.partitionBy("old", "block").orderBy("doc_id", "text_crc32", "size")
    begin = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = sized.join(bases, ["old", "block"]).withColumn("begin", begin + F.col("base"))
    shard = F.lit(None).cast("int")
    for o in sorted(old_sizes):
        own = [c for c in cuts if c[0] == o]
        inner = F.lit(own[-1][3]) if own else F.lit(0)
        for _, _, hi, j in reversed(own[:-1]):
            inner = F.when(F.col("begin") < hi, F.lit(j)).otherwise(inner)
        shard = F.when(F.col("old") == o, inner).otherwise(shard)
    placed = materialize(placed.withColumn("shard", shard.cast("int")), "placed")
    # slots without a gap: rows before this (old, block) in the shard, then the rank inside it
    counts = placed.groupBy("shard", "old", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = materialize(counts.select("shard", "old", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")), "firsts")
    rank = F.row_number().over(Window.partitionBy("old", "block", "shard").orderBy("begin", "doc_id")) - 1
    slotted = placed.withColumn("_rank", rank).join(firsts, ["shard", "old", "block"])
    slotted = slotted.select("doc_id", "size", "text_crc32", "old", "shard", (F.col("first") + F.col("_rank")).cast("long").alias("slot"), "_file", "_at")
    return slotted.join(rows, ["_file", "_at"]).drop("_file", "_at"), cuts


def rewrite_affected(docs: DataFrame, assigned: DataFrame, path: str, n_new: int) -> DataFrame:
    """Writes the rows of docs that leave their home shard to path/shard=N, each as often as it is assigned there."""
    moved = assigned.where(F.col("old") % n_new != F.col("shard"))
    moved.select(*[F.col("row")[c].alias(c) for c in docs.columns], "shard").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def rewrite_shards(assigned: DataFrame, cuts: list[tuple[int, int, int, int]], path: str, n_new: int) -> DataFrame:
    """The new table: the shards that lose or gain rows as written to path/shard=N, without the rows they lose and with those they
    gain, and the other shards as they are. Columns of the rows, shard and slot."""
    affected = sorted({k for o, _, _, j in cuts if o % n_new != j for k in (o % n_new, j)})
    table = assigned.select("row.*", "slot", "shard")
    if not affected:
        return table
    table.where(F.col("shard").isin(affected)).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    written = assigned.sparkSession.read.schema(table.schema).parquet(path)
    return written if len(affected) == n_new else written.unionByName(table.where(~F.col("shard").isin(affected)))


def op6_resharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the table's files are its old shards, held as eight nodes
    old = F.pmod(F.xxhash64(F.col("_metadata.file_name")), F.lit(shards))
    assigned, cuts = reshard(docs, old, shards, shards)
    table = rewrite_shards(assigned, cuts, f"{shared_dir(spark)}/leadloom/shards-{uuid.uuid4().hex}", shards)
    body = F.coalesce("text", F.lit(""))
    return table.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
