"""The prefix trie of conversations, its subtree totals by parallel tree contraction.

Turns are numbered over a global sort: a conversation may lie in several range partitions, whose shares are linked by a row per
partition and conversation. The prefix of d turns is known by the exclusive or of 128-bit hashes of (position, role, text), so that
every share hashes its own turns and is joined to what lies before it. Equal prefixes are one node, named by its smallest member
and its depth.

Subtree totals come from alternating two join rounds over the nodes that are left. Rake: leaves hand their totals to their parents.
Compress: of a chain of nodes with one child each, those whose priority of the round is above that of their parent and their child
are taken out; the parent takes their weight, the child their place. A node knows its only child as the exclusive or of its
children's names, so no round needs a search. Every round takes out the leaves and about a third of each chain, so rounds follow
the logarithm of the longest chain, and the tables of all rounds together are a small multiple of the nodes. Then rounds are
undone from the last to the first: a node that was taken out has its own weight and its child's total.

A node's list of ended conversations may be any length: shares of it, in numeric order, are joined to strings in parallel; one
pass over those strings per node, which holds one at a time, digests them.

Defined results: rows with a null conv_id take no part; null role and text are empty; turns are ordered by turn (null first), then
role, then text; an empty table gives no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm._common import discard, materialize

SHARED_TURNS, GROUP = 6, 100
#: Ids that are joined to one string.
JOINED = 4096
_KEY = ("conv", "depth")
_PARENT = ("up_conv", "up_depth")


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A written table of conv, part, place (from 1 in the part's share), a and b (hashes of role and text) and chars."""
    own = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]  # row: repeats of one turn are split too
    laid = own.repartitionByRange(*keys).sortWithinPartitions(*keys)
    hashed = laid.select(
        "conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mid"),
        F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(1), "role").alias("b"), F.char_length("text").cast("long").alias("chars"),
    )
    return materialize(hashed, "turns")


def _before(value: Column, key: str = "conv", order: str = "part") -> Column:
    return value.over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: per rebuilt turn conv, depth, x and y (its prefix), px and py (the prefix without it) and chars; per
    conversation conv, length and x, y of the whole."""
    shares = turns.groupBy("conv", "part").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    shares = materialize(shares.withColumn("passed", F.coalesce(_before(F.sum("n")), F.lit(0))), "shares")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED_TURNS
    convs = shares.groupBy("conv").agg(F.sum("n").alias("turns")).select("conv", "turns", (F.col("conv") - F.col("conv") % GROUP).alias("base"), h.alias("h"))

    def hashes(position: Column) -> list[Column]:
        return [F.xxhash64(position, F.col("a"), F.col("b")).alias("hx"), F.xxhash64(F.col("b"), position, F.col("a")).alias("hy")]

    numbered = turns.join(shares.select("conv", "part", "first", "passed"), ["conv", "part"]).withColumn("idx", F.col("mid") - F.col("first") + 1 + F.col("passed"))
    # the first turns of the conversations that others begin with, a few rows each
    heads = numbered.where((F.col("conv") % GROUP == 0) & (F.col("idx") < SHARED_TURNS)).select(F.col("conv").alias("base"), "idx", "chars", *hashes(F.col("idx")))
    run = Window.partitionBy("base").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    heads = materialize(heads.withColumn("x", F.bit_xor("hx").over(run)).withColumn("y", F.bit_xor("hy").over(run)), "heads")
    given = heads.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("idx", F.struct("x", "y")))).alias("given"))  # 5 entries at most
    known = convs.join(given, "base", "left").withColumn("m", F.least("h", F.coalesce(F.size(F.map_keys("given")), F.lit(0))).cast("long"))
    start = F.get(F.transform(F.array("given"), lambda g: g[F.col("m")]), 0)
    known = materialize(
        known.select("conv", "base", "h", "m", "turns", F.coalesce(start["x"], F.lit(0)).alias("bx"), F.coalesce(start["y"], F.lit(0)).alias("by")), "convs"
    )
    shared = known.where("m > 0").select("conv", "base", "m").join(heads, "base").where("idx <= m").select(
        "conv", F.col("idx").alias("depth"), "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py"), "chars"
    )
    # own turns: each share's running prefix, then what the shares before it add
    placed = turns.join(shares.join(known, "conv").select("conv", "part", "first", "passed", "h", "m", "bx", "by"), ["conv", "part"])
    placed = placed.withColumn("idx", F.col("mid") - F.col("first") + 1 + F.col("passed")).where("idx > h").withColumn("depth", F.col("idx") - F.col("h") + F.col("m"))
    here = Window.partitionBy("conv", "part").orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.select("conv", "part", "mid", "depth", "chars", "bx", "by", *hashes(F.col("depth")))
    running = materialize(running.withColumn("rx", F.bit_xor("hx").over(here)).withColumn("ry", F.bit_xor("hy").over(here)), "running")
    sums = running.groupBy("conv", "part").agg(F.bit_xor("hx").alias("sx"), F.bit_xor("hy").alias("sy"), F.count(F.lit(1)).alias("k"))
    sums = sums.select("conv", "part", F.coalesce(_before(F.bit_xor("sx")), F.lit(0)).alias("ox"), F.coalesce(_before(F.bit_xor("sy")), F.lit(0)).alias("oy"))
    x, y = (F.col(f"b{c}").bitwiseXOR(F.col(f"r{c}")).bitwiseXOR(F.col(f"o{c}")) for c in "xy")
    own = running.join(sums, ["conv", "part"]).select("conv", "depth", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("hx")).alias("px"), y.bitwiseXOR(F.col("hy")).alias("py"), "chars")
    rebuilt = materialize(shared.union(own), "rebuilt")
    length = F.col("m") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))
    lengths = materialize(known.select("conv", length.alias("length")), "lengths")
    for table in (shares, heads, known, running):
        discard(table)
    return rebuilt, lengths


def trie(rebuilt: DataFrame, lengths: DataFrame) -> DataFrame:
    """A written table of the nodes: conv (smallest member), depth, x, y, up_conv, up_depth (the parent), members, chars."""
    found = rebuilt.groupBy("depth", "x", "y").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("members"), F.first("px").alias("px"), F.first("py").alias("py"), F.first("chars").alias("chars"))
    root = lengths.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("members")).where("members > 0")
    none = F.lit(None).cast("long")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "conv", "members", none.alias("px"), none.alias("py"), F.lit(0).cast("long").alias("chars"))
    nodes = materialize(found.unionByName(root), "prefixes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("up_conv"))
    up_depth = F.when(F.col("depth") > 0, F.col("depth") - 1)
    table = materialize(nodes.join(above, ["depth", "px", "py"], "left").select("conv", "depth", "x", "y", "up_conv", up_depth.alias("up_depth"), "members", "chars"), "nodes")
    discard(nodes)
    return table


def contract(nodes: DataFrame, weights: list[str], label: str = "trie") -> DataFrame:
    """conv, depth and for each weight its sum over the node's subtree, a written table. nodes: conv, depth, up_conv, up_depth
    (null at the root) and the weights, whole numbers."""
    spark = nodes.sparkSession
    zero = [F.lit(0).cast("long")]
    children = nodes.where("up_depth is not null").groupBy(*_PARENT).agg(F.count(F.lit(1)).alias("k"), F.bit_xor("conv").alias("cx"), F.bit_xor("depth").alias("dx"))
    children = children.select(F.col("up_conv").alias("conv"), F.col("up_depth").alias("depth"), "k", "cx", "dx")
    alive = nodes.join(children, list(_KEY), "left").select(*_KEY, *_PARENT, *weights, *[F.coalesce(c, *zero).alias(c) for c in ("k", "cx", "dx")])
    rounds: list[DataFrame] = []
    while True:
        now = len(rounds)
        # rake: what the leaves leave to their parents
        left = alive.where("k = 0 and up_depth is not null").groupBy(*_PARENT).agg(
            F.count(F.lit(1)).alias("lk"), F.bit_xor("conv").alias("lc"), F.bit_xor("depth").alias("ld"), *[F.sum(w).alias(f"l_{w}") for w in weights]
        )
        left = left.withColumnsRenamed({"up_conv": "conv", "up_depth": "depth"})
        raked = alive.join(left, list(_KEY), "left").select(
            *_KEY, *_PARENT, *[(F.col(w) + F.coalesce(f"l_{w}", *zero)).alias(w) for w in weights], (F.col("k") - F.coalesce("lk", *zero)).alias("k"),
            F.col("cx").bitwiseXOR(F.coalesce("lc", *zero)).alias("cx"), F.col("dx").bitwiseXOR(F.coalesce("ld", *zero)).alias("dx"), (F.col("k") == 0).alias("leaf"),
        )
        # compress: every other node of a chain or so, never two in a row
        rank = lambda c, d: F.xxhash64(c, d, F.lit(now))  # noqa: E731, B023
        own, up, down = rank("conv", "depth"), rank("up_conv", "up_depth"), rank("cx", "dx")
        out = ~F.col("leaf") & (F.col("k") == 1) & F.col("up_depth").isNotNull() & (own > up) & (own > down)
        table = materialize(raked.select("*", F.when(F.col("leaf"), "leaf").when(out, "out").otherwise("in").alias("state")).drop("leaf"), f"{label}-{now}")
        rounds.append(table)
        if table.where("state = 'in'").isEmpty():
            break
        gone = table.where("state = 'out'")
        to_parent = gone.select(
            F.col("up_conv").alias("conv"), F.col("up_depth").alias("depth"), *weights, F.col("conv").bitwiseXOR(F.col("cx")).alias("mc"), F.col("depth").bitwiseXOR(F.col("dx")).alias("md"), *[F.lit(None).cast("long").alias(f"new_{c}") for c in _PARENT]
        )
        to_child = gone.select(
            F.col("cx").alias("conv"), F.col("dx").alias("depth"), *[F.lit(0).cast("long").alias(w) for w in weights], F.lit(0).cast("long").alias("mc"), F.lit(0).cast("long").alias("md"), *[F.col(c).alias(f"new_{c}") for c in _PARENT]
        )
        news = to_parent.union(to_child).groupBy(*_KEY).agg(
            *[F.sum(w).alias(f"m_{w}") for w in weights], F.bit_xor("mc").alias("mc"), F.bit_xor("md").alias("md"), *[F.max(f"new_{c}").alias(f"new_{c}") for c in _PARENT]
        )
        alive = table.where("state = 'in'").join(news, list(_KEY), "left").select(
            *_KEY, *[F.coalesce(f"new_{c}", c).alias(c) for c in _PARENT], *[(F.col(w) + F.coalesce(f"m_{w}", *zero)).alias(w) for w in weights], "k",
            F.col("cx").bitwiseXOR(F.coalesce("mc", *zero)).alias("cx"), F.col("dx").bitwiseXOR(F.coalesce("md", *zero)).alias("dx"),
        )
    # re-expand: nodes that were taken out in a round, from what was still in after it
    totals: list[DataFrame] = []
    for table in reversed(rounds):
        if totals:
            later = totals[0]
            for t in totals[1:]:
                later = later.union(t)
            child = later.select(F.col("conv").alias("cx"), F.col("depth").alias("dx"), *[F.col(w).alias(f"c_{w}") for w in weights])
            back = table.where("state = 'out'").join(child, ["cx", "dx"]).select(*_KEY, *[(F.col(w) + F.col(f"c_{w}")).alias(w) for w in weights])
            totals.append(materialize(back, f"{label}-back"))
        totals.append(table.where("state = 'leaf'").select(*_KEY, *weights))
    every = totals[0]
    for t in totals[1:]:
        every = every.union(t)
    return every


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, x, y and the SHA-256 of the node's conv in numeric order, joined by commas. ends: depth, x, y, conv."""
    keys = ["depth", "x", "y", "conv"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        node: tuple | None = None
        start = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"depth": node[0], "x": node[1], "y": node[2], "start": start, "ids": ",".join(held)}], schema=kinds)

        kinds = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("start", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            rows: list[pa.RecordBatch] = []
            for d, x, y, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (d, x, y) != node or len(held) >= JOINED:
                    if held:
                        rows.append(out())
                    node, held, start = (d, x, y), [], c
                held.append(str(c))
            yield from pa.Table.from_batches(rows, kinds).combine_chunks().to_batches()
        if held:
            yield out()

    strings = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(join, "depth long, x long, y long, start long, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        kinds = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
        row = lambda: {"depth": node[0], "x": node[1], "y": node[2], "ends_sha256": sha.hexdigest()}
        for batch in batches:
            rows = []
            for d, x, y, _, ids in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (d, x, y) != node:
                    if sha:
                        rows.append(row())
                    node, sha = (d, x, y), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
        if sha:
            yield pa.RecordBatch.from_pylist([row()], schema=kinds)

    dealt = strings.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "start")
    return dealt.mapInArrow(digest, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = numbered_turns(conversations, conv_id, turn, role, text)
    rebuilt, lengths = rebuilt_turns(turns)
    discard(turns)
    nodes = trie(rebuilt, lengths)
    last = rebuilt.select("conv", F.col("depth").alias("length"), "x", "y")
    ends = lengths.join(last, ["conv", "length"], "left").select(F.col("length").alias("depth"), F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"), "conv")
    ends = materialize(end_digests(ends), "ends")
    children = nodes.where("up_depth is not null").groupBy(*_PARENT).agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"up_conv": "conv", "up_depth": "depth"})
    nodes_ = materialize(
        nodes.join(children, list(_KEY), "left").join(ends, ["depth", "x", "y"], "left").select(
            *_KEY, *_PARENT, "members", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), ((F.col("members") - 1) * F.col("chars")).alias("saved"),
        ), "nodes",
    )
    for table in (rebuilt, lengths, nodes, ends):
        discard(table)
    totals = contract(nodes_.select(*_KEY, *_PARENT, (F.col("n_children") == 0).cast("long").alias("leaves"), "saved"), ["leaves", "saved"])
    return nodes_.drop("saved").join(totals, list(_KEY)).select(
        F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256"
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH crc AS (SELECT list(list_reduce(list_concat([CAST(b AS BIGINT)], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
o AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
        xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM o), crc),
p AS (SELECT k.conv_id, 0 AS own, i, role, text FROM k JOIN o ON o.conv_id = k.base AND i <= h UNION ALL SELECT k.conv_id, 1, i, role, text FROM k JOIN o ON o.conv_id = k.conv_id AND i > h),
r AS MATERIALIZED (SELECT conv_id, CAST(row_number() OVER w AS BIGINT) AS depth, CAST(len(text) AS BIGINT) AS chars, list(md5(role || chr(1) || text)) OVER w AS path FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
c AS (SELECT conv_id, coalesce((SELECT max(depth) FROM r WHERE r.conv_id = k.conv_id), 0) AS n FROM k),
m AS MATERIALIZED (SELECT conv_id, depth, chars, md5(array_to_string(path, ',')) AS node FROM r UNION ALL SELECT conv_id, 0, 0, 'root' FROM k),
n AS MATERIALIZED (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) * (count(*) - 1) AS saved FROM m GROUP BY node, depth),
e AS (SELECT m.node, m.depth, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids FROM m JOIN c ON c.conv_id = m.conv_id AND c.n = m.depth GROUP BY m.node, m.depth),
u AS (SELECT n.node, n.depth, up.conv_id AS parent_conv_id, up.node AS up FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN n up ON up.node = m.node AND up.depth = m.depth),
g AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY ALL),
s AS (SELECT m.node, m.depth, count(*) FILTER (g.n_children IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth LEFT JOIN g ON g.up = n.node AND g.depth = n.depth GROUP BY m.node, m.depth)
SELECT n.conv_id, n.depth, u.parent_conv_id, n.n_convs, coalesce(g.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN u ON u.node = n.node AND u.depth = n.depth JOIN s ON s.node = n.node AND s.depth = n.depth LEFT JOIN g ON g.up = n.node AND g.depth = n.depth LEFT JOIN e ON e.node = n.node AND e.depth = n.depth
"""
