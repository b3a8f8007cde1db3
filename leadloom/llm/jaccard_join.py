"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct k-word shingles. Shingles are ordered by rarity (counts of all shingles, kept in a table
of fixed size, then the hash), and a document's prefix is long enough that two documents within the threshold must share a
shingle in their prefixes. Documents with the same prefix and size are one group, and only groups are joined: on shared prefix
shingles, behind the size and positional filters. Group pairs are then expanded to their classes (documents of the same set)
and verified on whole sets.

Group pairs are verified in two rounds, so that a large family of near copies costs rows in proportion to its members: first every
group against the leader it shares most prefix shingles with; then, exactly, all group pairs of a shared shingle whose members are
not yet connected. What stays unchecked is already in one component, so no link between components is lost. The positional filter
is the pair's own: both must meet so early in their prefixes that what follows can still hold the overlap they need. Members of a
family with many edits of their own begin with shingles nobody shares, so they pass it with nobody.

Defined results: texts that are null or without words have the empty set and link with nothing; so do rows with a null
doc_id, which keep a null component; repeated rows fall into one class; rows of one doc_id count as one document; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm._common import KeyFilter, discard, documents, materialize

#: Counters of the rarity table, a fixed size whatever the input. Beyond some 10^9 shingles they even out: then more pairs are
#: compared, and the result stays the same.
RARITY_BITS, CHUNK_BITS = 23, 15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text hashed at once, unless one text is longer: a task holds about 80 bytes for each of them.
_PIECE = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, 1024).bit_length()
    if size not in _POWERS:
        one = np.ones(1, dtype=np.uint64)
        up, down = (np.concatenate([one, np.cumprod(np.full(size - 1, b, dtype=np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        if size > 4 * _PIECE:  # of one long text: not kept in a worker that later tasks and stages share
            return up, down
        _POWERS.clear()
        _POWERS[size] = up, down
    return _POWERS[size]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts between bounds, lower-cased A to Z, and where each text's words begin."""
    data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stop = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    up, down = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    return mix((total[stop] - total[start]) * down[start]), np.searchsorted(start, bounds)


def text_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text in turn."""
    texts = column.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1)
            to = min(to, len(texts))
            bounds = offsets[at : to + 1] - offsets[at]
            words, first = word_hashes(data[offsets[at] : offsets[to]], bounds)
            windows = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
            for i in range(k):
                windows += words[i : i + len(windows)] * np.uint64(pow(0xD1342543DE82EF95, i + 1, 1 << 64))
            windows = mix(windows)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= k:
                    yield np.unique(windows[a : b - k + 1])
                elif b > a:  # fewer words than a shingle: the whole sequence is one
                    h = np.uint64(b - a)
                    for w in words[a:b]:
                        h = mix(np.asarray([h * np.uint64(0xA0761D6478BD642F) + w]))[0]
                    yield np.asarray([h])
                else:
                    yield np.zeros(0, dtype=np.uint64)
            at = to


def signature(s: np.ndarray, extra: int = 0) -> bytes:
    """128 bits that depend on the set, and an extra number, alone."""
    a, b = mix(s ^ np.uint64(0x2545F4914F6CDD1D)), mix(s + np.uint64(0x9FB21C651E98DF25))
    return np.asarray([a.sum(dtype=np.uint64) + np.uint64(len(s) + (extra << 32)), np.bitwise_xor.reduce(b) if len(s) else 0], dtype="<u8").tobytes()


def rarity(docs: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each of 2^RARITY_BITS buckets occur in all documents, on a logarithmic scale of a byte."""
    chunks, width = 1 << (RARITY_BITS - CHUNK_BITS), 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << RARITY_BITS, dtype=np.int32)
        for batch in batches:
            held, n = [], 0
            for s in text_sets(batch.column(0), k):
                held.append(s)
                n += len(s)
                if n > 1 << 17:
                    np.add.at(table, (np.concatenate(held) >> np.uint64(64 - RARITY_BITS)).astype(np.int64), np.int32(1))
                    held, n = [], 0
            if held:
                np.add.at(table, (np.concatenate(held) >> np.uint64(64 - RARITY_BITS)).astype(np.int64), np.int32(1))
        part = int(np.random.default_rng().integers(64))
        small = np.minimum(table, 65535).astype(np.uint16)  # of one task; only the order matters
        rows = [(c, part, small[c * width : (c + 1) * width]) for c in range(chunks)]
        rows = [r for r in rows if r[2].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary())], ["chunk", "part", "counts"])

    def adder(finish: Callable[[np.ndarray], np.ndarray]):
        def add(rows: pa.Table) -> pa.Table:
            total = np.zeros(width, dtype=np.int64)
            for x in rows.column("counts"):
                counts = x.as_buffer()
                total += np.frombuffer(counts, dtype=np.uint16 if len(counts) == 2 * width else np.uint32)
            return pa.table({"chunk": rows.column("chunk")[:1].cast(pa.int32()), "counts": pa.array([finish(total).tobytes()], pa.binary())})

        return add

    counted = docs.select("text").mapInArrow(count, "chunk int, part int, counts binary")
    # partial sums by part first, so that no task adds up the tables of all tasks
    parts = counted.groupBy("chunk", "part").applyInArrow(adder(lambda x: np.minimum(x, 2**32 - 1).astype(np.uint32)), "chunk int, counts binary")
    written = materialize(parts.groupBy("chunk").applyInArrow(adder(lambda x: (7.9 * np.log2(1.0 + x)).astype(np.uint8)), "chunk int, counts binary"), "rarity")  # drops the tasks' tables
    summed = written.toArrow()
    discard(written)
    table = np.zeros(1 << RARITY_BITS, dtype=np.uint8)  # of a fixed size, as is what comes to the driver
    for c, counts in zip(summed["chunk"].to_pylist(), summed["counts"], strict=True):
        table[c * width : (c + 1) * width] = np.frombuffer(counts.as_buffer(), dtype=np.uint8)
    return table


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def features(docs: DataFrame, table: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, n, cid (set signature), gid (signature of size and prefix) and the prefix in the order of rarity."""
    counts = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = counts.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, cid, gid, prefix = [], [], [], []
                for s in text_sets(batch.column(1), k):
                    order = np.argsort(common[(s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)], kind="stable")
                    p = s[order[: prefix_length(len(s), percent)]] if len(s) else s
                    with np.errstate(over="ignore"):
                        places = np.arange(1, len(p) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        gid.append(signature(mix(p + places), len(s)))
                        cid.append(signature(s))
                    n.append(len(s))
                    prefix.append(p.view(np.int64))
                flat = np.concatenate(prefix) if prefix else np.zeros(0, dtype=np.int64)
                ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(gid, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["doc_id", "n", "cid", "gid", "prefix"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, n long, cid binary, gid binary, prefix array<long>")


def fetch_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cid and the whole shingle set of each wanted class (columns rep, cid), read from the texts again.

    A broadcast filter passes nearly only the wanted documents, so that the other texts are neither shuffled nor kept.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = list(text_sets(part.column(1), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "cid", "shingles"]
                )

    held = KeyFilter(wanted.select("rep")).passing(docs.select("doc_id", "text"), F.col("doc_id"))
    found = held.mapInArrow(run, f"doc_id {kind}, cid binary, shingles binary")
    return found.join(wanted, "cid").where(F.col("doc_id") == F.col("rep")).dropDuplicates(["cid"]).select("cid", "shingles")


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b, cid_a, cid_b) whose whole sets reach the threshold, as a written table of a and b."""
    pairs = materialize(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("rep"), F.col("cid_a").alias("cid")).union(pairs.select("b", "cid_b")).distinct()
    ends = materialize(ends, "ends")
    sets = materialize(fetch_sets(docs, ends, k), "shingles")
    one = sets.select(F.col("cid").alias("cid_a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("cid").alias("cid_b"), F.col("shingles").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                same = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * same >= percent * (len(a) + len(b) - same))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    links = materialize(pairs.join(one, "cid_a").join(two, "cid_b").select("a", "b", "set_a", "set_b").mapInArrow(run, f"a {kind}, b {kind}"), "links")
    discard(pairs, ends, sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node reachable, a written table: labels spread over edges and jump along labels until none changes."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        spread = labels.join(around, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        ahead = labels.select(F.col("node").alias("new"), F.col("comp").alias("jump"))
        step = spread.join(ahead, "new", "left").select("node", F.least("new", F.coalesce("jump", "new")).alias("comp"), (F.least("new", F.coalesce("jump", "new")) != F.col("comp")).alias("moved"))
        before, labels = labels, materialize(step, "labels")
        discard(before)
        if labels.where("moved").isEmpty():
            discard(both)
            return labels


def possible(percent: int, n: Column, pos: Column, m: Column, qos: Column) -> Column:
    """Size and positional filter: whether sets of n and m shingles reach the threshold if what they share begins here.

    It holds for the first shingle that two linked sets share, so it may be asked of every shingle by itself.
    """
    need = percent * (n + m)
    return ((n - pos) * (100 + percent) >= need) & ((m - qos) * (100 + percent) >= need)


def shared_places(linkable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups (gid, g: their smallest doc_id, n, prefix), and g, n, pos, token of the prefix shingles that two groups or more share."""
    groups = materialize(linkable.groupBy("gid").agg(F.min("doc_id").alias("g"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "groups")
    twice = groups.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("token")
    twice = materialize(twice, "tokens")
    places = groups.select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = materialize(KeyFilter(twice).passing(places, F.col("token")).join(twice, "token", "left_semi"), "shared")
    discard(twice)
    return groups, shared


def leaders_of(shared: DataFrame, percent: int, most: int = 6) -> DataFrame:
    """g and up to six leaders: groups it shares most shingles with, of those that hold a shingle earliest.

    In a family of copies those are the least edited ones: they have the fewest shingles of their own, which come first.
    """
    best = F.row_number().over(Window.partitionBy("token").orderBy("pos", "g"))
    heads = shared.withColumn("_r", best).where(F.col("_r") <= most).select("token", F.col("g").alias("leader"), F.col("n").alias("m"), F.col("pos").alias("qos"))
    votes = (
        shared.join(heads, "token").where((F.col("g") != F.col("leader")) & possible(percent, F.col("n"), F.col("pos"), F.col("m"), F.col("qos")))
        .groupBy("g", "leader").agg(F.count(F.lit(1)).alias("votes"))
    )
    most_votes = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("votes"), "leader"))
    return votes.withColumn("_r", most_votes).where(F.col("_r") <= most).select("g", "leader")


def likely(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The pairs of groups (g, h, a written table) whose prefixes share enough: beyond them, at most one whole rest is shared. Prefixes
    are a tenth of the sets to move."""
    ends = pairs.select("g").union(pairs.select("h")).distinct()
    held = KeyFilter(ends).passing(groups.select("g", "n", "prefix"), F.col("g"))
    one, two = (held.select(F.col("g").alias(g), F.col("n").alias(f"{g}n"), F.col("prefix").alias(f"{g}p")) for g in "gh")
    rest = F.greatest(F.col("gn") - F.size("gp"), F.col("hn") - F.size("hp"))
    most = F.size(F.array_intersect("gp", "hp")) + rest
    return pairs.join(one, "g").join(two, "h").where(most * (100 + percent) >= percent * (F.col("gn") + F.col("hn"))).select("g", "h")


def unconnected(shared: DataFrame, spans: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (g, h), a written table, that pass the filters at a shared shingle and are not wholly in one component.

    spans: g, lo and hi, the least and greatest component of each group's classes.
    """
    placed = shared.join(spans, "g")
    # the sizes that a partner must have at least, and may have at most, at this place
    cap = F.floor((100 * F.col("n") - (100 + percent) * F.col("pos")) / percent)
    placed = placed.withColumn("cap", cap)
    open_tokens = placed.groupBy("token").agg(F.min("lo").alias("lo_"), F.max("hi").alias("hi_"), F.min("n").alias("n_"), F.max("cap").alias("cap_")).where("lo_ <> hi_")
    feasible = (F.col("n_") <= F.col("cap")) & (F.col("n") <= F.col("cap_"))
    rows = materialize(placed.join(open_tokens, "token").where(feasible).select("token", "g", "n", "pos", "lo", "hi"), "open")
    x, y = rows.alias("x"), rows.alias("y")
    apart = F.least("x.lo", "y.lo") != F.greatest("x.hi", "y.hi")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.g") < F.col("y.g")) & apart & possible(percent, F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
    inside = spans.where("lo <> hi").select("g", F.col("g").alias("h"))
    found = materialize(met.select(F.col("x.g").alias("g"), F.col("y.g").alias("h")).distinct().union(inside), "met")
    discard(rows)
    return found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, class_id (smallest doc_id of the same set) and component_id."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = materialize(features(docs, rarity(docs, k), k, percent), "features")
    groups, shared = shared_places(found.where((F.col("n") > 0) & F.col("doc_id").isNotNull()))
    every = materialize(found.select("doc_id", "n", "cid", "gid"), "documents")
    discard(found)
    linkable = every.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = linkable.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("gid").alias("gid"))
    classes = materialize(classes.join(groups.select("gid", "g"), "gid").select("cid", "rep", "g"), "classes")

    # round 1: each group's classes and the first class of its leaders; each further class and the first of its group
    firsts = classes.groupBy("g").agg(F.min(F.struct("rep", "cid")).alias("first"))
    led = materialize(leaders_of(shared, percent).select("g", F.col("leader").alias("h")), "met")
    pairs = likely(led, groups, percent).union(classes.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g", F.col("g").alias("h")))
    star = (
        classes.join(pairs, "g").join(firsts.select(F.col("g").alias("h"), "first"), "h").where(F.col("cid") != F.col("first.cid"))
        .select(F.col("rep").alias("a"), F.col("first.rep").alias("b"), F.col("cid").alias("cid_a"), F.col("first.cid").alias("cid_b"))
    )
    first_links = verify(star, docs, k, percent)
    discard(led)
    known = components(first_links)

    # round 2: group pairs that are not connected yet, expanded to their classes
    placed = materialize(classes.join(known.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("g", "rep", "cid", F.coalesce("comp", "rep").alias("comp")), "placed")
    apart = unconnected(shared, placed.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), percent)
    discard(shared, known)
    met = likely(apart, groups, percent)
    a, b = placed.alias("a"), placed.alias("b")
    rest = (
        met.join(a, F.col("a.g") == met["g"]).join(b, F.col("b.g") == met["h"]).where((F.col("a.comp") != F.col("b.comp")) & ((met["g"] != met["h"]) | (F.col("a.rep") < F.col("b.rep"))))
        .select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("a.cid").alias("cid_a"), F.col("b.cid").alias("cid_b"))
    )
    more_links = verify(rest, docs, k, percent)
    discard(groups, apart, placed)
    final = components(first_links.union(more_links))
    class_of = classes.select("cid", "rep").join(final.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("cid", F.col("rep").alias("class_id"), F.coalesce("comp", "rep").alias("comp"))
    own = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    result = every.select("doc_id", "n", "cid").join(class_of, "cid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(own, F.col("comp")).otherwise(F.col("doc_id")).alias("component_id")
    )
    result = materialize(result, "components")
    discard(every, classes, first_links, more_links, final)
    return result


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))
                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
c AS MATERIALIZED (SELECT min(doc_id) AS rep, len(any_value(s)) AS n, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
t AS MATERIALIZED (SELECT rep, n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 90 * (na + nb - k)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (WITH RECURSIVE walk(a, b) AS (SELECT a, b FROM u UNION SELECT walk.a, u.b FROM walk JOIN u ON walk.b = u.a) SELECT a, min(b) AS m FROM walk GROUP BY a),
f AS (SELECT c.rep, c.s, least(c.rep, coalesce(r.m, c.rep)) AS comp FROM c LEFT JOIN r ON r.a = c.rep)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(f.comp, s.doc_id) AS component_id FROM s LEFT JOIN f ON list_sort(s.s) = f.s AND len(s.s) > 0
"""
