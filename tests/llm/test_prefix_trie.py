"""The prefix trie against its SQL and against a plain walk over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from leadloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    members, chars, ends = defaultdict(list), {(): 0}, defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            chars[path[:d]] = len(path[d - 1][1]) if d else 0
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * chars[p] + sum(saved[x] for x in children[p])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_its_sql_and_a_plain_walk(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    rows = got(prefix_trie.op13_prefix_trie(spark, sf_dir))
    assert rows == sorted(con.execute(prefix_trie.ORACLE).fetchall())
    assert rows == plain(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())


def odd_rows():
    rng = random.Random(2)
    rows = []
    for c in list(range(0, 130)) + [250, 305, 999, 12345]:  # bases 200, 300, 900 and 12300 are absent
        first = rng.choice(["hi", "", None, "ho 😀"])
        rows += [(c, t if t else None, rng.choice(["user", None]) if t % 2 else "user", first if t == 0 else rng.choice("ab") * rng.randint(0, 2)) for t in range(rng.randint(1, 9))]
    for c in range(400, 480):  # copies of one conversation
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    rows += [(7, 3, "user", "again")] * 4 + [(7, None, None, None)] * 2 + [(None, 1, "user", "no conversation")]
    rows += [(2000, t, "user", "long" + "x" * (t % 3)) for t in range(150)]  # a long chain
    rows += [(3000, 1, "user", f"turn {t % 2}") for t in range(40)]  # one turn number
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS conv", "2 AS leaves").repartition(7)
    assert got(prefix_trie.prefix_trie(table)) == plain(rows)


def test_conversations_over_many_partitions(spark, monkeypatch):
    """One conversation holds most rows and its share of ids is joined in many strings."""
    rows = [(100, t, "user", "a" * (t % 4)) for t in range(400)] + [(c, t, "user", "a" * t) for c in range(101, 160) for t in range(3)] + [(c, 0, "user", "b") for c in range(500, 600)]
    monkeypatch.setattr(prefix_trie, "JOINED", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
        assert turns.where("conv = 100").select("part").distinct().count() > 3
        assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rounds_follow_the_logarithm_of_a_chain(spark, monkeypatch):
    nodes = spark.range(600).selectExpr("0L AS conv", "id AS depth", "IF(id = 0, NULL, 0L) AS up_conv", "IF(id = 0, NULL, id - 1) AS up_depth", "1L AS one")
    written = []
    keep = prefix_trie.materialize
    monkeypatch.setattr(prefix_trie, "materialize", lambda df, label: (written.append(label), keep(df, label))[1])
    totals = {r["depth"]: r["one"] for r in prefix_trie.contract(nodes, ["one"]).collect()}
    assert totals == {d: 600 - d for d in range(600)}
    assert sum(not x.endswith("back") for x in written) < 30


def test_no_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    assert got(prefix_trie.prefix_trie(spark.createDataFrame([(5, None, None, None)], SCHEMA))) == plain([(5, None, None, None)])
