"""Shingles of lines as rows, and where filters stand in the plans of line deduplication."""

import numpy as np
from pyspark.sql import functions as F

from leadloom.llm import line_dedup


def test_shingle_rows_are_the_shingles_of_each_line(spark):
    lines = [("one",), ("a b c d",), ("a b c d e",), ("a\tb  c\x0bd e f\r g",), ("w " * 300,), ("é 日本 x y z é 日本",)]
    frame = spark.createDataFrame(lines, "line string")
    want = frame.select(F.explode(line_dedup.line_shingles(F.col("line"), 5)).alias("token"))
    got = line_dedup.shingle_rows(frame, 5)
    assert sorted(r.token for r in got.collect()) == sorted(r.token for r in want.collect()) and got.count() == 1 + 1 + 1 + 3 + 296 + 3
    assert line_dedup.shingle_rows(frame.limit(0), 5).count() == 0


def test_joins_stay_above_their_filters_and_alone_lines_are_not_grouped(spark, monkeypatch):
    """A semi-join is pushed below the broadcast filter before it and then shuffles every row."""
    plans, real = [], line_dedup.materialize

    def watched(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, label)

    monkeypatch.setattr(line_dedup, "materialize", watched)
    rng = np.random.default_rng(1)
    words = [" ".join(f"w{x}" for x in rng.integers(500, size=20)) for _ in range(30)]
    docs = spark.createDataFrame([(i, "\n".join([words[i], words[i // 2], f"own {i}"])) for i in range(30)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect()}
    seen, want = set(), {}
    for i in range(30):
        want[i] = sum(w in seen or (seen.add(w) or False) for w in (words[i], words[i // 2]))
    assert got == want
    assert not any("LeftSemi" in plan for _, plan in plans)
    assert [plan.count("LeftAnti") for label, plan in plans if label == "sets"] == [1]


def test_lines_are_told_apart_without_patterns_and_sets_are_compiled(spark):
    """Patterns decode every line; what a lambda takes as its argument is interpreted with it."""
    space = "\t \x0b\f\r"
    docs = spark.createDataFrame([(1, f"a\n\n{space}\n {space} b\u00a0{space}\n\u2003\n"), (2, None), (3, ""), (None, "a")], "doc_id long, text string")
    lines = line_dedup.lines_of(docs)
    table = F.array_repeat(F.lit(1).cast("long"), 1 << line_dedup.RARITY_BITS)
    sets = lines.select("doc_id", "line_no", "line", line_dedup.by_rarity(line_dedup.line_shingles(F.col("line"), 1), table).alias("ordered"))
    found = {(r.doc_id, r.line_no): (r.line, len(r.ordered)) for r in sets.collect()}
    assert found == {(1, 0): ("a", 1), (1, 3): (f" {space} b\u00a0{space}", 1), (1, 4): ("\u2003", 1)}
    twice = spark.createDataFrame([("b a b a b",)], "line string").select(line_dedup.by_rarity(line_dedup.line_shingles(F.col("line"), 1), table).alias("ordered")).first().ordered
    assert len(twice) == 2 and twice == sorted(twice)
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "sort_array(array_distinct(transform(" in plan


def test_only_lines_that_may_match_are_ordered_and_none_of_these_is_lost(spark, monkeypatch):
    """Small vocabularies: words and shingles that repeat within a line, chance matches, lines of every length."""
    kept, real = [], line_dedup.materialize

    def watched(df, label):
        out = real(df, label)
        kept.extend([out.count()] * (label == "sets"))
        return out

    monkeypatch.setattr(line_dedup, "materialize", watched)
    rng = np.random.default_rng(5)
    alone = [" ".join(f"{'long' * (i % 3)}{i}_{j}" for j in range(1 + i % 40)) for i in range(120)]
    near = []
    for i in range(150):
        base = [f"v{x}" for x in rng.integers(2 + i % 9 * 12, size=1 + i)]
        cut = rng.integers(0, 2 + len(base) // 8)
        near += [" ".join(base), " ".join(base[cut:]) or "w", " ".join([*base[: len(base) - cut], *base[:cut]])]
    lines = [x for pair in zip(alone, near, strict=False) for x in pair] + near[len(alone) :]

    def grams(line):
        w = line.split(" ")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [grams(x) for x in lines]
    want = {i for i, x in enumerate(sets) if any(100 * len(x & y) >= 80 * len(x | y) for y in sets[:i])}
    got = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_removed = 1").collect()}
    assert got == want and len(want) > 100
    assert len(kept) == 1 and len(want) < kept[0] + len(lines) - len(set(lines)) and kept[0] <= len(near)
