"""Line deduplication and the pipeline's stages against plain Python."""

import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm.line_dedup import dedup_lines, op9_line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_set(line, k=5):
    ws = WORD.findall(line)
    return frozenset(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else (frozenset([tuple(ws)]) if ws else frozenset())


def brute(docs, percent=80):
    """doc_id -> (lines, removed, text)."""
    out, earlier, by_size = {}, defaultdict(set), []
    for i in sorted(docs):
        if docs[i] is None:
            out[i] = (0, 0, None)
            continue
        lines, kept = docs[i].split("\n"), []
        for line in lines:
            s = line_set(line)
            rivals = {j for t in s for j in earlier[t]}
            if s and any(100 * len(s & by_size[j]) >= percent * len(s | by_size[j]) for j in rivals):
                by_size.append(s)
            else:
                kept.append(line)
                by_size.append(s)
            for t in s:
                earlier[t].add(len(by_size) - 1)
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in op9_line_dedup(spark, sf_dir).collect()}
    assert got == brute(texts)


def test_line_dedup_of_families_and_odd_texts(spark):
    rng = np.random.default_rng(3)
    base = [f"w{rng.integers(300)}" for _ in range(60)]
    docs = {i: f"head {i}\n" + " ".join([*base[:i], f"x{i}", *base[i + 1 :]]) + "\n\nsame tail line of words" for i in range(40)}
    docs |= {50: None, 51: "", 52: "\n\n", 53: "a\tb  c\x0bd e f", 54: "a b c d e f", 55: "x\nx\nx", 56: "w " * 3000, 57: "\n".join("r s t" for _ in range(500)), 58: " ".join(f"c{j}" for j in range(3, 40)), 59: " ".join(f"c{j}" for j in range(36))}
    frame = spark.createDataFrame([*docs.items(), (None, "x\nx"), (None, None)], "doc_id long, text string").withColumn("n_lines", F.lit("old")).withColumn("n", F.lit(1))
    for clash in ("_id", "_kept", "_out", "row", "gone", "lines", "token", "filter_word"):
        frame = frame.withColumn(clash, F.lit(7))
    rows = dedup_lines(frame).collect()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in rows if r.doc_id is not None}
    assert got == brute(docs) and all(r.n == 1 and r["_out"] == r["gone"] == r["row"] == r["filter_word"] == 7 for r in rows)
    assert sorted((r.text or "", r.n_removed) for r in rows if r.doc_id is None) == [("", 0), ("x\nx", 0)]
    assert dedup_lines(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def test_pipeline_stages(spark, sf_dir, stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns
            assert after.where("n_chars <> length(text)").count() == 0
    before, after = stages["toxicity"]
    gone = before.join(after, "doc_id", "left_anti")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = gone.join(labels, "doc_id")
    assert judged.where("toxic = 0").count() == 0 and judged.where("toxic = 1").count() > 10
    before, after = stages["line_dedup"]
    want = brute({r.doc_id: r.text for r in before.collect()})
    want = {i: t for i, (_, removed, t) in want.items() if not (removed and not t.strip())}
    assert {r.doc_id: r.text for r in after.collect()} == want
    before, after = stages["near_duplicates"]
    assert 0 < after.count() <= before.count()
    _, after = stages["personal_data"]
    assert after.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.[a-z]")).count() == 0 and after.where("text like '%[EMAIL]%'").count() > 0
    before, after = stages["packing"]
    whole = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert whole.where("n <> m").count() == 0 and whole.count() == before.count()


def test_run_is_the_stages_in_turn(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages["packing"][1].count()
