"""Claims over several passes, notices and lifetimes; upserts with crashes and fresh checkpoints."""

import time

import pytest
from pyspark.sql import functions as F

from leadloom.streaming import claims

MESSAGE = "doc_id long, claimed_at long, status string, content_hash string, k string"


def passes(spark, root, *slices, **how):
    for rows in slices:
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(f"{root}/in")
        claims.drain(claims.claims(spark.readStream.schema(MESSAGE).parquet(f"{root}/in"), "k", **how), f"{root}/c1", path=f"{root}/by_id")
        claims.drain(claims.content_twins(spark.readStream.schema(claims.CLAIM).parquet(f"{root}/by_id")), f"{root}/c2", path=f"{root}/out")
    rows = claims.canonical(spark.read.schema(claims.CLAIM).parquet(f"{root}/out")).collect()
    return {r["doc_id"]: (r["outcome"], r["reason"], r["duplicate_of"], r["attempts"]) for r in rows}


def test_takeover_dead_letter_and_twins(spark, tmp_path):
    got = passes(
        spark, str(tmp_path),
        [(1, 0, "claimed", "h1", "a"), (2, 5, "failed", "h2", "b"), (3, 6, "processed", "h3", "c"), (4, 7, "processed", "h3", "d"), (5, 8, "processed", "x", None), (6, 9, "processed", "x", None)],
        [(11, 500, "claimed", "h1", "a"), (12, 501, "failed", "h2", "b"), (13, 502, "processed", "h3", "d"), (14, 503, "failed", "h4", "e")],
        [(21, 1000, "processed", "h1", "a"), (22, 1001, "failed", "h2", "b"), (23, 1002, "processed", "h4", "f"), (24, 1003, "processed", "h2", "g"), (25, 1004, "processed", None, "h")],
        [(31, 1100, "processed", "h1", "a"), (32, 1101, "processed", "h2", "b"), (33, 1102, "processed", "h1", "z")],
    )
    assert got == {
        1: ("claimed", None, None, 1), 2: ("claimed", None, None, 1), 3: ("claimed", None, None, 1), 4: ("duplicate", "content", 3, 1), 5: ("claimed", None, None, 1), 6: ("duplicate", "content", 5, 1),
        11: ("duplicate", "message_id", 1, 1), 12: ("taken_over", None, None, 2), 13: ("duplicate", "message_id", 3, 1), 14: ("claimed", None, None, 1),
        21: ("taken_over", None, None, 2), 22: ("dead_letter", None, None, 3), 23: ("claimed", None, None, 1), 24: ("claimed", None, None, 1), 25: ("claimed", None, None, 1),
        31: ("duplicate", "message_id", 21, 2), 32: ("duplicate", "message_id", 22, 3), 33: ("duplicate", "content", 1, 1),
    }


def test_stale_notice(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(1, 0, "claimed", "h", "a"), (2, 0, "processed", "i", "b")], MESSAGE).coalesce(1).write.parquet(f"{root}/in")
    stream = claims.claims(spark.readStream.schema(MESSAGE).parquet(f"{root}/in"), "k", stale_s=1, notices=True)
    query = stream.writeStream.option("checkpointLocation", f"{root}/c").trigger(processingTime="1 second").format("parquet").option("path", f"{root}/out").start()
    try:
        end = time.time() + 90
        while time.time() < end:
            time.sleep(2)
            rows = spark.read.schema(claims.CLAIM).parquet(f"{root}/out").where("outcome = 'stale'").collect() if (tmp_path / "out").exists() else []
            if rows:
                break
        assert [r["doc_id"] for r in rows] == [1]
        assert query.exception() is None
    finally:
        query.stop()


def batch(spark, rows):
    return spark.createDataFrame(rows, "company string, lead_id long, score int")


def held_rows(table, spark):
    return [tuple(r) for r in table.read(spark, "company string, lead_id long, score int").collect()]


@pytest.mark.parametrize("buckets", [1, 5])
def test_upsert_keeps_the_last_row(spark, tmp_path, buckets):
    table = claims.Upsert(str(tmp_path), "company", ["lead_id"], buckets)
    assert table.read(spark) is None
    table.write(batch(spark, []), 0, "q")
    assert table.read(spark) is None
    table.write(batch(spark, [("a", 1, 10), ("b", 2, 20), ("a", 3, 30), (None, 1, 1)]), 1, "q")
    table.write(batch(spark, [("a", 2, 99), ("c", 5, None)]), 2, "q")
    table.write(batch(spark, [("a", 9, 0)]), 2, "q")  # the batch that is already there
    assert set(held_rows(table, spark)) == {("a", 3, 30), ("b", 2, 20), ("c", 5, None), (None, 1, 1)}


def test_only_touched_buckets_are_written_and_old_ones_go(spark, tmp_path):
    table = claims.Upsert(str(tmp_path), "company", ["lead_id"], 8)
    table.write(batch(spark, [(f"c{i}", i, i) for i in range(50)]), 0, "q")
    for n in range(1, 6):
        table.write(batch(spark, [("c7", 100 + n, n)]), n, "q")
    folders = [p for p in tmp_path.glob("v*/bucket=*") if list(p.glob("*.parquet"))]
    assert len(folders) <= 9  # eight buckets, and the one before of the touched bucket
    assert len(held_rows(table, spark)) == 50 and ("c7", 105, 5) in held_rows(table, spark)


def test_fresh_checkpoint_and_crash(spark, tmp_path):
    """c comes through a new checkpoint whose epochs begin at 0; a batch that dies before its manifest is done again."""
    root = str(tmp_path)

    def feed(rows, checkpoint):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/{checkpoint}-in")
        stream = claims.poll(spark, f"{root}/{checkpoint}-in", "company string, lead_id long, score int")
        claims.drain(stream, f"{root}/{checkpoint}", writer=claims.upsert(f"{root}/out", "company", "lead_id"))

    feed([("a", 1, 1)], "one")
    feed([("b", 1, 1)], "one")
    feed([("c", 1, 1)], "two")
    feed([("d", 1, 1), ("a", 2, 2)], "two")
    table = claims.Upsert(f"{root}/out", "company", ["lead_id"])
    assert set(held_rows(table, spark)) == {("a", 2, 2), ("b", 1, 1), ("c", 1, 1), ("d", 1, 1)}

    class Dies(claims.Upsert):
        def _clean(self, *_):
            raise AssertionError("never reached")

    keep = spark.createDataFrame
    dying = Dies(f"{root}/out", "company", ["lead_id"])
    rows = batch(spark, [("e", 1, 1), ("a", 3, 3)])

    def broken(*_, **__):
        raise OSError("the driver is gone")

    spark.createDataFrame = broken
    try:
        with pytest.raises(OSError):
            dying.write(rows, 7, "q")
    finally:
        spark.createDataFrame = keep
    assert set(held_rows(table, spark)) == {("a", 2, 2), ("b", 1, 1), ("c", 1, 1), ("d", 1, 1)}
    table.write(rows, 7, "q")
    assert set(held_rows(table, spark)) == {("a", 3, 3), ("b", 1, 1), ("c", 1, 1), ("d", 1, 1), ("e", 1, 1)}
    assert table.read(spark).where(F.col("company") == "a").count() == 1
