"""The record sink over runs, counts of a write, and a caller's enrichment with rejected rows."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from leadloom.operators import records

RECORD = "record_id string, status string, dry_run boolean, processed_at long, note string"


def test_dry_runs_never_spoil_records(spark, tmp_path):
    sink = records.RecordSink(f"{tmp_path}/r", 3)
    put = lambda run, *rows: sink.write(spark.createDataFrame(list(rows), RECORD), run)
    assert sink.read(spark) is None
    sink.export(spark, f"{tmp_path}/none")
    put("1", ("a", "processed", False, 5, "x"), ("b", "failed", None, 5, None))
    put("2", ("a", "needs_review", True, 9, "dry"), ("c", "needs_review", True, 1, None), ("c", "processed", True, 2, None))
    put("3", ("b", "processed", False, 6, None), ("c", "failed", False, 0, "real"))
    put("3", ("b", "rejected", False, 7, None))  # the run that is there already
    got = {r["record_id"]: (r["status"], r["dry_run"], r["processed_at"], r["note"]) for r in sink.read(spark).collect()}
    assert got == {"a": ("processed", False, 5, "x"), "b": ("processed", False, 6, None), "c": ("failed", False, 0, "real")}
    sink.export(spark, f"{tmp_path}/json")
    assert {r["status"]: r["count"] for r in spark.read.json(f"{tmp_path}/json").groupBy("status").count().collect()} == {"processed": 2, "failed": 1}
    assert spark.range(1).select(records.record_id(F.lit("<a@b>"))).first()[0] == __import__("hashlib").sha256(b"<a@b>").hexdigest()[:24]


def test_counts_are_taken_while_rows_are_written(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def seen(x):
        runs.add(1)
        return x

    rows = spark.createDataFrame([("processed",), ("failed",), (None,), ("odd",), ("dead_letter",)], "status string").withColumn("status", F.udf(seen, StringType())("status"))
    got = records.observed_write(rows, f"{tmp_path}/out").first()
    assert (got["attempted"], got["succeeded"], got["errors"], got["other"], got["n_processed"], got["n_rejected"]) == (5, 1, 2, 2, 1, 0)
    assert runs.value == 5 and spark.read.parquet(f"{tmp_path}/out").count() == 5
    assert records.observed_write(rows.where("false"), f"{tmp_path}/no").first()["attempted"] == 0


def test_marks(spark):
    rows = [("clear", "clear"), ("review", "blocked"), ("blocked", "review"), ("clear", "review"), ("blocked", "clear"), ("clear", None), ("review", "error")]
    table = spark.createDataFrame(rows, "expected string, got string")
    assert [r["mark"] for r in records.case_marks(table).collect()] == ["OK", "SOFT", "SOFT", "MISS", "MISS", "MISS", "MISS"]
    assert tuple(records.accuracy(table).first()) == (7, 0.143, 0.429, 2)


def test_enrich(spark):
    result = StructType([StructField("size", LongType(), False), StructField("known", BooleanType())])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        assert len(rows) <= 4
        if (rows["name"] == "boom").any():
            raise ValueError("no answer")
        if (rows["name"] == "short").any():
            return rows.iloc[1:].assign(size=1, known=True)
        return pd.DataFrame({"size": [{"bad": "many", "null": None}.get(n, len(n)) for n in rows["name"]], "known": [None if n == "abc" else True for n in rows["name"]], "name": "changed"})

    names = ["abc", "bad", "null", "de"] + ["x"] * 3 + ["boom"] + ["short"] + ["y"] * 3 + ["last"]
    rows = spark.createDataFrame([(i, n, -1) for i, n in enumerate(names)], "id long, name string, size int").coalesce(1)
    good, rejected = records.enrich(rows, fill, result, batch_rows=4)
    assert [f.dataType for f in good.schema][-2:] == [LongType(), BooleanType()]
    assert {r["id"]: (r["name"], r["size"], r["known"]) for r in good.collect()} == {0: ("abc", 3, None), 3: ("de", 2, True), 12: ("last", 4, True)}
    reasons = {r["id"]: r["reason"] for r in rejected.collect()}
    assert reasons[1] == "size is no bigint" and reasons[2] == "size is null" and all(reasons[i] == "ValueError: no answer" for i in range(4, 8)) and all(reasons[i] == "3 rows for 4" for i in range(8, 12))
    empty, none = records.enrich(rows.where("false"), fill, result)
    assert empty.count() == 0 and none.count() == 0
